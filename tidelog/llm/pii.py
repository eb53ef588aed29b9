"""Personal data replaced by keyed surrogates.

Entities (e-mail addresses, phone, card, social security and account numbers, IP addresses of both versions, keys and secrets,
names) are found in whole texts.  An entity's surrogate is drawn from a keyed hash of its type and canonical
form, so each mention of it anywhere gets the same one (coreference), written in the mention's own layout and
letter case.  Surrogates keep type and format (length, digits, country, issuer, check digits) and, for names,
gender and script.

Collision checks keep distinct entities distinct: over the table of all distinct entities, one whose surrogate
another entity also has (the first by attempts and value keeps it), or that is itself an entity of the corpus,
draws again until no collision is left.  Only entities that drew again need to be looked up when texts are
rewritten; they go out in blocks of ``block_rows`` rows, one pass over the texts per block.

Defined results: null text stays null with 0 entities; texts are searched whole; null ids and repeated rows are
rewritten like others; an empty table gives an empty table; ``n_entities`` replaces a column of that name, all
other columns stay.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

# --------------------------------------------------------------------------- detection

# Forms of address and frequent first names, by gender.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "г-н", "господин", "κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Doña", "г-жа", "госпожа", "κυρία"], "u": ["Dr", "Prof", "Doctor", "Professor"]}
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Wolfgang Jürgen Stefan Pierre Jacques Philippe Laurent Antoine José Juan Carlos Miguel Luis Javier Pedro Pablo Иван Сергей Алексей Дмитрий Николай Михаил Γιώργος Νίκος Wei Jun Hiroshi Kenji Rahul Arjun Sanjay Amit Deepak Mohammed Muhammad Ahmed Omar Hassan Ibrahim Yusuf Mustafa Khalid Oluwaseun Chinedu Adebayo Kwame Kofi Thabo Sipho João Paulo Ricardo Giovanni Marco Luca Lars Sven Mehmet Emre Minh",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emma Anna Laura Alice Ursula Monika Petra Sabine Claudia Marie Isabelle Sophie Nathalie Camille María Carmen Ana Isabel Lucía Elena Rosa Pilar Мария Анна Ольга Елена Наталья Татьяна Μαρία Ελένη Yuki Sakura Priya Anjali Lakshmi Fatima Aisha Layla Zainab Ngozi Chiamaka Amina Fernanda Beatriz Giulia Francesca Ingrid Astrid Ayşe Elif Linh Mei",
}
GENDER = {n: g for g, names in GIVEN.items() for n in names.split()}
TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)?|[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?|[Α-ΩΆΈ-Ώ][α-ωά-ώ]+)"
_TITLE = re.compile(r"\b(" + "|".join(sorted(map(re.escape, TITLE_GENDER), key=len, reverse=True)) + r")\.? (" + _NAME + r"(?: " + _NAME + r"){0,2})(?!\w)")
_FULL = re.compile(r"(?<!\w)(" + "|".join(sorted(GENDER, key=len, reverse=True)) + r") (" + _NAME + r"(?: " + _NAME + r")?)(?!\w)")
_WORD = re.compile(r"\w+")  # each given name that _FULL matches is such a run
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{3})[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")
_EMAIL = re.compile(r"[\w%+\-][\w.%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\w|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<hex>(?<!\w)(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}(?!\w))"
    r"|(?P<card>(?<![\w.\-+])\d(?:[ \-]?\d){12,18}(?![\w\-]))"
    r"|(?P<phone>(?<![\w.])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<![\w.])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\w)|(?<![\w.\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\w\-]))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
)
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|password|passwd|secret|api[_\-]?key)[^\w\n]{0,6}[=:][^\w\n]{0,6}([A-Za-z0-9_\-+/=.]*[A-Za-z0-9_\-+/=])")
_KEY = re.compile(r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)")
_HINT = re.compile("[0-9@]|AKIA")  # every entity but names holds one


# where _NUMBERS can match: tokens with a digit, and after the first of them capitals (an account number's groups)
_DIGITS = re.compile(r"(?<!\S)[^\s0-9]*[0-9]\S*(?: (?:[^\s0-9]*[0-9]\S*|[A-Z]+(?!\w)\S*))*")
_TAIL = re.compile(r" [A-Z]+$")


def _iban(mention: str) -> str:
    """mention less the words in capitals at its end, which belong to it only if its check digits say so."""
    best = mention
    while True:
        value = best.replace(" ", "")
        if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
            return best
        if not _TAIL.search(best):
            return best
        best = _TAIL.sub("", best)


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities of a text, in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    if _HINT.search(text):
        if "@" in text:
            found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
        if "::" in text or text.count(":") > 6:
            found += [(m.start(), m.end(), "ip6", m[0].lower()) for m in _IP6.finditer(text)]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "secret", m[0]) for m in _KEY.finditer(text)]
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text) if len(m[1]) >= 8 and re.search("[0-9]", m[1])]
        for m in (m for w in _DIGITS.finditer(text) for m in _NUMBERS.finditer(text, w.start(), w.end())):
            kind, value, end = m.lastgroup, m[0], m.end()
            if kind == "hex":
                kind = "secret"
            elif kind == "iban":
                value = _iban(value)
                end = m.start() + len(value)
                value = value.replace(" ", "")
                if len(value) < 15:
                    continue
            elif kind in ("card", "phone", "ssn"):
                value = "+" * (value[0] == "+") + re.sub(r"\D", "", value)
                if kind == "phone" and len(value) < 9:
                    continue
            found.append((m.start(), end, kind, value))
    people = []
    if any(t in text for t in TITLE_GENDER):
        people += [(m.start(2), m[2].split(" "), TITLE_GENDER[m[1]]) for m in _TITLE.finditer(text)]
    if not GENDER.keys().isdisjoint(_WORD.findall(text)):
        people += [(m.start(1), [m[1], *m[2].split(" ")], GENDER[m[1]]) for m in _FULL.finditer(text)]
    known: dict[str, tuple[str, str]] = {}
    for start, parts, gender in people:
        for i, part in enumerate(parts):
            given = part in GENDER or (i < len(parts) - 1)
            kind = f"given-{GENDER.get(part, gender)}-{script_of(part)}" if given else f"surname-{script_of(part)}"
            known.setdefault(part, (kind, part.casefold()))
            found.append((start, start + len(part), *known[part]))
            start += len(part) + 1
    if known:  # later mentions of the same names alone
        alone = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, (k for k in known if len(k) > 2)), key=len, reverse=True)) + r")(?!\w)") if any(len(k) > 2 for k in known) else None
        if alone:
            found += [(m.start(), m.end(), *known[m[1]]) for m in alone.finditer(text)]
    out, last = [], 0
    for f in sorted(set(found), key=lambda f: (f[0], f[0] - f[1])):
        if f[0] >= last:
            out.append(f)
            last = f[1]
    return out


# --------------------------------------------------------------------------- surrogates


class Draw:
    """A stream of keyed pseudo-random numbers."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.pool = key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 16:
            self.pool = int.from_bytes(hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key, digest_size=64).digest(), "big")
            self.n, self.left = self.n + 1, 64
        self.left -= 4
        value, self.pool = self.pool & 0xFFFFFFFF, self.pool >> 32
        return value * n >> 32

    def of(self, items):
        return items[self.below(len(items))]


# Syllables that surrogate names are made of, and endings that mark gender.
SYLLABLES = {"latin": ["ba", "be", "da", "do", "fe", "ga", "ha", "jo", "ka", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "ni", "pa", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "to", "va", "vi"], "cyrillic": ["ба", "бе", "ва", "ви", "га", "да", "де", "ка", "ла", "ле", "ли", "ма", "ми", "на", "не", "ни", "па", "ра", "ре", "ро", "са", "се", "та", "те", "то", "фе"], "greek": ["βα", "γα", "δα", "κα", "λα", "λε", "λι", "μα", "με", "μι", "να", "νε", "νι", "πα", "ρα", "ρε", "ρο", "σα", "σε", "τα", "τε", "το"]}
ENDINGS = {"latin": {"m": ["n", "r", "s", "l"], "f": ["a", "ina", "ela"], "u": ["n", "l"], "s": ["r", "n", "s", "k"]}, "cyrillic": {"m": ["н", "р", "м"], "f": ["на", "ла", "ия"], "u": ["н"], "s": ["ов", "ин", "ко"]}, "greek": {"m": ["ς"], "f": ["νη", "α"], "u": ["ς"], "s": ["ου", "ης"]}}


def _same_class(c: str, draw: Draw, hexadecimal: bool = False) -> str:
    if c.isdigit():
        return str(draw.below(10))
    if c.isalpha() and c.isascii():
        new = draw.of("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz")
        return new.upper() if c.isupper() else new
    return draw.of("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c


def luhn(digits: str) -> int:
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10


# Calling codes of one and of two digits (ITU E.164); all others have three.
ONE_DIGIT = "17"
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_digits(digits: str) -> int:
    """How many of the digits after a plus sign are the country's."""
    return 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3


PRIVATE = re.compile(r"10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|169\.254\.")


def _address(draw: Draw, value: str, longer: int) -> str:
    """Octets of the same widths (of any, after some collisions); private networks keep their prefix, others stay public."""
    prefix = PRIVATE.match(value)
    parts = value[prefix.end() if prefix else 0 :].split(".")
    while True:
        new = [str(1 + draw.below(254) if longer else [draw.below(9) + 1, 10 + draw.below(90), 100 + draw.below(155)][len(x) - 1]) for x in parts]
        out = (prefix[0] if prefix else "") + ".".join(new)
        if prefix or not (PRIVATE.match(out) or int(new[0]) > 223):
            return out


LAST = 60  # from this attempt on a surrogate is a token of its type, which always finds room


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The attempt-th surrogate of an entity, in canonical form; never the entity itself."""
    draw = Draw(key, kind, value, str(attempt))
    if attempt >= LAST:
        return f"[{kind}-{''.join(draw.of('0123456789abcdef') for _ in range(24))}]"
    while True:
        new = _surrogate(draw, kind, value, max(0, attempt - 4))
        if new != value:
            return new


def _surrogate(draw: Draw, kind: str, value: str, longer: int) -> str:
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        fresh = ["".join(_same_class(c, draw) for c in x) for x in labels[:-1]]
        if len("".join(fresh)) < 5:
            fresh[0] += "".join(_same_class("a", draw) for _ in range(5))
        local = "".join(_same_class(c, draw) for c in local) + "".join(_same_class("a", draw) for _ in range(longer))
        return f"{local}@{'.'.join([*fresh, labels[-1]])}"
    if kind == "ip":
        return _address(draw, value, longer)
    if kind == "ip6":  # the first group tells the kind of network
        first, colon, rest = value.partition(":")
        return first + colon + "".join(draw.of("123456789abcdef") if c not in ":0" else c for c in rest) + ("%x" % (1 + draw.below(15))) * (longer > 0 and rest.endswith(":"))
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        check = next(d for d in "0123456789" if luhn(body + d) == 0)
        return body + (check if luhn(value) == 0 else str((int(check) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        plus, digits = ("+", value[1:]) if value[0] == "+" else ("", value)
        keep = country_digits(digits) if plus else 0
        return plus + digits[:keep] + str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in digits[keep + 1 :])
    if kind == "ssn":
        return "".join(str(draw.below(10)) for _ in value)
    if kind == "iban":
        body = "".join(_same_class(c, draw) for c in value[4:])
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "secret":
        start = 4 if value.startswith("AKIA") else 0
        hexadecimal = re.fullmatch("[0-9a-fA-F]+", value) is not None
        return value[:start] + "".join((draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") if start else _same_class(c, draw, hexadecimal)) for c in value[start:])
    role, _, rest = kind.partition("-")
    gender, _, script = rest.rpartition("-")
    size = max(2, len(value) // 2 - 1) + longer
    stem = "".join(draw.of(SYLLABLES[script]) for _ in range(size))
    return stem + draw.of(ENDINGS[script][gender if role == "given" else "s"])


def render(mention: str, kind: str, new: str) -> str:
    """A surrogate in the layout and letter case of a mention."""
    if new.startswith("["):
        return new
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(new.lstrip("+"))
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind.startswith(("given", "surname")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new.capitalize()
    if kind == "ip6":
        return new.upper() if mention.isupper() else new
    return new


def rewrite(text: str, key: bytes, attempts: Mapping[tuple[str, str], int]) -> tuple[str, int]:
    """(text with surrogates, number of mentions replaced)."""
    out, last, found = [], 0, find(text)
    for a, b, kind, value in found:
        out += [text[last:a], render(text[a:b], kind, surrogate(key, kind, value, attempts.get((kind, value), 0)))]
        last = b
    return "".join([*out, text[last:]]) if found else text, len(found)


# --------------------------------------------------------------------------- operators


def entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The distinct entities of all texts: kind, value, attempt (0), surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for part in C.slices(b, "text"):
                for t in part.column("text").to_pylist():
                    if t:
                        seen.update((f[2], f[3]) for f in find(t))
            kinds, values = ([x[i] for x in sorted(seen)] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string").distinct()
    return found.withColumn("attempt", F.lit(0)).withColumn("surrogate", _drawn(key)("kind", "value", "attempt"))


def _drawn(key: bytes):
    @F.pandas_udf("string")
    def drawn(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, a) for k, v, a in zip(kind, value, attempt, strict=True)], dtype=object)

    return drawn


def settle(found: DataFrame, key: bytes, most: int = 80) -> DataFrame:
    """The entities with surrogates that no other entity has or is.

    Where a type's space is too full for that, an entity gets a token of its type after LAST attempts.
    """
    found = C.written(found, "entities")
    for turn in range(most):
        group = found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "value")).alias("first")).where("n > 1")
        shared = found.join(group, ["kind", "surrogate"]).where("value <> first.value").select("kind", "value")
        real = found.select("kind", F.col("surrogate").alias("s"), "value").join(found.select("kind", F.col("value").alias("s")).distinct(), ["kind", "s"], "left_semi").select("kind", "value")
        again = C.written(shared.union(real).distinct().withColumn("again", F.lit(1)), "collisions")
        if again.isEmpty():
            return found
        # after eight rounds attempts go up in larger steps, so that full spaces are left soon
        bumped = found.join(again, ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.coalesce(F.col("again") * (1 if turn < 8 else 16), F.lit(0)))
        redrawn = bumped.where("again is not null").withColumn("surrogate", _drawn(key)("kind", "value", "attempt"))
        found = C.written(bumped.where("again is null").unionByName(redrawn).drop("again"), "entities")
    raise RuntimeError("surrogates still collide; their space is too small for the corpus")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", block_rows: int = 200_000) -> DataFrame:
    """docs with surrogates in ``text_col`` and the number of mentions, ``n_entities``."""
    spark = docs.sparkSession
    docs = C.without(docs, "n_entities", "__again")
    drew = settle(entities(docs, key, text_col), key).where("attempt > 0").select("kind", "value", "attempt")
    blocks: list[list] = [[]]
    n = drew.count()
    count = max(1, -(-n // block_rows))
    drew = C.written(drew.withColumn("block", F.expr(f"pmod(xxhash64(kind, value), {count}L)")), "redrawn")
    schema_end = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType())])
    schema_mid = T.StructType([*docs.schema.fields, T.StructField("__again", T.StringType())])
    for k in range(count):
        last = k == count - 1
        blocks = {(r["kind"], r["value"]): r["attempt"] for r in drew.where(F.col("block") == k).toLocalIterator()}
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in C.slices(batch, text_col):
                    texts = b.column(text_col).to_pylist()
                    notes = b.column("__again").to_pylist() if "__again" in b.schema.names else [None] * len(texts)
                    if not last:  # note the attempts of this block's entities
                        for i, t in enumerate(texts):
                            own = [[f[2], f[3], shared.value[f[2:]]] for f in (find(t) if t else ()) if f[2:] in shared.value]
                            if own:
                                notes[i] = json.dumps((json.loads(notes[i]) if notes[i] else []) + own)
                        yield C.put(b, __again=pa.array(notes, pa.string()))
                        continue
                    out, n = [], []
                    for t, note in zip(texts, notes, strict=True):
                        attempts = ChainMap({(a, v): x for a, v, x in json.loads(note)}, shared.value) if note else shared.value
                        new, m = rewrite(t, key, attempts) if t else (t, 0)
                        out.append(new)
                        n.append(m)
                    yield C.put(b, **{text_col: pa.array(out, pa.string()), "n_entities": pa.array(n, pa.int64())}).select(schema_end.names)

        docs = docs.mapInArrow(run, schema_end if last else schema_mid)
        if not last:
            docs = C.written(docs, "pii-round")
    return docs


def op2_pii(spark: SparkSession, sf_dir: str, key: bytes = b"a demonstration key; real runs bring their own") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key).select("doc_id", "n_entities", "text")
