"""WARC archives: written by Spark's text writer, read back whole, and assembled into captures.

Writing.  Every page becomes one transaction of three records (ISO 28500 / WARC 1.1): request, response
(or revisit, profile identical-payload-digest) and metadata, the first and the last bound to the second by
WARC-Concurrent-To.  A transaction is one string, and the text writer with the line separator CRLF CRLF puts
them into gzip files, so any store that Spark can write to holds valid archives.

Of records with equal payloads of ``min_revisit`` bytes at least, that of the smallest page id (of repeated
rows one) is the response.  Only (id, digest) pairs are grouped for that; the html is dealt by page id once.

Reading.  Files are read as whole bounded binaries (``records_per_file`` transactions each), parsed by
Content-Length, digests verified.  Transaction assembly joins request, response and metadata records through
their concurrent-to identifiers, one nested row per capture.

Defined results: null html is an empty payload; a null url writes no target URI and a null id no id, and both
come back null; repeated rows are captures of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(*parts: Column) -> Column:
    """A urn:uuid made of the MD5 of the parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing CRLF CRLF; headers of a null value are left out."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    head += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    head.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF + CRLF), block)


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit: int = 100, records_per_file: int = 4000
) -> None:
    """Write the archives of pages into the folder path."""
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    p = p.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("")))  # never null: window and join share one exchange
    small = p.select("id", "key", "digest", "bytes").where(F.col("bytes") >= min_revisit)
    groups = small.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = small.select("key", "digest").distinct().join(groups, "digest").select("key", "digest", "first", F.lit(True).alias("grouped"))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")))
    p = p.join(again.hint("shuffle_hash"), ["key", "digest"], "left")
    revisit = F.coalesce(F.col("grouped"), F.lit(False)) & ~(F.col("id").eqNullSafe(F.col("first")) & (F.col("k") == 1))

    target = F.regexp_replace("url", r"[\r\n]", "%0A")
    main_id = _urn(F.lit("main"), F.col("id"), F.col("digest"), F.col("k"))
    both = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    path_of = F.coalesce(F.nullif(F.regexp_extract(target, r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract(target, r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    request = F.concat(F.lit("GET "), path_of, F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    fields = F.concat(F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.concat(F.lit("payload-length: "), F.col("bytes").cast("string"))), F.lit(CRLF))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http_type = lambda what: ("Content-Type", F.lit(f"application/http; msgtype={what}"))
    response = _record("response", [("WARC-Record-ID", main_id), *both, digest, http_type("response")], F.concat(http, F.col("html")))
    refers = _urn(F.lit("main"), F.col("first"), F.col("digest"), F.lit(1))
    again_record = _record("revisit", [("WARC-Record-ID", main_id), *both, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers), digest, http_type("response")], http)
    own = lambda what: ("WARC-Record-ID", _urn(F.lit(what), F.col("id"), F.col("digest"), F.col("k")))
    with_main = ("WARC-Concurrent-To", main_id)
    value = F.concat_ws(
        CRLF + CRLF,
        _record("request", [own("request"), *both, with_main, http_type("request")], request),
        F.when(revisit, again_record).otherwise(response),
        _record("metadata", [own("metadata"), *both, with_main, ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    p.select(value.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# --------------------------------------------------------------------------- reading


def parse_warc(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(type, header fields in lower case, block) of each record of an uncompressed archive."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError(f"WARC record without an end of header at byte {at}")
            return
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"WARC record cut short at byte {at}")
        yield head["warc-type"], head, block
        at = end + 4 + size + 4


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, digest string, payload_bytes long, page_id long"


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
        types = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()] * with_payload
        for b in batches:
            for content in b.column("content"):
                rows: list[tuple] = []
                for kind, head, block in parse_warc(gzip.decompress(content.as_py())):
                    digest, size, page, payload = head.get("warc-payload-digest"), None, None, None
                    if digest:
                        digest = digest.partition(":")[2]
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size = len(payload)
                        if digest is None:
                            digest = hashlib.sha256(payload).hexdigest()
                        elif hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head.get('warc-record-id')} doesn't match its digest")
                    elif kind == "metadata":
                        own = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8").split(CRLF))}
                        page, size = (int(own[k]) if k in own else None for k in ("page-id", "payload-length"))
                    row = (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, size, page)
                    rows.append(row + (payload,) * with_payload)
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records(with_payload), RECORD + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), request, metadata.

    Records are joined through concurrent-to identifiers; a record that names none stands for its own capture.
    """
    plain = [c for c in records.columns if c != "concurrent_to"]
    one = F.struct(*plain)
    pick = lambda *kinds: F.max_by(F.when(F.col("type").isin(*kinds), one), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        pick("response", "revisit").alias("response"), pick("request").alias("request"), pick("metadata").alias("metadata")
    )


def captures(records: DataFrame) -> DataFrame:
    """assemble(), written once, with the page id of the response that each revisit refers to."""
    cap = C.written(assemble(records), "warc-captures")
    owner = cap.where(F.col("response.type") == "response").select(F.col("response.record_id").alias("o_id"), F.col("metadata.page_id").alias("refers_to_page"))
    refs = cap.where(F.col("response.type") == "revisit")
    joined = refs.join(owner, F.col("response.refers_to") == F.col("o_id"), "left").drop("o_id")
    rest = cap.where(F.col("response.type").isNull() | (F.col("response.type") != "revisit")).withColumn("refers_to_page", F.lit(None).cast("long"))
    return joined.unionByName(rest)


# --------------------------------------------------------------------------- query


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    cap = captures(read_warc(spark, path))
    return cap.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
r AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND k > 1 THEN first END AS refers_to
FROM r
"""
