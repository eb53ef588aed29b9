"""Line dedup, WARC, HTML text and top-k search on small tables with every odd case."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tidelog.llm import html_text, line_dedup, topk, warc
from tidelog.llm.line_dedup import PerfectHash, Shard

LONG = "a line that is long enough"


def test_perfect_hash_is_minimal_and_exact():
    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 5000)
    h = PerfectHash(keys.view(np.uint64))
    assert sorted(h.slots(keys.view(np.uint64)).tolist()) == list(range(5000))
    s = Shard(np.array([5, 5, 7]), np.array([1, 2, 3]), np.array([10, 20, 30]), np.array([2, 2, 2]))
    ok, first = s.owners(np.array([5, 5, 7, 5, 8]), np.array([1, 2, 3, 9, 3]))
    assert ok.tolist() == [True, True, True, False, False] and first[:3].tolist() == [10, 20, 30]


def brute_lines(rows):
    seen: dict = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(x.strip(" \t\n\x0b\x0c\r")) >= 10:
                seen.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (i is not None and len(seen.get(key(x), ())) > 1 and min(seen[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (3, f"  {LONG.upper()}\t\nown line of three"), (1, f"{LONG}\n{LONG}\nshort"), (2, f"short\n{LONG}"), (4, None), (5, ""), (None, LONG), (6, "Ünïcode line ÄÖ here\nx"), (7, "ünïcode line äö here\nx"),
    (8, "\u00a0" + LONG), (9, f"{LONG}\n" * 3), (9, f"{LONG}\n" * 3), (10, "z" * 50_000 + f"\n{LONG}"),
]


@pytest.mark.parametrize(("probes", "hot"), [(1 << 20, 64), (1, 64), (1, 3), (1, 1)])
def test_line_dedup(spark, probes, hot):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, n_lines int, h1 string")
    out = line_dedup.line_dedup(df, keys_per_shard=1, probes_per_group=probes, hot_rows=hot)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=repr) == brute_lines(ROWS) and "h1" in out.columns


def test_empty_tables(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []
    v = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.top_k(v, v).collect() == []


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/b", "x" * 150), (2, None, "x" * 150), (3, "http://a/\r\nc", None), (3, "http://a/\r\nc", None), (None, "u", "x" * 150), (5, "http://q", "é\r\n\r\n" * 60), (5, "http://q", "é\r\n\r\n" * 60), (6, "q", "small"), (7, "q", "small")]
    spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op8_warc(spark, str(tmp_path)).collect()), key=repr)
    want = [(1, 150, "response", None), (2, 150, "revisit", 1), (3, 0, "response", None), (3, 0, "response", None), (None, 150, "revisit", 1), (5, 360, "response", None), (5, 360, "revisit", 5), (6, 5, "response", None), (7, 5, "response", None)]
    assert got == sorted(want, key=repr)


def test_warc_payloads_and_assembly(spark):
    from tidelog.llm import common

    path = common.fresh_path(spark, "t")
    warc.write_warc(spark.createDataFrame([(1, "http://a/é", "<p>ü</p>\r\nWARC/1.1\r\n\r\n")], "page_id long, url string, html string"), path)
    records = warc.read_warc(spark, path, with_payload=True)
    cap = warc.assemble(records).collect()
    assert len(cap) == 1 and bytes(cap[0]["response"]["payload"]).decode() == "<p>ü</p>\r\nWARC/1.1\r\n\r\n"
    assert cap[0]["request"]["type"] == "request" and cap[0]["metadata"]["page_id"] == 1
    for bad in (b"WARC/1.1\r\nno end", b"nothing\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 9\r\n\r\nab"):
        with pytest.raises(ValueError):
            list(warc.parse_warc(bad))


TREE = html_text.grow(*html_text.labelled())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<article><p>a &amp; b&nbsp;&#x41;\n  c<br>d</p><p> </p><p>e</article>", "a & b A c d\n\ne"),
        ('<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="menu"><a href=x>A</a></div><main><h1>Title</h1><p>Hello <b>bold</b>.</p><aside>side</aside>'
         '<section class="comments"><p>nice one</p></section><form><label>Name</label><input></form></main><footer>f</footer></body></html>', "Title\n\nHello bold."),
        ('<article><h1>T</h1><script>var t="</p>";</script><p>x<!-- no <p>no --> y</p><style>p{}</style></article><div class="cookie-notice">We use cookies</div>', "T\n\nx y"),
        ("<article><p>cut &am", "cut &am"), ("<article><p>cut <b", "cut"), ("<article>1 < 2", "1 < 2"), ('<article><p title="a>b">q</p><p class="ad">buy</p></article>', "q"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page, TREE) == want


def test_tree_fits_its_table():
    x, y = html_text.labelled()
    assert (html_text.classify(TREE, x) == y).mean() > 0.99


def brute_top(rows, queries, k):
    out = []
    for qi, q in queries:
        scored = sorted(((sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qi), key=lambda x: (-x[0], x[1]))[:k]
        out += [(qi, r + 1, i, s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-5, 6, 6).tolist()) for i in range(150)] + [(200 + i, [1, 1, 1, 1, 1, 1]) for i in range(30)] + [(300, [0] * 6)]
    df = spark.createDataFrame([(i, [float(x) / 1024 for x in v], "s") for i, v in rows], "id long, v array<double>, shard string")
    bad = spark.createDataFrame([(900, None, ""), (901, [float("nan")] * 6, ""), (902, [None, 1.0], ""), (903, [float("inf")], ""), (None, [1.0], "")], "id long, v array<double>, shard string")
    v = topk.integer_vectors(df.union(bad), "id", "v")
    got = topk.top_k(v, v.where("id % 50 = 0"), 7, shard_rows=40, query_rows=2).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, [(i, x) for i, x in rows if i % 50 == 0], 7)


def test_maxscore_alone():
    r = np.random.default_rng(0)
    for trial in range(40):
        n, width = int(r.integers(1, 120)), int(r.integers(1, 20))
        v, q = r.integers(-5, 6, (n, width)), r.integers(-5, 6, width)
        if trial % 3 == 0:
            v = -abs(v)
        ids = np.sort(r.choice(300, n, replace=False))
        got = topk.Postings(ids, v, 5).search(int(ids[0]), q, 10, block=7)
        s, m = v @ q, ids != ids[0]
        order = np.lexsort((ids[m], -s[m]))[:10]
        assert (ids[m][order] == got[0]).all() and (s[m][order] == got[1]).all()
