"""The library's own queries, one per operator, each with the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .operators import patterns as pt
from .operators import windows as win
from .operators.context import nearest
from .operators.recursion import IncrementalFixpoint
from .operators.routing import route
from .plans import ir
from .plans.delta import Interval
from .plans.find import Snapshot
from .plans.ir import Agg, And, Closure, Col, Eq, Lit
from .sources.store import TraceStore
from .sources.tables import events_world, table, world
from .types import Schema, Ty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
rel = ir.rel


def query(sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _find(store: TraceStore, plan: ir.Plan, names: list[str], at: int | None = None, weights: bool = False) -> DataFrame:
    out = Snapshot(store, at).find(plan, names, weights)
    return out.withColumnRenamed("__diff", "diff") if weights else out


# ---------------------------------------------------------------- a: scans, filters, maps


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def rel_scan(spark, sf):
    return _find(world(spark, sf, "nation"), rel("nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 4000")
def range_lead(spark, sf):
    return _find(world(spark, sf, "orders"), ir.Range("orders", (1000,), (4000,)).project(0, 1), ["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey > 1000 OR (o_orderkey = 1000 AND o_custkey >= 70)) AND (o_orderkey < 2000 OR (o_orderkey = 2000 AND o_custkey < 5))")
def range_row(spark, sf):
    return _find(world(spark, sf, "orders"), ir.Range("orders", (1000, 70), (2000, 5)).project(0, 1), ["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 50 AND o_custkey < 100")
def range_col(spark, sf):
    return _find(world(spark, sf, "orders"), ir.RangeOn("orders", 1, 50, 100).project(0, 1), ["o_orderkey", "o_custkey"])


@query("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark, sf):
    return _find(world(spark, sf, "customer"), rel("customer").where_eq(4, "BUILDING").project(0, 2), ["c_custkey", "c_nationkey"])


@query("SELECT l_orderkey, l_partkey, count(*)::BIGINT AS diff FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY ALL")
def filter_and(spark, sf):
    p = rel("lineitem").filter(And((Eq(Col(5), Lit("R")), Eq(Col(3), Lit(1))))).project(0, 1)
    return _find(world(spark, sf, "lineitem"), p, ["l_orderkey", "l_partkey"], weights=True)


@query("SELECT l_orderkey, l_partkey, count(*)::BIGINT AS diff FROM lineitem WHERE l_partkey = l_suppkey GROUP BY ALL")
def filter_colcol(spark, sf):
    return _find(world(spark, sf, "lineitem"), rel("lineitem").filter(Eq(Col(1), Col(2))).project(0, 1), ["l_orderkey", "l_partkey"], weights=True)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def filter_closure(spark, sf):
    p = rel("orders").filter(Closure(columns=lambda *c: c[3] > 200000)).project(0, 3)
    return _find(world(spark, sf, "orders"), p, ["o_orderkey", "o_totalprice"])


@query("SELECT n_regionkey::BIGINT AS region, 'nation' AS kind, n_name AS name FROM nation")
def map_expr(spark, sf):
    return _find(world(spark, sf, "nation"), rel("nation").map(Col(2), Lit("nation"), Col(1)), ["region", "kind", "name"])


@query("SELECT o_custkey % 10 AS k, count(*)::BIGINT AS diff FROM orders GROUP BY 1")
def map_closure(spark, sf):
    return _find(world(spark, sf, "orders"), rel("orders").map_with(Closure(columns=lambda *c: [c[1] % 10])), ["k"], weights=True)


@query("SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment, count(*)::BIGINT AS diff FROM customer GROUP BY ALL")
def project_bag(spark, sf):
    return _find(world(spark, sf, "customer"), rel("customer").project(2, 4), ["c_nationkey", "c_mktsegment"], weights=True)


@query("""SELECT count(*)::BIGINT AS n, sum(w)::BIGINT AS weight FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT AS q, l_returnflag, l_linestatus, count(*) AS w
  FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 500 GROUP BY ALL)""")
def span_count(spark, sf):
    rows = _find(world(spark, sf, "lineitem"), ir.RangeOn("lineitem", 0, 100, 500), [f"v{i}" for i in range(7)], weights=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("diff").alias("weight"))


@query("SELECT k::BIGINT AS k, (SELECT count(*) FROM nation WHERE n_nationkey = k AND n_regionkey = k % 5) > 0 AS present FROM range(20, 30) t(k)")
def member(spark, sf):
    store = world(spark, sf, "nation")
    pairs = Snapshot(store).find(rel("nation").project(0, 2), ["a", "b"], weights=True).where("__diff > 0").select("a", "b")
    probes = spark.range(20, 30).select(F.col("id").alias("k"), F.col("id").alias("a"), (F.col("id") % 5).alias("b"))
    return probes.join(pairs.withColumn("hit", F.lit(True)), ["a", "b"], "left").select("k", F.coalesce("hit", F.lit(False)).alias("present"))


# ---------------------------------------------------------------- b: joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_equi(spark, sf):
    return _find(world(spark, sf, "orders", "customer"), rel("orders").join(rel("customer"), [1], [0]).project(0, 6), ["o_orderkey", "c_name"])


@query("""SELECT r_name, n_name, count(*)::BIGINT AS diff FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
  JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def join_multi(spark, sf):
    p = rel("region").join(rel("nation"), [0], [2]).join(rel("customer"), [2], [2]).join(rel("orders"), [5], [1]).join(rel("lineitem"), [10], [0])
    return _find(world(spark, sf, "region", "nation", "customer", "orders", "lineitem"), p.project(1, 3), ["r_name", "n_name"], weights=True)


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def join_self(spark, sf):
    return _find(world(spark, sf, "supplier"), rel("supplier").join(rel("supplier"), [2], [2]).project(0, 4), ["a", "b"])


@query("SELECT r_name, n_name FROM region, nation")
def cross(spark, sf):
    return _find(world(spark, sf, "region", "nation"), rel("region").join(rel("nation")).project(1, 3), ["r_name", "n_name"])


@query("SELECT a.r_name AS lower, b.r_name AS upper FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def theta_via_table(spark, sf):
    store = world(spark, sf, "region")
    store.register("precedes", Schema.of(("a", Ty.INT), ("b", Ty.INT)))
    store.commit([("precedes", (a, b), 1) for a in range(5) for b in range(5) if a < b])
    return _find(store, rel("region").join(rel("precedes"), [0], [0]).join(rel("region"), [3], [0]).project(1, 5), ["lower", "upper"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_derived(spark, sf):
    late = rel("orders").where_eq(2, "F")
    return _find(world(spark, sf, "orders", "customer"), rel("customer").project(0).semi(late, [0], [1], 1), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey < 2000)")
def anti_derived(spark, sf):
    return _find(world(spark, sf, "orders", "customer"), rel("customer").project(0).anti(ir.RangeOn("orders", 0, None, 2000), [0], [1], 1), ["c_custkey"])


# ---------------------------------------------------------------- c: aggregates


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf):
    return _find(world(spark, sf, "lineitem"), rel("lineitem").project(5, 6).distinct(), ["l_returnflag", "l_linestatus"])


@query("SELECT c_nationkey::BIGINT AS c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def reduce_count(spark, sf):
    return _find(world(spark, sf, "customer"), rel("customer").reduce([2], Agg("count")), ["c_nationkey", "n"])


@query("""SELECT l_returnflag, l_linestatus, sum(q)::BIGINT AS quantity FROM (
  SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT AS q, l_returnflag, l_linestatus FROM lineitem) GROUP BY ALL""")
def reduce_sum(spark, sf):
    return _find(world(spark, sf, "lineitem"), rel("lineitem").reduce([5, 6], Agg("sum", 4)), ["l_returnflag", "l_linestatus", "quantity"])


@query("SELECT o_custkey, min(o_totalprice) AS least FROM orders GROUP BY 1")
def reduce_min(spark, sf):
    return _find(world(spark, sf, "orders"), rel("orders").reduce([1], Agg("min", 3)), ["o_custkey", "least"])


@query("SELECT p_brand, max(p_name) AS last FROM part GROUP BY 1")
def reduce_max(spark, sf):
    return _find(world(spark, sf, "part"), rel("part").reduce([2], Agg("max", 1)), ["p_brand", "last"])


@query("SELECT l_suppkey, sum(DISTINCT l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY 1")
def yield_sum_distinct(spark, sf):
    return _find(world(spark, sf, "lineitem"), rel("lineitem").project(2, 4).distinct().reduce([0], Agg("sum", 1)), ["l_suppkey", "quantity"])


@query("SELECT DISTINCT l_suppkey, 1::BIGINT AS n FROM lineitem")
def yield_count_one(spark, sf):
    return _find(world(spark, sf, "lineitem"), rel("lineitem").project(2).distinct().reduce([0], Agg("count")), ["l_suppkey", "n"])


@query("SELECT count(*)::BIGINT AS n FROM customer")
def global_agg(spark, sf):
    return _find(world(spark, sf, "customer"), rel("customer").reduce([], Agg("count")), ["n"])


@query("SELECT count(*)::BIGINT AS n FROM customer WHERE c_mktsegment = 'NONE' HAVING count(*) > 0")
def global_agg_empty(spark, sf):
    return _find(world(spark, sf, "customer"), rel("customer").where_eq(4, "NONE").reduce([], Agg("count")), ["n"])


# ---------------------------------------------------------------- d: sets

_NATIONS = (rel("customer").project(2), rel("supplier").project(2))


@query("SELECT k, count(*)::BIGINT AS diff FROM (SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def union_bag(spark, sf):
    a, b = _NATIONS
    return _find(world(spark, sf, "customer", "supplier"), a.union(b), ["k"], weights=True)


@query("SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    a, b = _NATIONS
    return _find(world(spark, sf, "customer", "supplier"), a.union_distinct(b), ["k"])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey < 2000")
def difference(spark, sf):
    return _find(world(spark, sf, "customer", "orders"), rel("customer").project(0).difference(ir.RangeOn("orders", 0, None, 2000).project(1).distinct()), ["k"])


@query("SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf):
    a, b = _NATIONS
    return _find(world(spark, sf, "customer", "supplier"), a.distinct().intersect(b.distinct(), 1), ["k"])


@query("SELECT k, sum(w)::BIGINT AS diff FROM (SELECT c_nationkey::BIGINT AS k, 1 AS w FROM customer UNION ALL SELECT s_nationkey, -30 FROM supplier) GROUP BY 1 HAVING sum(w) <> 0")
def negate(spark, sf):
    a, b = _NATIONS
    out = a
    for _ in range(30):
        out = out.union(b.negate())
    return _find(world(spark, sf, "customer", "supplier"), out, ["k"], weights=True)


@query("SELECT c_nationkey::BIGINT AS k, (count(*) * count(*))::BIGINT AS diff FROM customer GROUP BY 1")
def shared(spark, sf):
    once = rel("customer").project(2).shared()
    return _find(world(spark, sf, "customer"), once.join(once, [0], [0]).project(0), ["k"], weights=True)


# ---------------------------------------------------------------- e: editions

_EV = """WITH t AS (SELECT event_id // 250 + 1 AS e, event_id % 250 AS s, user_id, event_id % 7 AS bucket,
  CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS d FROM events) """
_UB = ["user_id", "bucket"]


@query(_EV + "SELECT user_id, bucket, sum(d)::BIGINT AS diff FROM t WHERE e <= 20 GROUP BY ALL HAVING sum(d) <> 0")
def as_of(spark, sf):
    return _find(events_world(spark, sf), rel("ev"), _UB, at=20, weights=True)


@query(_EV + "SELECT e::BIGINT AS edition, s::BIGINT AS submit, user_id, bucket, d::BIGINT AS diff FROM t WHERE e > 20 AND e <= 30")
def delta_scan(spark, sf):
    return events_world(spark, sf).log("ev", 20, 30).select(F.col("__edition").alias("edition"), F.col("__submit").alias("submit"), F.col("c0").alias("user_id"), F.col("c1").alias("bucket"), F.col("__diff").alias("diff"))


@query(_EV + "SELECT user_id, bucket, coalesce(sum(d) FILTER (e <= 20), 0)::BIGINT AS w_a, sum(d)::BIGINT AS w_b FROM t WHERE e <= 30 GROUP BY ALL HAVING coalesce(sum(d) FILTER (e <= 20), 0) <> sum(d)")
def compare(spark, sf):
    return events_world(spark, sf).compare("ev", 20, 30).select(F.col("c0").alias("user_id"), F.col("c1").alias("bucket"), "w_a", "w_b")


@query(_EV + """, j AS (SELECT e, user_id, n_name, d FROM t JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey)
  SELECT user_id, n_name, sum(d)::BIGINT AS diff FROM j WHERE e > 20 AND e <= 30 GROUP BY ALL HAVING sum(d) <> 0""")
def delta_join(spark, sf):
    p = rel("ev").join(rel("customer"), [0], [0]).join(rel("nation"), [4], [0]).project(0, 8)
    return Interval(events_world(spark, sf, "customer", "nation"), 20, 30).delta(p, ["user_id", "n_name"]).withColumnRenamed("__diff", "diff")


@query(_EV + """, w AS (SELECT user_id, bucket, coalesce(sum(d) FILTER (e <= 20), 0) AS a, sum(d) AS b FROM t WHERE e <= 30 GROUP BY ALL)
  SELECT user_id, bucket, ((b > 0)::BIGINT - (a > 0)::BIGINT) AS diff FROM w WHERE (a > 0) <> (b > 0)""")
def delta_distinct(spark, sf):
    return Interval(events_world(spark, sf), 20, 30).delta(rel("ev").distinct(), _UB).withColumnRenamed("__diff", "diff")


@query(_EV + """, w AS (SELECT user_id, bucket, coalesce(sum(d) FILTER (e <= 20), 0) AS a, sum(d) AS b FROM t WHERE e <= 30 GROUP BY ALL),
  r AS (SELECT user_id, count(*) AS n, -1 AS d FROM w WHERE a > 0 GROUP BY 1 UNION ALL SELECT user_id, count(*), 1 FROM w WHERE b > 0 GROUP BY 1)
  SELECT user_id, n::BIGINT AS n, sum(d)::BIGINT AS diff FROM r GROUP BY ALL HAVING sum(d) <> 0""")
def delta_reduce(spark, sf):
    return Interval(events_world(spark, sf), 20, 30).delta(rel("ev").reduce([0], Agg("count")), ["user_id", "n"]).withColumnRenamed("__diff", "diff")


@query(_EV + "SELECT ((e - 1) // 6 * 6)::BIGINT AS w_from, least((e - 1) // 6 * 6 + 6, (SELECT max(e) FROM t))::BIGINT AS w_to, count(*)::BIGINT AS n, sum(d)::BIGINT AS net FROM t GROUP BY ALL")
def tumbling(spark, sf):
    store = events_world(spark, sf)
    return win.tumbling(store.log("ev"), 6, 0, store.current).groupBy("w_from", "w_to").agg(F.count(F.lit(1)).alias("n"), F.sum("__diff").alias("net"))


@query(_EV + ", w AS (SELECT a, least(a + 7, m) AS z FROM (SELECT max(e) AS m, unnest(range(0, max(e)::BIGINT, 3)) AS a FROM t)) SELECT a::BIGINT AS w_from, z::BIGINT AS w_to, count(*)::BIGINT AS n, sum(d)::BIGINT AS net FROM w JOIN t ON e > a AND e <= z GROUP BY ALL")
def sliding(spark, sf):
    store = events_world(spark, sf)
    return win.sliding(store.log("ev"), 7, 3, 0, store.current).groupBy("w_from", "w_to").agg(F.count(F.lit(1)).alias("n"), F.sum("__diff").alias("net"))


_SESSION = """, a AS (SELECT DISTINCT user_id, e FROM t), g AS (SELECT *, e - lag(e) OVER (PARTITION BY user_id ORDER BY e) AS gap FROM a),
  r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY e) AS run FROM g)
  SELECT user_id, (min(e) - 1)::BIGINT AS w_from, max(e)::BIGINT AS w_to FROM r GROUP BY user_id, run"""


@query(_EV + _SESSION)
def session(spark, sf):
    log = events_world(spark, sf).log("ev").withColumnRenamed("c0", "user_id")
    return win.sessions(log, 3, ["user_id"]).select("user_id", "w_from", "w_to")


@query(_EV + "SELECT user_id, bucket, e::BIGINT AS edition, s::BIGINT AS submit, d::BIGINT AS diff FROM t ORDER BY e DESC, s DESC LIMIT 300")
def count_window(spark, sf):
    return win.last_n(events_world(spark, sf).log("ev"), 300).select(F.col("c0").alias("user_id"), F.col("c1").alias("bucket"), F.col("__edition").alias("edition"), F.col("__submit").alias("submit"), F.col("__diff").alias("diff"))


@query(_EV + "SELECT user_id, bucket, sum(d)::BIGINT AS diff FROM t WHERE e <= 30 GROUP BY ALL HAVING sum(d) <> 0 AND coalesce(sum(d) FILTER (e > 20), 0) <> 0")
def state_window(spark, sf):
    return win.state_window(events_world(spark, sf).log("ev"), 20, 30).select(F.col("c0").alias("user_id"), F.col("c1").alias("bucket"), F.col("__diff").alias("diff"))


@query(_EV + "SELECT user_id, bucket, sum(d)::BIGINT AS diff FROM t WHERE e > 20 AND e <= 30 GROUP BY ALL HAVING sum(d) <> 0")
def event_fold(spark, sf):
    return win.consolidate_events(events_world(spark, sf).log("ev", 20, 30)).select(F.col("c0").alias("user_id"), F.col("c1").alias("bucket"), F.col("__diff").alias("diff"))


@query(_EV + ", w AS (SELECT user_id, bucket, sum(d) AS n FROM t WHERE e <= 20 GROUP BY ALL HAVING sum(d) > 0) SELECT user_id, bucket FROM w, range(0, 1000) r(i) WHERE i < n")
def values_expand(spark, sf):
    return win.values(Snapshot(events_world(spark, sf), 20).find(rel("ev"), _UB, weights=True))


# ---------------------------------------------------------------- f: recursion


def _edges(store: TraceStore, df: DataFrame, name: str = "edge") -> None:
    from .sources.store import as_trace

    store.bulk(name, as_trace(df, [("a", Ty.INT), ("b", Ty.INT)]), Schema.of(("a", Ty.INT), ("b", Ty.INT)), unique=True)


def _closure() -> ir.Iterate:
    return rel("edge").iterate(lambda x: x.join(rel("edge"), [1], [0]).project(0, 3))


_REACH = "SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a"
_TREE = "SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 0"


@query(f"WITH RECURSIVE edge AS ({_TREE}), reach AS ({_REACH}) SELECT a, b FROM reach")
def closure_tree(spark, sf):
    store = TraceStore(spark)
    _edges(store, table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("a"), F.floor((F.col("p_partkey") - 1) / 2).alias("b")))
    return _find(store, _closure(), ["a", "b"])


_CYCLE = "SELECT n_nationkey::BIGINT AS a, ((n_nationkey * 7 + 3) % 25)::BIGINT AS b FROM nation"


@query(f"WITH RECURSIVE edge AS ({_CYCLE}), reach AS ({_REACH}) SELECT a, b FROM reach")
def closure_cycle(spark, sf):
    store = TraceStore(spark)
    _edges(store, table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b")))
    return _find(store, _closure(), ["a", "b"])


@query(f"WITH RECURSIVE edge AS (SELECT * FROM ({_CYCLE}) WHERE a <> 3), reach AS ({_REACH}) SELECT a, b FROM reach")
def closure_after_delete(spark, sf):
    store = TraceStore(spark)
    _edges(store, table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b")))
    kept = IncrementalFixpoint(_closure(), Snapshot(store))
    store.commit([("edge", (3, 24), -1)])
    w = kept.advance(store.current)
    return w.df.select(F.col("c0").alias("a"), F.col("c1").alias("b"))


@query("""WITH RECURSIVE direct AS (SELECT p_partkey AS e, p_type AS b FROM part), proto AS (SELECT p_partkey AS c, (p_partkey - 1) // 2 AS p FROM part WHERE p_partkey > 0),
  i AS (SELECT e, b FROM direct UNION SELECT proto.c, i.b FROM i JOIN proto ON proto.p = i.e) SELECT e AS entity, b AS behavior FROM i""")
def implements(spark, sf):
    """Every part's own behaviour and those of all parts above it."""
    part = table(spark, sf, "part")
    return _implements(spark, part, part.where("p_partkey > 0"))


def _implements(spark, direct, below):
    from .process.dispatch import implements_plan
    from .sources.store import as_trace

    store = TraceStore(spark)
    store.bulk("direct", as_trace(direct, [("p_partkey", Ty.INT), ("p_type", Ty.TEXT)]), Schema.of(("entity", Ty.INT), ("behavior", Ty.TEXT)), unique=True)
    proto = below.select("p_partkey", F.floor((F.col("p_partkey") - 1) / 2).alias("parent"))
    store.bulk("prototype", as_trace(proto, [("p_partkey", Ty.INT), ("parent", Ty.INT)]), Schema.of(("child", Ty.INT), ("parent", Ty.INT)), unique=True)
    return _find(store, implements_plan(), ["entity", "behavior"])


# ---------------------------------------------------------------- g: words and patterns


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(fn.c_tokenize(F.col("text"))).cast("long").alias("words"))


@query("SELECT doc_id FROM documents WHERE text = 'that' OR list_contains(string_split_regex(text, '\\s+'), 'that')")
def word_match(spark, sf):
    return table(spark, sf, "documents").where(fn.c_word_match(F.col("text"), F.lit("that"))).select("doc_id")


FORM = pt.Form((
    pt.Rule(pt.Seq((pt.Lit("click"), pt.Bind("who"), pt.Lit("on"), pt.Bind("what"))), ir.Ctor("Click", ("who", "what"))),
    pt.Rule(pt.Seq((pt.Lit("error"), pt.Bind("who"), pt.Lit("on"), pt.Bind("what"))), ir.Ctor("Fault", ("what",))),
))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' ELSE 'Fault' END AS tag, CASE event_type WHEN 'click' THEN user_id ELSE event_id % 7 END::VARCHAR AS arg
  FROM events WHERE event_type IN ('click', 'error')""")
def form_parse(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat_ws(" ", "event_type", "user_id", F.lit("on"), (F.col("event_id") % 7).cast("string")).alias("line"))
    parsed = e.withColumn("p", pt.form_columns(FORM, fn.c_tokenize(F.col("line")), 3)).where("p is not null")
    return parsed.select("event_id", F.col("p")[0].alias("tag"), F.col("p")[1].alias("arg"))


@query(_EV + """, n AS (SELECT *, min(CASE WHEN d < 0 THEN e END) OVER (PARTITION BY user_id, bucket ORDER BY e, s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone FROM t)
  SELECT user_id, bucket, e::BIGINT AS came, gone::BIGINT AS gone FROM n WHERE d > 0 AND gone <= e + 5""")
def delta_cep(spark, sf):
    log = events_world(spark, sf).log("ev")
    w = Window.partitionBy("c0", "c1").orderBy(F.desc("__edition"), F.desc("__submit")).rowsBetween(Window.unboundedPreceding, -1)  # what comes later
    out = log.withColumn("gone", F.min(F.when(F.col("__diff") < 0, F.col("__edition"))).over(w)).where("__diff > 0 and gone <= __edition + 5")
    return out.select(F.col("c0").alias("user_id"), F.col("c1").alias("bucket"), F.col("__edition").alias("came"), "gone")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'take ' || n_name AS line FROM nation")
def ctor_print(spark, sf):
    form = pt.Form((pt.Rule(pt.Seq((pt.Lit("take"), pt.Bind("x"))), ir.Ctor("Take", ("x",))),))
    tokens = form.print(("Take", "\x00"))  # the rule inverted once; the slot is filled per row
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.concat_ws(" ", *[F.col("n_name") if t == "\x00" else F.lit(t) for t in tokens]).alias("line"))


# ---------------------------------------------------------------- h: what processes are made of


@query("SELECT n_nationkey + 1000::BIGINT AS k, n_name AS name, n_regionkey + 1000::BIGINT AS region FROM nation")
def instance_shift(spark, sf):
    from .process.template import shifted

    log = world(spark, sf, "nation").log("nation")
    schema = Schema.of(("k", Ty.ENT), ("name", Ty.TEXT), ("region", Ty.ENT))
    return shifted(log, schema, 1000).select(F.col("c0").alias("k"), F.col("c1").alias("name"), F.col("c2").alias("region"))


@query("SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name END AS setting FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def context_resolve(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    scopes = r.select(F.concat(F.lit("/"), F.col("r_regionkey"), F.lit("/")).alias("scope"), F.col("r_name").alias("value"))
    own = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("/"), F.col("n_regionkey"), F.lit("/"), F.col("n_nationkey"), F.lit("/")).alias("scope"), F.col("n_name").alias("value"))
    places = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("/"), F.col("n_regionkey"), F.lit("/"), F.col("n_nationkey"), F.lit("/")).alias("place"))
    return nearest(places, "c_custkey", "place", scopes.union(own), "scope", "value").select("c_custkey", F.col("value").alias("setting"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority LIMIT 1")
def least_match(spark, sf):
    rows = _find(world(spark, sf, "orders"), rel("orders").where_eq(2, "O"), ["o_orderkey", "o_custkey", "s", "t", "p"])
    return rows.orderBy(*rows.columns).limit(1).select("o_orderkey", "o_custkey")


@query("SELECT user_id AS sender, event_id % 50 AS seq, min(event_id) AS first FROM events GROUP BY ALL")
def outbox_dedup(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("sender"), (F.col("event_id") % 50).alias("seq")).agg(F.min("event_id").alias("first"))


@query("SELECT p_partkey AS watcher, o_orderkey AS row_key FROM part JOIN orders ON o_orderkey >= p_partkey * 10 AND o_orderkey < p_partkey * 10 + 15 WHERE p_size > 10")
def route_interests(spark, sf):
    spans = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("watcher"), (F.col("p_partkey") * 10).alias("lo"), (F.col("p_partkey") * 10 + 15).alias("hi"))
    return route(table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_key")), "row_key", spans, "lo", "hi", 16).select("watcher", "row_key")


@query(f"WITH RECURSIVE edge AS ({_TREE}), up AS (SELECT 100::BIGINT AS b UNION SELECT edge.b FROM up JOIN edge ON edge.a = up.b) SELECT b AS ancestor FROM up WHERE b <> 100")
def ancestry(spark, sf):
    store = TraceStore(spark)
    _edges(store, table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("a"), F.floor((F.col("p_partkey") - 1) / 2).alias("b")))
    up = rel("edge").where_eq(0, 100).project(1).iterate(lambda x: x.join(rel("edge"), [0], [0]).project(2))
    return _find(store, up, ["ancestor"])


# ---------------------------------------------------------------- i: stateful pieces and the language


@query("SELECT a.s_suppkey AS me, b.s_suppkey AS other, b.s_name AS name FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey = 3")
def view_here(spark, sf):
    from .lang.program import Program

    text = 'rel supplier(k: Int, name: Text, nation: Int, bal: Float)  view here(me) { supplier(me, n, place, b) supplier(other, name, place, c) yield other, name }'
    out = Program(text).find_view("here", [3], world(spark, sf, "supplier"))
    return out.select(F.lit(3).cast("long").alias("me"), "other", "name")


@query("SELECT c_mktsegment AS segment, sum(DISTINCT c_nationkey)::BIGINT AS nations FROM customer GROUP BY 1")
def view_sum(spark, sf):
    from .lang.program import Program

    text = "rel customer(ck: Int, cn: Text, nk: Int, bal: Float, seg: Text)  view nations() { customer(c, n, nk, b, seg) yield seg, sum(nk) }"
    return Program(text).find_view("nations", [], world(spark, sf, "customer")).toDF("segment", "nations")


@query("SELECT n_regionkey::BIGINT AS region, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def named_reduce(spark, sf):
    from .lang.program import Program

    p = Program("rel nation(nk: Int, nn: Text, rk: Int)  view all() { nation(nk, nn, rk) yield nk, rk }")
    return Snapshot(world(spark, sf, "nation")).find(p.reduce_view("all", [], ["rk"], "count"), ["region", "n"])


def _small(spark, sf) -> TraceStore:
    """Nations and regions as small commits, some of them taken back."""
    from .types import Ent

    store = TraceStore(spark)
    store.register("nation", Schema.of(("nk", Ty.ENT), ("nn", Ty.TEXT), ("rk", Ty.ENT)))
    rows = [(Ent(r[0]), r[1], Ent(r[2])) for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    for at in range(0, len(rows), 5):
        store.commit([("nation", r, 1) for r in rows[at : at + 5]])
    store.commit([("nation", r, -1) for r in rows if r[0] % 4 == 0])
    return store


def _sum_of(spark, rows, names) -> DataFrame:
    return spark.createDataFrame([tuple(int(v) if isinstance(v, int) else v for v in r) for r in rows], names)


_LEFT = "SELECT n_regionkey::BIGINT AS region, n_name AS name FROM nation WHERE n_nationkey % 4 <> 0"


@query(_LEFT)
def watch_pump(spark, sf):
    from .plans.local import consolidate
    from .process.watch import OnWatch
    from .types import Ent

    store, taken = _small(spark, sf).fork_at(1), []
    w = OnWatch(store, rel("nation").project(2, 1), Ent(1), "mail", "wcursor", "wseq", Ent(9), including_current=True)
    w.pump()
    for e in range(2, 7):  # the rest of the history, edition by edition
        store.commit([(n, r, d) for n in ("nation",) for x, r, d in _small(spark, sf).updates(n, e - 1, e)])
        w.pump()
    taken = [(r[2][1], r[2][0]) for r, _ in store.local("mail")]
    return _sum_of(spark, [r for r, d in consolidate(taken) if d > 0], "region long, name string")


@query(_LEFT)
def mat_view(spark, sf):
    from .process.watch import Materialized
    from .types import Ent

    store = _small(spark, sf)
    view = Materialized(store, rel("nation").project(2, 1), "nation_view", "vcursor", Ent(1))
    view.refresh()
    return _sum_of(spark, [r for r, w in view.rows() if w > 0], "region long, name string")


@query("SELECT n_nationkey::BIGINT AS due, n_name AS name, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS seq FROM nation WHERE n_nationkey <= 12")
def scheduler_fire(spark, sf):
    from .process.timers import Scheduler
    from .types import Ent

    store = TraceStore(spark)
    inbox = store.register("inbox").id
    store.commit([("timers", (int(r[0]), inbox, Ent(7), (r[1], int(r[0]))), 1) for r in table(spark, sf, "nation").collect()])
    Scheduler(store, "timers", "seqs").fire_due(12)
    return _sum_of(spark, [(r[2][1], r[2][0], r[1]) for r, _ in store.local("inbox")], "due long, name string, seq long")


@query("SELECT n_nationkey::BIGINT AS seq, n_name AS name FROM nation")
def replay(spark, sf):
    from .process.actors import Process, replay_from
    from .process.patch import Patch
    from .types import Ent

    store = TraceStore(spark)
    store.commit([("inbox", (Ent(1), int(r[0]), (r[1],)), 1) for r in table(spark, sf, "nation").collect()])
    actor = Process(store, Ent(1), "inbox", "cursor", lambda s, at, me, body: Patch(asserts=[("heard", (me, body[0]))]))
    actor.run()
    again = replay_from(actor, 1)
    return _sum_of(spark, [(p.patch.cursor[2][1] - 1, p.patch.asserts[0][1][1]) for p in again], "seq long, name string")


@query(_EV + "SELECT user_id, count(*)::BIGINT AS n FROM (SELECT user_id, bucket FROM t GROUP BY ALL HAVING sum(d) > 0) GROUP BY 1")
def stream_view(spark, sf):
    """A view maintained by Structured Streaming over a log folder that grows, then read as the sum of its changes."""
    import uuid

    from .sources.storage import shared_dir
    from .sources.tables import events_log
    from .streaming import DeltaTable, log_stream, maintain

    base = f"{shared_dir(spark)}/tidelog-stream-{uuid.uuid4().hex}"
    schema, log = Schema.of(("user_id", Ty.INT), ("bucket", Ty.INT)), events_log(spark, sf)
    sink, plan = DeltaTable(spark, f"{base}/view"), rel("ev").reduce([0], Agg("count"))
    for lo, hi in ((0, 20), (20, 1 << 40)):
        log.where((F.col("__edition") > lo) & (F.col("__edition") <= hi)).write.mode("append").parquet(f"{base}/log")
        maintain(log_stream(spark, f"{base}/log", schema), "ev", f"{base}/log", schema, plan, sink, f"{base}/offsets", ["user_id", "n"]).awaitTermination()
    return sink.rows().drop("__diff")


# ---------------------------------------------------------------- i: scalar functions, histories, branches


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, l_orderkey + l_partkey AS plus, l_partkey - l_orderkey AS minus, l_partkey * l_suppkey AS times,
  l_partkey // l_suppkey AS over, l_partkey % l_suppkey AS rest, -l_partkey AS neg, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, l_partkey::DOUBLE AS real FROM lineitem WHERE l_suppkey > 0""")
def checked_arithmetic(spark, sf):
    o, p, k = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    made = {"plus": fn.c_arithmetic("add", o, p), "minus": fn.c_arithmetic("sub", p, o), "times": fn.c_arithmetic("mul", p, k), "over": fn.c_div(p, k), "rest": fn.c_rem(p, k), "neg": fn.c_neg(p), "low": fn.c_least(p, k), "high": fn.c_greatest(p, k), "real": fn.c_float(p)}
    return table(spark, sf, "lineitem").where("l_suppkey > 0").select(o.alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("line"), *[v.alias(n) for n, v in made.items()])


@query("""SELECT o_orderkey, o_custkey = o_orderkey AS eq, o_custkey <> o_orderkey AS ne, o_custkey < o_orderkey AS lt, o_custkey <= o_orderkey AS le, o_custkey > o_orderkey AS gt, o_custkey >= o_orderkey AS ge,
  o_custkey < 50 AND o_orderstatus = 'F' AS both, o_custkey < 50 OR o_orderstatus = 'F' AS either FROM orders""")
def comparisons(spark, sf):
    a, b, low, f = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey") < 50, F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select("o_orderkey", *[fn.c_compare(k, a, b).alias(k) for k in ("eq", "ne", "lt", "le", "gt", "ge")], fn.c_and(low, f).alias("both"), fn.c_or(low, f).alias("either"))


@query("SELECT p_partkey, sha256(p_name) AS digest FROM part")
def sha256_digest(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lower(F.hex(fn.c_sha256(F.col("p_name").cast("binary")))).alias("digest"))


def _nations(spark, sf) -> list[tuple[int, str]]:
    return sorted((int(r[0]), r[1]) for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect())


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name, 1::BIGINT AS diff FROM nation WHERE n_nationkey <> 3")
def reopened_store(spark, sf):
    """A commit per nation and one that takes a row back, folded in the middle, read by a store opened anew."""
    import uuid

    from .sources.storage import shared_dir

    path = f"{shared_dir(spark)}/tidelog-store-{uuid.uuid4().hex}"
    store = TraceStore(spark, path)
    store.register("nation", Schema.of(("key", Ty.INT), ("name", Ty.TEXT)))
    rows = _nations(spark, sf)
    for r in rows:
        store.commit([("nation", r, 1)])
    store.consolidate(len(rows) // 2)
    store.commit([("nation", r, -1) for r in rows if r[0] == 3])
    return _find(TraceStore(spark, path), rel("nation"), ["key", "name"], weights=True)


@query("SELECT 'main' AS branch, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'side', least(10, count(*))::BIGINT + 1 FROM nation UNION ALL SELECT 'twig', least(10, count(*))::BIGINT + 2 FROM nation")
def branches(spark, sf):
    """A branch that leaves at the tenth edition, and one that leaves that branch; each has its own rows."""
    from .process.branches import Branches

    store = TraceStore(spark)
    store.register("nation", Schema.of(("key", Ty.INT), ("name", Ty.TEXT)))
    for r in _nations(spark, sf):
        store.commit([("nation", r, 1)])
    tree = Branches(store)
    for name, of, at in (("side", "main", min(10, store.current)), ("twig", "side", None)):
        tree.branch(name, of, at).commit([("nation", (1000 + len(tree.stores), name), 1)])
    assert tree.lineage("twig") == ["twig", "side", "main"]
    return _sum_of(spark, [(b, len(s.local("nation"))) for b, s in tree.stores.items()], "branch string, n long")


@query("""WITH RECURSIVE up AS (SELECT n_nationkey AS a, (n_nationkey - 1) // 2 AS b FROM nation WHERE n_nationkey > 0), r AS (SELECT a, b FROM up UNION SELECT r.a, up.b FROM r JOIN up ON r.b = up.a),
  cut AS (SELECT * FROM up WHERE a <> 5), q AS (SELECT a, b FROM cut UNION SELECT q.a, cut.b FROM q JOIN cut ON q.b = cut.a)
  SELECT a::BIGINT AS a, b::BIGINT AS b, -1::BIGINT AS diff FROM (SELECT * FROM r EXCEPT SELECT * FROM q)""")
def delta_iterate(spark, sf):
    """The change of a closure over a tree of nations when one edge goes."""
    store = TraceStore(spark)
    store.register("edge", Schema.of(("a", Ty.INT), ("b", Ty.INT)))
    store.commit([("edge", (k, (k - 1) // 2), 1) for k, _ in _nations(spark, sf) if k > 0])
    store.commit([("edge", (5, 2), -1)])
    return Interval(store, 1, 2).delta(_closure(), ["a", "b"]).withColumnRenamed("__diff", "diff")


@query("SELECT n_regionkey::BIGINT AS region, count(*)::BIGINT AS n, 1::BIGINT AS diff FROM nation GROUP BY 1")
def polled_view(spark, sf):
    """All changes that polls of a stream bring, added up: the fresh counts per region; a quiet poll brings nothing."""
    from .plans.delta import DeltaStream
    from .plans.local import consolidate

    store = TraceStore(spark)
    store.register("nation", Schema.of(("key", Ty.INT), ("region", Ty.INT)))
    stream = DeltaStream(store, rel("nation").reduce([1], Agg("count")))
    seen = stream.poll()
    rows = sorted((int(r[0]), int(r[1])) for r in table(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect())
    for part in (rows[:9], rows[9:]):
        store.commit([("nation", r, 1) for r in part])
        seen += stream.poll()
        assert stream.poll() == []
    return _sum_of(spark, [(*r, d) for r, d in consolidate(seen)], "region long, n long, diff long")
