from __future__ import annotations

import pytest

from tidelog.lang.program import Program
from tidelog.plans import ir
from tidelog.plans.find import Snapshot
from tidelog.process.branches import Branches
from tidelog.process.patch import Denied, Patch, commit_patch
from tidelog.process.stored import check_grants, code_check, dispatch, from_code, to_code
from tidelog.process.template import instance
from tidelog.sources.store import BelowWatermark, TraceStore
from tidelog.streaming import DeltaTable, append, log_stream, maintain
from tidelog.types import Ent, Schema, Ty

SOURCE = """
rel located(thing: Ent, place: Ent) rel secret(x: Int)
rel direct(entity: Ent, behavior: Code) rel prototype(child: Ent, parent: Ent) rel inbox(p: Ent, s: Int, b: Tuple)
form f { "go" place -> Go(place) }
on inbox parse f { match Go(place) { find located(self, old) let n = 1 + 2 if n == 3 || false { retract located(self, old) assert located(self, 9) } else { assert secret(-n) } } }
requires allocate things(counter: counter, first: 10, last: 20)
"""


def test_branches():
    main = TraceStore()
    main.commit([("r", (1,), 1)])
    b = Branches(main)
    one = b.branch("one", "main")
    one.commit([("r", (2,), 1)])
    b.branch("two", "one")
    b.branch("three", "main", 1)
    assert b.descends_from("two", "main") and not b.descends_from("three", "one")
    assert b.common_ancestor("two", "three") == "main" and b.lineage("two") == ["two", "one", "main"]
    assert b.open("two").local("r") == [((1,), 1), ((2,), 1)] and main.local("r") == [((1,), 1)]
    b.adopt("three", "two", 2)
    with pytest.raises(ValueError):
        b.adopt("main", "three", 2)


def test_stored_behaviours():
    p, s = Program(SOURCE), TraceStore()
    arm = p.ons["inbox"].arms[0]
    code = to_code(arm)
    assert from_code(code) == arm
    s.commit([("direct", (Ent(1), code), 1), ("prototype", (Ent(2), Ent(1)), 1), ("located", (Ent(2), Ent(5)), 1)])
    patch = dispatch(p, s, s.current, Ent(2), ("Go", "x"))
    assert patch.asserts == [("located", (Ent(2), Ent(9)))] and patch.retracts == [("located", (Ent(2), Ent(5)))]
    assert dispatch(p, s, s.current, Ent(3), ("Go", "x")).is_empty()
    commit_patch(s, Patch(asserts=[("direct", (Ent(4), code))]), code_check=code_check(p, {"located", "secret"}))
    with pytest.raises(Denied):
        commit_patch(s, Patch(asserts=[("direct", (Ent(4), code))]), code_check=code_check(p, {"located"}))
    check_grants(p, {"things": {"first": 0, "last": 99}})
    for bad in ({}, {"things": {"last": 15}}, {"things": {}, "more": {}}):
        with pytest.raises(Denied):
            check_grants(p, bad)


def test_instances_shift_every_entity():
    assert instance([((Ent(10), "a", (Ent(11), 3)), 1), ((Ent(50), "b", ()), 1)], 10, 20, 100) == [((Ent(100), "a", (Ent(101), 3)), 1)]


def test_editions_over_many_batches_count_once(spark, tmp_path):
    schema = Schema.of(("a", Ty.INT), ("b", Ty.INT))
    cols = "c0 long, c1 long, __edition long, __submit long, __diff long"
    plan, sink = ir.rel("r").project(0), DeltaTable(spark, f"{tmp_path}/view")
    rows = [(k % 3, k, 1 + k // 12, k, 1 if k % 4 else -1) for k in range(40)]
    for k, part in enumerate((rows[i : i + 2] for i in range(0, 40, 2))):  # an edition lies in six files
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    for _ in range(2):  # the second time, nothing is left
        maintain(log_stream(spark, f"{tmp_path}/log", schema, 1), "r", f"{tmp_path}/log", schema, plan, sink, f"{tmp_path}/offsets", ["a"]).awaitTermination()
    want = {a: sum(r[4] for r in rows if r[0] == a) for a in range(3)}
    assert {r["a"]: r["__diff"] for r in sink.rows().collect()} == {a: n for a, n in want.items() if n}


def test_a_fold_schemas_and_tables_survive_reopening(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "s"))
    store.register("r", Schema.of(("a", Ty.INT)))
    for d in (1, 1, -1):
        store.commit([("r", (1,), d)])
    store.commit([("r", (2,), 1)])
    store.consolidate(3)
    spark.createDataFrame([(5, 1, 0, 1)], "c0 long, __edition long, __submit long, __diff long").write.parquet(f"{tmp_path}/t")
    store.bulk("t", spark.read.parquet(f"{tmp_path}/t"), Schema.of(("k", Ty.INT)), path=f"{tmp_path}/t")
    again = TraceStore(spark, str(tmp_path / "s"))
    assert again.dump() == store.dump() and (again.current, again.watermark) == (4, 3) and again.columns("r") == ["a"]
    assert again.local("r") == [((1,), 1), ((2,), 1)] and [r["c0"] for r in again.log("t").collect()] == [5]
    with pytest.raises(BelowWatermark):
        again.local("r", 2)
    assert again.commit([("r", (3,), 1)]) == 5 and again.holds("r", (3,))


def test_cells_of_any_kind(spark):
    store = TraceStore(spark)
    store.register("r", Schema.of(("a", Ty.ANY), ("b", Ty.INT)))
    store.commit([("r", (1, 1), 1), ("r", ("1", 1), 1), ("r", (2, 1), 1), ("r", (4, 4), 1)])
    same = ir.Filter(ir.rel("r"), ir.Eq(ir.Col(0), ir.Col(1)))
    assert [r for r, _ in Snapshot(store).rows(same)] == [(1, 1), (4, 4)]
    assert [r for r, _ in Snapshot(store).rows(ir.rel("r").reduce([1], ir.Agg("sum", 0)))] == [(1, 3), (4, 4)]


def test_streamed_view_equals_find(spark, tmp_path):
    schema = Schema.of(("a", Ty.INT), ("b", Ty.INT))
    cols = "c0 long, c1 long, __edition long, __submit long, __diff long"
    plan, sink = ir.rel("r").project(0).distinct(), DeltaTable(spark, f"{tmp_path}/view")
    for rows in ([(1, 1, 1, 0, 1), (2, 1, 1, 1, 1)], [(1, 2, 2, 0, 1), (2, 1, 2, 1, -1)], [(1, 1, 3, 0, -1), (3, 0, 3, 1, 1)]):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        maintain(log_stream(spark, f"{tmp_path}/log", schema), "r", f"{tmp_path}/log", schema, plan, sink, f"{tmp_path}/offsets", ["a"]).awaitTermination()
    assert sorted(r["a"] for r in sink.rows().collect()) == [1, 3]
    q = append(log_stream(spark, f"{tmp_path}/log", schema), "r", schema, ir.rel("r").where_eq(0, 1).project(1), ["b"])
    q.writeStream.format("memory").queryName("appended").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("appended").count() == 3
    with pytest.raises(ValueError):
        append(log_stream(spark, f"{tmp_path}/log", schema), "r", schema, plan.negate())
