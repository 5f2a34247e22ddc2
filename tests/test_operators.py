"""Golden values, boundary cases and laws of the operators."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import aggregates as G
from plumbline.operators import errors as E
from plumbline.operators import joins as J
from plumbline.operators import lineage as L
from plumbline.operators import quality as Q
from plumbline.operators import windows as W
from plumbline.plans import eventlog as M
from plumbline.sources import tables as A


@pytest.mark.parametrize("errors,total,kw,halt", [(250, 10000, {"share": 0.02}, True), (120, 10000, {"absolute": 100}, True), (100, 10000, {"share": 0.05}, False), (10, 100, {"share": 0.1}, False), (2, 10, {"share": 0.1}, True), (0, 0, {"share": 0.01}, False)])
def test_threshold(spark, errors, total, kw, halt):
    assert spark.range(1).select(E.threshold(errors, total, **kw)).first()[0] is halt


@pytest.mark.parametrize("bad,tripped", [(100, False), (1000, True), (500, False)])
def test_circuit_breaker(spark, bad, tripped):
    df = spark.range(10000)
    assert E.circuit_breaker(df, F.col("id") >= bad, "id").first().tripped is tripped


def test_circuit_breaker_empty(spark):
    assert E.circuit_breaker(spark.range(0), F.col("id") > 0, "id").first().tripped is False


@pytest.mark.parametrize("p,f,e", [(10000, 0, 0), (9500, 300, 200), (0, 0, 10000)])
def test_ledger_balances(spark, p, f, e):
    row = E.ledger(spark.range(10000), {"processed": spark.range(p), "filtered": spark.range(f), "errored": spark.range(e)}).first()
    assert row.balanced and row.discrepancy == 0


def test_null_predicate_fails_once(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id long, v double")
    ok, bad = E.split_valid(df, F.col("v") > 0, "id")
    assert [r.id for r in ok.collect()] == [1] and sorted(r.source_key for r in bad.collect()) == ["2", "3"]


def test_backward(spark):
    rev = spark.createDataFrame([("pos_A", f"t{i}") for i in (1, 2, 3)] + [("pos_B", f"t{i}") for i in (4, 5)], "target string, source_key string")
    keys = spark.createDataFrame([("pos_A",), ("pos_B",)], "target string")
    assert sorted(r[0] for r in L.backward(keys, rev, ["target"]).collect()) == ["t1", "t2", "t3", "t4", "t5"]
    assert L.reconcile(spark.createDataFrame([("t1",), ("t9",)], "k string"), rev, "k").collect()[0][0] == "t9"


def test_late_event(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 23:55:00' as ts, timestamp_ntz'2024-01-02 04:30:00' as p union all select timestamp_ntz'2024-01-01 23:55:00', timestamp_ntz'2024-01-02 03:59:00'")
    assert [r.late for r in Q.mark_late(df, "ts", "p", 2, 2).orderBy(F.desc("p")).collect()] == [True, False]


@pytest.mark.parametrize("strategy,route", [("REJECT", "ERROR"), ("REPROCESS", "REOPEN"), ("ACCUMULATE", "NEXT_EPOCH"), ("BACKFILL", "BACKFILL")])
def test_late_routes_lose_nothing(spark, strategy, route):
    df = spark.sql("select timestamp_ntz'2024-01-01 23:55:00' as ts, timestamp_ntz'2024-01-02 04:30:00' as processed_at union all select timestamp_ntz'2024-01-01 10:00:00', timestamp_ntz'2024-01-01 10:01:00'")
    assert sorted(r.route for r in Q.route_late(Q.mark_late(df, "ts", "processed_at", 2, 2), strategy).collect()) == sorted(["CURRENT", route])


def test_running_and_lag(spark):
    df = spark.createDataFrame([("a", 1, 100), ("a", 2, 200), ("a", 3, 150)], "k string, t int, v int")
    out = W.shift(W.running(df, ["k"], ["t"], "sum", "v", "run"), ["k"], ["t"], "v", 1, None, "before").orderBy("t").collect()
    assert [r.run for r in out] == [100, 300, 450] and [r.before for r in out] == [None, 100, 200]
    with pytest.raises(ValueError):
        W.running(df, [], ["t"], "sum", "v", "run")


def test_density(spark):
    rows = [(f"2024-01-01 00:00:{i:02d}",) for i in range(10)] + [("2024-01-01 01:00:00",)]
    df = spark.createDataFrame(rows, "ts string").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    d = [r.density for r in M.event_density(df, "ts", 10).orderBy("bucket").collect()]
    assert d[0] == 1.0 and d[5] == 0.0 and 0 < d[9] < 0.2


def test_identity_and_fold(spark):
    spine = spark.createDataFrame([("a",), ("b",)], "k string")
    df = spark.createDataFrame([("a", 2), ("a", 3), ("a", None)], "k string, v int")
    got = {r.k: r.s for r in G.fold_or_identity(df, ["k"], spine, "v", "sum", "s").collect()}
    assert got == {"a": 5, "b": 0}
    assert {r.k: r.s for r in G.fold_or_identity(df, ["k"], spine, "v", "min", "s").collect()} == {"a": 2, "b": None}


def test_salted_equals_plain(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "k long, n string")
    a = sorted(map(tuple, left.join(right, "k").select("k", "id", "n").collect()))
    assert a == sorted(map(tuple, J.salted_join(left, right, "k", 4, ["id"]).select("k", "id", "n").collect()))
    assert {r.k: (r.s, r.n) for r in G.salted_aggregate(left, ["k"], {"s": "id"}, 4, ["id"]).collect()} == {r.k: (r.s, r.n) for r in left.groupBy("k").agg(F.sum("id").alias("s"), F.count("*").alias("n")).collect()}


def test_bucketed_plan_has_no_exchange(spark):
    df = G.aggregate_bucketed(spark.range(100).withColumn("k", F.col("id") % 5), "bucketed_test", ["k"], {"n": F.count(F.lit(1))})
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5
    spark.sql("drop table bucketed_test")


def test_rollup_rejects_coarse_to_fine(spark):
    with pytest.raises(ValueError):
        G.rollup_levels(spark.sql("select timestamp_ntz'2024-01-01' as d, 1.0 as v"), "d", [], "v", ["month", "day"])


def test_temporal_overlap_and_unversioned(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' as ts")
    with pytest.raises(ValueError):
        A.read_temporal([(df, "2024-01-01", "2024-01-10"), (df, "2024-01-05", "2024-02-01")], "ts", "2024-01-01", "2024-01-31")
    with pytest.raises(ValueError):
        A.read_lookup(df, "ts")


def test_n1_rejects_ambiguous_target(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        J.traverse_n1(spark.createDataFrame([(1,)], "a int"), df, F.expr("a = k"), "k")


def test_safe_cast_and_fallback(spark):
    df = spark.createDataFrame([(1, "5", None), (2, "x", "y"), (3, None, None)], "id int, a string, b string")
    ok, bad = S.safe_cast(df, "a", "int", "id")
    assert sorted(r.id for r in ok.collect()) == [1, 3] and bad.first().source_key == "2"
    assert S.fallback(df, ["a", "b"], "v", "id")[1].first().source_key == "3"


def test_uuid5(spark):
    import uuid

    df = S.uuid5_key(spark.createDataFrame([("x",), ("y",)], "k string"), ["k"], uuid.NAMESPACE_DNS.hex)
    assert {r.k: r.uuid for r in df.collect()} == {k: str(uuid.uuid5(uuid.NAMESPACE_DNS, k)) for k in "xy"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int")
    A.write_result(df, str(tmp_path / "r"), ["p"])
    A.write_result(df.where("p = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "r"), ["p"])
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [2, 9]
    _, bad = E.split_valid(df, F.col("v") > 1, "v")
    A.write_errors(bad.drop("context"), str(tmp_path / "e"), "json")
    assert spark.read.json(str(tmp_path / "e")).count() == 1
    assert E.commit_if(df, True, str(tmp_path / "s"), str(tmp_path / "p")) is False


def test_hierarchy_orphans_and_depth(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 77)], "id long, parent long")
    assert {r.id: (r.root, r.depth) for r in M.hierarchy(df, "id", "parent", 5).collect()} == {1: (1, 1), 2: (1, 2), 3: (1, 3), 9: (9, 1)}


def test_hierarchy_reaches_far_roots_and_leaves_cycles_out(spark):
    rows = [(i, i - 1) for i in range(1, 60)] + [(0, None), (100, 101), (101, 102), (102, 100), (103, 100), (200, 0)]
    got = {r.id: (r.root, r.depth) for r in M.hierarchy(spark.createDataFrame(rows, "id long, parent long"), "id", "parent", 5).collect()}
    assert got == {i: (0, i + 1) for i in range(60)} | {200: (0, 2)}


def test_a_bare_year_is_no_date(spark):
    values = ["1510", "12345", "2024-01", "2024-01-02", "2024-1-2", "2024-01-02T00:00:00", "2024-13-02", "1.5", "1.5d", "yes", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    r = A.infer_types(df, ["v"]).first()
    assert (r.n, r.n_bigint, r.n_double, r.n_date, r.n_boolean) == (10, 2, 3, 3, 1)
