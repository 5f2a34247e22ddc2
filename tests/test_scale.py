"""What is to hold at scale: hot keys, exact selection, compact reverse tables, atomic publishing, exactly-once batches."""

import random

import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import errors as E
from plumbline.operators import fidelity as K
from plumbline.operators import joins as J
from plumbline.operators import lineage as L
from plumbline.operators import quality as Q
from plumbline.operators import segments, selection
from plumbline.operators import windows as W
from plumbline.plans import eventlog as M
from plumbline.sources import publish as P
from plumbline.sources import tables as A


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows on one key, some without a key or a time, ties in time."""
    r = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{r.randint(0, 40)}", None if i % 97 == 0 else r.randint(0, 900), r.choice([None, 1, 2, 5])) for i in range(6000)]
    return spark.createDataFrame(rows, "id long, k string, t long, v long").repartition(6)


@pytest.mark.parametrize("function", ["sum", "count", "avg", "min", "max"])
def test_segmented_running_values(hot, function):
    plain = W.running(hot, ["k"], ["t", "id"], function, "v", "out")
    assert rows_of(W.running(hot, ["k"], ["t", "id"], function, "v", "out", rows=100), "id", "out") == rows_of(plain, "id", "out")


def test_several_running_values_in_one_pass(hot, monkeypatch):
    values = {f: (f, "v") for f in ("sum", "count", "avg", "min", "max")}
    plain = hot
    for f in values:
        plain = W.running(plain, ["k"], ["t", "id"], f, "v", f)
    for sent in (segments.SENT_BYTES, 0):  # bucket results sent to all tasks, or shuffled
        monkeypatch.setattr(segments, "SENT_BYTES", sent)
        got = W.running_many(hot, ["k"], ["t", "id"], values, rows=100)
        assert rows_of(got, "id", *values) == rows_of(plain, "id", *values)
        if sent:  # no table is shuffled for a join
            assert executed(got).count("SortMergeJoin") == 0 and executed(got).count("Window") >= 1


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_are_small(hot):
    parts = segments.cut(hot, ["k"], "t", 100)
    sizes = {(r.k, r._bucket): r.n for r in parts.groupBy("k", "_bucket").agg(F.count("*").alias("n")).collect()}
    assert sum(n for n in sizes.values()) == 6000 and max(sizes.values()) <= 130 and len([1 for k, _ in sizes if k == "hot"]) > 15
    assert parts.groupBy("k").agg(F.count_distinct("_bucket").alias("n")).where("k = 'k1'").first().n <= 2
    order = parts.groupBy("k", "_bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    w = Window.partitionBy("k").orderBy("_bucket")
    assert order.withColumn("prior", F.lag("hi").over(w)).where("prior > lo").count() == 0
    assert segments.cut(hot, ["k"], "t", 10_000) is None


def test_no_task_sorts_more_than_one_bucket(spark, hot):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        def largest_task(**more):
            out = W.running(hot, ["k"], ["t", "id"], "sum", "v", "out", **more)
            tasks = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("out"))
            return max(r.n for r in tasks.collect())

        largest, plain = largest_task(rows=100), largest_task()
        assert largest < 600 and plain >= 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("kind", ["long", "timestamp_ntz", "date", "double"])
def test_segmented_asof(spark, hot, kind):
    at = {"long": F.col("t"), "double": F.col("t") / 7, "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("t").cast("int")), "timestamp_ntz": F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, t)")}[kind]
    left = hot.where("id % 2 = 0").select("id", "k", at.alias("at"))
    history = hot.where("id % 2 = 1").groupBy("k", "t").agg(F.max("id").alias("version")).select("k", at.alias("since"), "version")
    plain = J.asof_last(left, history, "k", "at", "since", ["version"])
    assert rows_of(J.asof_last(left, history, "k", "at", "since", ["version"], rows=100), "id", "version") == rows_of(plain, "id", "version")
    assert plain.where("at is null and version is not null").count() == 0 and plain.where("version is not null").count() > 1000


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 5), (4, "b", 1)], "id int, k string, at int")
    history = spark.createDataFrame([("a", None, "x"), ("a", 5, "y"), (None, 1, "z"), ("b", 2, "w")], "k string, since int, v string")
    got = {r.id: r.v for r in J.asof_last(left, history, "k", "at", "since", ["v"]).collect()}
    assert got == {1: "y", 2: None, 3: "z", 4: None}
    assert J.asof_last(left.limit(0), history, "k", "at", "since", ["v"]).count() == 0


def test_segmented_islands(spark):
    r = random.Random(2)
    pairs = [("hot", i) for i in range(5000) if i % 700 and r.random() < 0.97] + [("cold", i) for i in (1, 2, 9)] + [(None, 4), (None, 5)]
    df = spark.createDataFrame(pairs + pairs[:50], "target string, source_key long")
    columns = ("target", "start_key", "end_key", "n")
    assert rows_of(L.islands(df, "target", rows=64), *columns) == rows_of(L.islands(df, "target"), *columns)


def test_segmented_followups(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    columns = ("user_id", "turn", "event_id", "has_view", "complete")
    assert rows_of(M.followups(events, "click", ["view"], rows=5), *columns) == rows_of(M.followups(events, "click", ["view"]), *columns)


def test_selection(spark):
    r = random.Random(3)
    rows = [(r.gauss(0, 1), float(r.randint(0, 3)), None if i % 10 else float(i), None, 7.0) for i in range(20_000)] + [(float("nan"), None, float("nan"), None, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    fractions = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    names = ["a", "b", "c", "d", "e"]
    plain = df.agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.array(*map(F.lit, fractions))).alias(c) for c in names]).first()
    for few in (20, 500, 20_000):
        got = selection.percentiles(df, names, fractions, few)
        assert all(got[c, f] == (pytest.approx(plain[c][i]) if plain[c] is not None else None) for c in names for i, f in enumerate(fractions))


def test_field_metrics_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, 2), (2.0, None, 2), (None, None, 3)], "a double, b double, c int")
    got = {r.column_name: r for r in Q.field_metrics(df, ["a", "b", "c"]).collect()}
    assert (got["a"].n_distinct, got["a"].median, got["a"].null_rate) == (2, 1.5, 1 / 3)
    assert (got["b"].n_distinct, got["b"].median, got["b"].low) == (0, None, None)
    assert (got["c"].n_distinct, got["c"].median) == (2, 2.0)
    assert Q.field_metrics(df.limit(0), ["a"]).first().n == 0


def test_drift_flags(spark):
    base = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id") % 50).cast("double").alias("v"))
    now = spark.range(1000).select(F.when(F.col("id") % 4 != 0, F.col("id") % 500).cast("double").alias("v"))
    got = {r.metric: r for r in Q.drift_flags(base, now, "v", 0.2, 0.2, 0.5, 0.1).collect()}
    assert {m: r.flagged for m, r in got.items()} == {"null_rate_max": True, "null_rate_change": False, "cardinality_change": True, "percentile_99_change": True}
    assert not any(r.flagged for r in Q.drift_flags(base, base, "v", 0.2, 0.2, 0.5, 0.1).collect())
    empty = {r.metric: r.flagged for r in Q.drift_flags(base, now.limit(0), "v", 0.2, 0.2, 0.5, 0.1).collect()}
    assert empty["cardinality_change"] and empty["percentile_99_change"]


@pytest.mark.parametrize("form", ["PAIRS", "RANGES", "ARRAY", "BITMAP"])
def test_reverse_table_forms(spark, form):
    r = random.Random(4)
    pairs = [(f"t{r.randint(0, 5)}", r.choice([r.randint(0, 99), r.randint(0, 200_000), -r.randint(1, 40_000)])) for _ in range(3000)]
    df = spark.createDataFrame(pairs + pairs[:100], "target string, source_key long")
    assert rows_of(L.reverse_pairs(L.reverse_table(df, "target", form), "target", form), "target", "source_key") == sorted(set(pairs), key=str)


def test_reverse_table_upkeep(spark):
    df = spark.createDataFrame([("a", k) for k in range(40_000)], "target string, source_key long")
    first, second = (L.reverse_table(df.where(c), "target", "BITMAP") for c in ("source_key % 2 = 0", "source_key % 3 = 0"))
    both = L.reverse_pairs(L.merged_bitmaps([first, second], "target"), "target", "BITMAP")
    assert both.count() == df.where("source_key % 2 = 0 or source_key % 3 = 0").count()
    sizes = {f: L.table_size(L.reverse_table(df, "target", f), c).first() for f, c in (("PAIRS", ["source_key"]), ("BITMAP", ["bits"]), ("ARRAY", ["offsets"]), ("RANGES", ["start_key", "end_key"]))}
    assert sizes["RANGES"].n_rows == 1 and sizes["BITMAP"].n_rows == 2 and sizes["BITMAP"].n_bytes < sizes["ARRAY"].n_bytes and sizes["PAIRS"].n_rows == 40_000
    aged = L.reverse_table(df.limit(3), "target", "PAIRS", F.when(F.col("source_key") > 0, F.make_timestamp(F.lit(2024), F.lit(1), F.col("source_key") * 10, F.lit(0), F.lit(0), F.lit(0))))
    assert sorted(r.source_key for r in L.prune(aged, F.lit("2024-01-25").cast("timestamp"), 10).collect()) == [0, 2]


def test_classes_compose(spark):
    df = spark.createDataFrame([("ISOMORPHISM", "EMBEDDING"), ("EMBEDDING", "PROJECTION"), ("ISOMORPHISM", "ISOMORPHISM"), ("PROJECTION", "PROJECTION"), ("ISOMORPHISM", None)], "a string, b string")
    assert [r[0] for r in df.select(L.composed_class(F.col("a"), F.col("b"))).collect()] == ["EMBEDDING", "LOSSY", "ISOMORPHISM", "PROJECTION", None]


def test_publishing_survives_a_failure(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, at)
    P.publish(spark.range(3), at, 1)
    assert P.read_published(spark, at).count() == 3 and P.current(spark, at)["mark"] == 1
    monkeypatch.setattr(E, "point", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        E.commit_if(spark.range(9), False, str(tmp_path / "s"), at)
    assert P.read_published(spark, at).count() == 3
    monkeypatch.undo()
    assert E.commit_if(spark.range(9), False, str(tmp_path / "s"), at) and not E.commit_if(spark.range(5), True, str(tmp_path / "s"), at)
    assert P.read_published(spark, at).count() == 9
    assert P.discard(spark, at) == 2 and P.read_published(spark, at).count() == 9


def test_telemetry_in_one_job(spark, folder):
    seen = E.Telemetry()
    orders = spark.read.parquet(f"{folder}/orders.parquet").withColumn("p", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")))
    good = seen.measured("filter", orders, lambda d: d.where("o_orderstatus = 'F'"), ["p"], F.col("p") > 100_000)
    out = seen.measured("explode", good, lambda d: d.select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    n = out.count()
    got = {(r.step, r.column_name): r for r in seen.rows(spark).collect()}
    kept = orders.where("o_orderstatus = 'F'")
    assert (got["filter", None].rows_in, got["filter", None].rows_out, got["explode", None].rows_out) == (orders.count(), kept.count(), n)
    assert got["filter", "p"].null_rate == kept.where("p is null").count() / kept.count()
    assert got["filter", None].violations == kept.where("not coalesce(p > 100000, false)").count()


def test_prior_lists(spark):
    rows = [(1, None), (2, []), (3, [1]), (4, [3, 2, 3]), (5, [4, 1]), (6, [6, 99]), (7, [8]), (8, [7]), (9, [7, 1]), (10, [5, 6])]
    got = sorted(map(tuple, M.prior_chains(spark.createDataFrame(rows, "id long, priors array<long>"), "id", "priors").collect()))
    assert got == [(1, 1, 1), (2, 2, 1), (3, 1, 2), (4, 1, 3), (4, 2, 3), (5, 1, 4), (5, 2, 4), (6, 6, 1), (10, 1, 5), (10, 2, 5), (10, 6, 5)]


def test_keys_differ(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None), ("~", "a"), ("a\\", "b"), ("a", "\\b"), ("a\\|b", "c")], "x string, y string")
    assert S.surrogate_key(df, ["x", "y"]).select("sk").distinct().count() == 8
    assert S.uuid5_key(df, ["x", "y"], "6ba7b8109dad11d180b400c04fd430c8").select("uuid").distinct().count() == 8


def test_null_keys_meet_themselves(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0)], "k string, v double")
    assert [r.status for r in J.compare(df, df, ["k"], ["v"]).collect()] == ["EQUAL", "EQUAL"]
    assert all(r.holds and r.gap == 0 for r in K.conservation(df, df, ["k"], "v", 0).collect()) and K.coverage(df, df, ["k"]).count() == 2
    assert E.account_keys(df, {"all": df}, "k").count() == 0
    assert K.sync(df, df, df, "k", "v", "FAIL").count() == 2 and K.merge_columns(df, df, df, "k", ["v"]).count() == 2


def test_closed_epochs_and_marks(spark):
    df = spark.sql("select id, timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int)) as ts from range(10)")
    assert sorted(r.id for r in A.read_temporal([(df, "2024-01-01", "2024-01-06"), (df, "2024-01-06", "2024-02-01")], "ts", "2024-01-03", "2024-01-08").collect()) == [2, 3, 4, 5, 6, 7]
    target = spark.createDataFrame([(1, 5, "a"), (2, 7, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 7, "same day"), (3, None, "bare"), (4, 3, "old"), (5, 9, "new")], "k int, at int, v string")
    assert sorted(r.v for r in A.merge_since(target, new, ["k"], "at").collect()) == ["b", "new", "same day"]
    assert sorted(r.source_key for r in A.overtaken(target, new, "k", "at").collect()) == ["3", "4"]
    aliases = spark.createDataFrame([("now", 5), ("now", 7), ("old", 3)], "alias string, version int")
    assert [r.k for r in A.read_alias(target, "at", aliases, "now").collect()] == [2]


def test_message_templates(spark):
    df = spark.createDataFrame([(1, -5.0), (2, None)], "id int, v double")
    rules = [E.Rule("positive", F.col("v") > 0, message="{v} of {id} is not {positive}")]
    assert sorted(r.message for r in E.apply_rules(df, rules, "id")[1].collect()) == ["-5.0 of 1 is not {positive}", "null of 2 is not {positive}"]


def test_an_observation_is_one_pass(spark):
    seen = Observation()
    spark.range(10).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 10


def exchanges(df):
    """Exchanges of the plan that Spark would run without changing it on the way."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_partitioning_for_several_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias(f"v{i}")).where(f"id < {100 * (i + 1)}") for i in range(4)]
        together = J.colocated(tables, "k", 8).groupBy("k").agg(F.count("*").alias("n"))
        assert exchanges(together) == 4  # the tables alone: neither the joins nor the aggregate above them deal again
        plain = tables[0]
        for t in tables[1:]:
            plain = plain.join(t, "k")
        assert rows_of(together, "k", "n") == rows_of(plain.groupBy("k").agg(F.count("*").alias("n")), "k", "n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_heavy_keys_without_a_shuffle_of_all_keys(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 7 == 0, F.col("id") % 5).otherwise(F.col("id")).alias("k"), (F.col("id") % 4).alias("day"))
    sketches = None
    for day in range(4):
        part = J.key_sketch(df.where(F.col("day") == day), "k", 1000)
        sketches = part if sketches is None else sketches.unionByName(part)
    got = J.heavy_keys(df, sketches, "k", 6, tracked=1000)
    assert rows_of(got, "k", "n", "hot") == rows_of(J.key_skew(df, "k", 6), "k", "n", "hot")
    assert sketches.selectExpr("octet_length(sketch.sketch) as b").agg(F.max("b")).first()[0] < 60_000
    assert exchanges(got) == 1  # of the candidates' counts


def test_heavy_keys_that_the_sketches_miss(spark):
    """More keys than a sketch tracks, all but one about as frequent, and rows without a key."""
    k = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 2003)
    df = spark.range(60_000).select(k.alias("k"))
    got = J.heavy_keys(df, J.key_sketch(df, "k", 100), "k", 10, tracked=100)
    want = df.groupBy("k").count().orderBy(F.desc("count"), F.asc_nulls_last("k")).limit(10)
    assert rows_of(got, "k", "n") == rows_of(want, "k", "count")


def test_a_bridge_is_dealt_by_its_rows(spark):
    left, target = spark.range(3000).select(F.col("id").alias("a")), spark.range(10).select(F.col("id").alias("p"), (F.col("id") % 3).alias("brand"))
    bridge = spark.range(20_000).select((F.col("id") % 3100).alias("k"), (F.col("id") % 12).alias("q"))
    on = F.expr("a = k"), F.expr("q = p")
    got = J.traverse_nm(left, bridge, target, *on, ("a", "k"), rows=1000)
    assert rows_of(got, *got.columns) == rows_of(J.traverse_nm(left, bridge, target, *on), *got.columns)
    tasks = got.groupBy("a", "brand").count().groupBy(F.spark_partition_id().alias("t")).agg(F.sum("count").alias("n")).collect()
    assert len(tasks) == 20 and max(r.n for r in tasks) < 1500


def test_missing_and_extra_keys_in_one_exchange(spark):
    total = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k long")
    parts = [spark.createDataFrame([(2,), (4,)], "k long"), spark.createDataFrame([(4,), (None,)], "k long")]
    got = W.missing_extra(total, parts, "k")
    assert rows_of(got, "k", "issue") == sorted([(1, "MISSING"), (3, "MISSING"), (4, "EXTRA"), (None, "MISSING"), (None, "EXTRA")], key=str)
    assert "Join" not in executed(got) and exchanges(got) == 1


def test_bounded_lookups(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString()

    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 10_000).alias("t"))
    assert hinted(J.bounded(wide)) and not hinted(J.bounded(wide, rows=10)) and not hinted(J.bounded(wide, size=1000))


def test_jdbc_in_partitions(spark):
    url, how = "jdbc:derby:memory:plumbline;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(1000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    df.write.jdbc(url, "orders_copy", mode="overwrite", properties=how)
    got = A.read_jdbc(spark, url, "orders_copy", "k", 4, how)
    assert got.rdd.getNumPartitions() == 4 and rows_of(got, "k", "name") == rows_of(df, "k", "name")
    some = got.where("k > 990").select("name")
    assert "PushedFilters: [*IsNotNull(k), *GreaterThan(k,990)]" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 9
    df.limit(0).write.jdbc(url, "empty_copy", mode="overwrite", properties=how)
    assert A.read_jdbc(spark, url, "empty_copy", "k", 4, how).count() == 0
