"""Operators without a SQL twin against plain computation, and checks in a case that must fail."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import aggregates as G
from plumbline.operators import errors as E
from plumbline.operators import fidelity as K
from plumbline.operators import lineage as L
from plumbline.operators import quality as Q
from plumbline.sources import tables as A


def test_approximate_quantiles_lie_near_the_exact_ones(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    got = {r.o_orderstatus: r for r in G.approx_quantiles(orders, ["o_orderstatus"], "o_totalprice", [0.1, 0.5, 0.9]).collect()}
    for status, own in orders.select("o_orderstatus", "o_totalprice").toPandas().groupby("o_orderstatus").o_totalprice:
        for q in (0.1, 0.5, 0.9):
            assert abs((own <= got[status][f"p{round(q * 100)}"]).mean() - q) < 0.01


def test_sample_check_covers_the_true_mean(spark):
    a = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"))
    b = a.withColumn("v", F.col("v") - 2.0 - F.pmod("k", F.lit(3)) * 0.01)
    r = K.sample_check(a, b, "k", "v", 20).first()
    assert r.low <= 2.01 <= r.high and 800 < r.n < 1200
    same = K.sample_check(a, a, "k", "v", 20).first()
    assert same["mean"] == 0 and same.low == same.high == 0


def test_fingerprint_sees_content_but_not_order(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    one = K.fingerprint(df).first()
    assert one == K.fingerprint(df.repartition(5).orderBy(F.desc("id"))).first()
    assert one.digest != K.fingerprint(df.withColumn("x", F.when(F.col("id") == 5, 9).otherwise(F.col("x")))).first().digest
    assert one.digest != K.fingerprint(df.unionByName(df.limit(2))).first().digest


def test_sampled_lineage_is_a_hundredth_and_repeats(spark):
    pairs = spark.range(20_000).select((F.col("id") % 50).alias("t"), F.col("id").alias("source_key"))
    got = {r.source_key for r in L.capture_lineage(pairs, "t", "SAMPLED").collect()}
    assert 120 < len(got) < 280 and got == {r.source_key for r in L.capture_lineage(pairs.repartition(7), "t", "SAMPLED").collect()}


def test_rebuild_finds_uncaptured_and_lost_keys(spark):
    source = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (5, "b")], "k int, t string")
    captured = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5), ("c", 9)], "t string, source_key int")
    got = {r.t: (r.inside, r.n, r.complete) for r in L.rebuild_from_envelopes(source, "k", L.capture_lineage(captured, "t", "KEY_DERIVABLE"), "t").collect()}
    assert got == {"a": (3, 2, False), "b": (1, 1, True), "c": (0, 1, False)}


def test_sync_fails_on_conflict(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    a, b = base.withColumn("v", F.lit("p")), base.withColumn("v", F.lit("q"))
    with pytest.raises(PySparkException):
        K.sync(base, a, b, "k", "v", "FAIL").collect()
    assert {r.merged for r in K.sync(base, a, base, "k", "v", "FAIL").collect()} == {"p"}


def test_ledger_shows_a_discrepancy(spark):
    row = E.ledger(spark.range(10_000), {"processed": spark.range(8000), "filtered": spark.range(2000), "errored": spark.range(0)}).first()
    assert row.balanced and row.discrepancy == 0
    row = E.ledger(spark.range(100), {"processed": spark.range(90), "errored": spark.range(5)}).first()
    assert not row.balanced and row.discrepancy == 5


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([("1", None), ("22", None), (None, None), ("1", None)], "a string, b string")
    got = {r.column_name: r for r in Q.profile(df, ["a", "b"]).collect()}
    assert (got["a"].inferred_type, got["a"].n_distinct, got["a"].top_value, got["a"].top_count, got["a"].null_rate) == ("bigint", 2, "1", 2, 0.25)
    assert (got["b"].inferred_type, got["b"].n_distinct, got["b"].top_value, got["b"].null_rate) == (None, 0, None, 1.0)


def test_upsert_takes_only_what_is_newer(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 7, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 6, "late"), (2, 8, "new"), (3, 9, "more")], "k int, at int, v string")
    assert sorted(r.v for r in A.merge_since(old, new, ["k"], "at").collect()) == ["a", "more", "new"]
    assert A.merge_since(old.limit(0), new, ["k"], "at").count() == 3
