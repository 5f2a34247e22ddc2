"""Aggregation: folds with identities, roll-ups along a grain, salted and sketched variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("day", "month", "quarter", "year")

FOLDS: dict[str, tuple[Callable[[Column], Column], object]] = {
    "sum": (F.sum, 0),
    "count": (F.count, 0),
    "min": (F.min, None),
    "max": (F.max, None),
    "product": (F.product, 1.0),
    "concat": (lambda c: F.array_join(F.array_sort(F.collect_list(c)), ","), ""),
    "list": (lambda c: F.array_sort(F.collect_list(c)), None),
}


def aggregate_all(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[a.alias(n) for n, a in aggs.items()])


def aggregate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def fold(df: DataFrame, keys: Sequence[str], column: str, name: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(FOLDS[name][0](F.col(column)).alias(out))


def fold_or_identity(df: DataFrame, keys: Sequence[str], spine: DataFrame, column: str, name: str, out: str) -> DataFrame:
    """A fold for every key of ``spine``; keys without rows get the fold's identity (min, max: null)."""
    folded = spine.select(*keys).distinct().join(fold(df, keys, column, name, out), list(keys), "left")
    identity = FOLDS[name][1]
    return folded if identity is None else folded.withColumn(out, F.coalesce(out, F.lit(identity)))


def collect(df: DataFrame, keys: Sequence[str], column: str, order: str, out: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(order, column)))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r[column]).alias(out))


def rollup_levels(df: DataFrame, date: str, dims: Sequence[str], value: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Sum, count and average at every level, each from the partial sums of the finer one; finer after coarser is an error."""
    if list(levels) != sorted(levels, key=LEVELS.index):
        raise ValueError("levels must go from fine to coarse")
    current = df.select(*dims, F.date_trunc(levels[0], date).alias("period"), F.col(value).cast("decimal(38,2)").alias("s"), F.when(F.col(value).isNotNull(), 1).otherwise(0).alias("n"))
    out = None
    for level in levels:
        current = current.withColumn("period", F.date_trunc(level, "period")).groupBy(*dims, "period").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        part = current.select(*dims, F.lit(level).alias("level"), F.col("period").cast("date").alias("period"), F.col("s").cast("double").alias("total"), F.col("n").alias("n"), F.when(F.col("n") > 0, F.col("s").cast("double") / F.col("n")).alias("average"))
        out = part if out is None else out.unionByName(part)
    return out


def levels_report(df: DataFrame, dims: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return df.rollup(*dims).agg(*[a.alias(n) for n, a in aggs.items()], F.grouping_id().alias("level"))


def salted_aggregate(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str], n: int, row_key: Sequence[str]) -> DataFrame:
    """Sums and counts in two stages; the salt is a column of its own, so keys keep their type."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(n)))
    first = salted.groupBy(*keys, "_salt").agg(*[F.sum(c).alias(o) for o, c in sums.items()], F.count(F.lit(1)).alias("n"))
    return first.groupBy(*keys).agg(*[F.sum(o).alias(o) for o in sums], F.sum("n").alias("n"))


def aggregate_bucketed(df: DataFrame, name: str, keys: Sequence[str], aggs: Mapping[str, Column], buckets: int = 8) -> DataFrame:
    """Aggregate a table bucketed by its keys: the plan needs no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).saveAsTable(name)
    return df.sparkSession.table(name).groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def align_and_combine(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], formula: Mapping[str, Column]) -> DataFrame:
    """Bring the fine attribute to the coarse grain first, then combine on the same key."""
    return aggregate(fine, keys, aggs).join(coarse, list(keys)).select(*keys, *[c.alias(n) for n, c in formula.items()])


def grain_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def approx_distinct(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Exact and estimated distinct counts and the relative error, from a mergeable sketch."""
    out = df.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg(column)).alias("estimate"), F.count_distinct(column).alias("exact"))
    return out.withColumn("error", F.abs(F.col("estimate") - F.col("exact")) / F.greatest("exact", F.lit(1)))


def approx_quantiles(df: DataFrame, keys: Sequence[str], column: str, quantiles: Sequence[float]) -> DataFrame:
    """Quantiles of each group from a mergeable summary of bounded size; ranks are right to a ten-thousandth."""
    return df.groupBy(*keys).agg(*[F.percentile_approx(column, q, 10_000).alias(f"p{round(q * 100)}") for q in quantiles])


def sketch_rollup(df: DataFrame, ts: str, column: str) -> DataFrame:
    """Daily sketches merged to months, beside the exact count."""
    daily = df.groupBy(F.date_trunc("day", ts).alias("day")).agg(F.hll_sketch_agg(column).alias("sketch"))
    monthly = daily.groupBy(F.date_trunc("month", "day").alias("month")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = df.groupBy(F.date_trunc("month", ts).alias("month")).agg(F.count_distinct(column).alias("exact"))
    return monthly.join(exact, "month").withColumn("error", F.abs(F.col("estimate") - F.col("exact")) / F.greatest("exact", F.lit(1)))


def custom_fold(df: DataFrame, key: str, column: str, combine: Callable[[float, float], float], zero: float) -> DataFrame:
    """A user's associative fold: partial values for each partition and key, then one merge a key."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for k, v in zip(pdf[key], pdf[column], strict=True):
                held[k] = combine(held.get(k, zero), v)
        yield pd.DataFrame({key: list(held), "value": list(held.values())})

    def merge(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = zero
        for v in pdf["value"]:
            total = combine(total, v)
        return pd.DataFrame({key: [k[0]], "value": [total]})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, value double"
    return df.select(key, column).mapInPandas(partial, schema).groupBy(key).applyInPandas(merge, schema)


def pivot(df: DataFrame, keys: Sequence[str], column: str, agg: Column, values: Sequence) -> DataFrame:
    return df.groupBy(*keys).pivot(column, list(values)).agg(agg)
