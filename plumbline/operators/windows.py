"""Window functions and set operations. Every window is partitioned; a total order over a whole table is refused."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .joins import tasks_for
from .segments import BUCKET_ROWS, running_all, running_sums

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
AGGS = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def over(keys: Sequence[str], order: Sequence[str | Column] = ()) -> WindowSpec:
    if not keys:
        raise ValueError("a window without a partition would run in one task")
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], function: str, out: str, n: int = 4) -> DataFrame:
    f = F.ntile(n) if function == "ntile" else RANKS[function]()
    return df.withColumn(out, f.over(over(keys, order)))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], function: str, column: str, out: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Running aggregate; a key of more than ``rows`` rows is scanned in segments along the first order column."""
    over(keys, order)  # refuses a window without keys
    return running_sums(df, keys, order, column, function, out, rows)


def running_many(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Mapping[str, tuple[str, str]], rows: int = BUCKET_ROWS) -> DataFrame:
    """Several ``running`` values (``out``: function and column) of one order, for one pass over the table."""
    over(keys, order)
    return running_all(df, keys, order, values, rows)


def moving(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, function: str, column: str, out: str) -> DataFrame:
    return df.withColumn(out, AGGS[function](column).over(over(keys, order).rowsBetween(-n, 0)))


def moving_range(df: DataFrame, keys: Sequence[str], order: Column, low: int, high: int, function: str, column: str, out: str) -> DataFrame:
    """``order`` is a number, such as seconds; the frame is a distance on it."""
    return df.withColumn(out, AGGS[function](column).over(over(keys, [order]).rangeBetween(low, high)))


def shift(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], column: str, n: int, default, out: str) -> DataFrame:
    f = F.lag(column, n, default) if n > 0 else F.lead(column, -n, default)
    return df.withColumn(out, f.over(over(keys, order)))


def edge_value(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], column: str, first: str, last: str) -> DataFrame:
    full = over(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(first, F.first(column).over(full)).withColumn(last, F.last(column).over(full))


def share_of_total(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(column) / F.sum(column).over(over(keys)))


def window_project(df: DataFrame, projections: Mapping[str, Column]) -> DataFrame:
    """Several windows in one projection; windows of one specification share a sort."""
    return df.select("*", *[c.alias(n) for n, c in projections.items()])


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int = 100) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def timeline(events: DataFrame, types: Sequence[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(list(types))).orderBy("ts", "event_id")


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "origin") -> DataFrame:
    out = None
    for name, df in parts.items():
        own = df.withColumn(tag, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def distinct_keys(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    out = dfs[0].select(key)
    for df in dfs[1:]:
        out = out.union(df.select(key))
    return out.distinct()


def missing_extra(total: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys of the total that no part has, and keys of the parts that the total lacks; a null key is in none but its own.

    Both sides are counted at once by key, dealt over as many tasks as their rows ask for.
    """
    both = total.select(F.col(key), F.lit(True).alias("_a"), F.lit(False).alias("_b"))
    for df in parts:
        both = both.unionByName(df.select(F.col(key), F.lit(False).alias("_a"), F.lit(True).alias("_b")))
    found = both.repartition(tasks_for(both), key).groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    none = F.col(key).isNull()
    issues = [F.when(F.col("_a") & (~F.col("_b") | none), "MISSING"), F.when(F.col("_b") & (~F.col("_a") | none), "EXTRA")]
    return found.select(key, F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
