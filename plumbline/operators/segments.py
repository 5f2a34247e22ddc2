"""Segmented scans: running values over long time lines, of which no task sorts more than one bucket.

A key with more rows than a bucket may hold is cut along its order column. Rows are counted by key and cell (a 65536th of
the whole span); running sums over a key's cells, which are few, number its buckets, so all buckets of a key hold about
as many rows. A scan then reduces each bucket to one row, scans those rows, and carries the result into the buckets.
Rows of one cell stay together: a key whose rows all have one time is not cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key beyond which it is cut, and rows that a bucket holds (its last cell may add to them).
BUCKET_ROWS = 1_000_000
CELLS = 1 << 16
#: Tables of cells and of bucket results are sent to all tasks up to about this many bytes; beyond, Spark shuffles.
SENT_BYTES = 64 << 20

TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def divisible(df: DataFrame, at: str | Column) -> bool:
    """Whether an order column can be cut: a number, a date or a time, in ascending order, by name."""
    return isinstance(at, str) and isinstance(df.schema[at].dataType, (T.NumericType, *TIMES))


def position(df: DataFrame, at: str) -> Column:
    kind = df.schema[at].dataType
    return F.unix_micros(F.col(at).cast("timestamp")).cast("double") if isinstance(kind, TIMES) else F.col(at).cast("double")


def cut(df: DataFrame, keys: Sequence[str], at: str, rows: int = BUCKET_ROWS) -> DataFrame | None:
    """``df`` with ``_bucket`` (0, 1, ... along ``at`` in each long key, 0 in all others), or None if no key is long.

    Two jobs decide that and find the span; only a few numbers reach the driver.
    """
    return _cut(df, keys, at, rows)[0]


def _cut(df: DataFrame, keys: Sequence[str], at: str, rows: int) -> tuple[DataFrame | None, bool]:
    """``cut``, and whether the results of all buckets are few enough to be sent to all tasks."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    width = F.octet_length(F.to_json(F.struct(*keys))) + 32
    long = counts.where(F.col("_n") > rows)
    many, held, wide = long.agg(F.count(F.lit(1)), F.sum("_n"), F.max(width)).first()
    if not many:
        return None, False
    x = position(df, at)
    finite = F.when(F.abs(x) < float("inf"), x)
    low, high = df.agg(F.min(finite), F.max(finite)).first()
    step = (high - low) / CELLS if low is not None and high > low else 1.0
    cell = F.least(F.lit(CELLS - 1), F.floor((finite - (low or 0.0)) / step))
    cell = F.when(x.isNull(), -1).when(finite.isNull(), F.when(x > 0, CELLS).otherwise(0)).otherwise(cell).cast("int")
    placed = df.withColumn("_cell", cell)
    few = many * (CELLS + 2) * wide <= SENT_BYTES
    own = placed
    if few:  # rows of other keys need not be counted by cell
        own = placed.join(F.broadcast(renamed(long, keys).drop("_n")), same(keys), "left_semi")
    cells = own.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cells.withColumn("_bucket", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows)).withColumn("_all", F.sum("_n").over(every)).where(F.col("_all") > rows)
    named = renamed(numbered, keys).select(*[f"_k{i}" for i in range(len(keys))], F.col("_cell").alias("_c"), "_bucket")
    on = same(keys) & (F.col("_cell") == F.col("_c"))
    parts = placed.join(F.broadcast(named) if few else named, on, "left").select(*df.columns, F.coalesce("_bucket", F.lit(0)).alias("_bucket"))
    return parts, (held // rows + many) * (wide + 100) <= SENT_BYTES


def renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})


def same(keys: Sequence[str]) -> Column:
    """Whether a row has the keys that ``renamed`` has renamed."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return on


def carried(df: DataFrame, keys: Sequence[str], summary: Column, combine, out: str = "_carry") -> DataFrame:
    """``df`` (with buckets) with ``out``: the summaries of all earlier buckets of its key, combined; null in the first one.

    ``combine`` is an aggregate over a window of summaries, in order; a key has as many rows there as buckets.
    """
    on = same(keys) & (F.col("_bucket") == F.col("_b"))
    return df.join(carries(df, keys, summary, combine, out), on, "left").drop("_b", *[f"_k{i}" for i in range(len(keys))])


def carries(df: DataFrame, keys: Sequence[str], summary: Column, combine, out: str = "_carry") -> DataFrame:
    """What ``carried`` brings to each bucket but the first of its key: ``_k0``, ..., ``_b``, ``out``."""
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(summary.alias("_s")).withColumn(out, combine(F.col("_s"), w)).where("_bucket > 0")
    return renamed(sums, keys).select(*[f"_k{i}" for i in range(len(keys))], F.col("_bucket").alias("_b"), out)


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """The last value up to each row that isn't null."""
    last = lambda w: F.last(value, ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = cut(df, keys, order[0], rows) if divisible(df, order[0]) else None
    if parts is None:
        return df.withColumn(out, last(Window.partitionBy(*keys)))
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    both = carried(parts, keys, newest, lambda s, w: F.last(s, ignorenulls=True).over(w))
    return both.withColumn(out, F.coalesce(last(Window.partitionBy(*keys, "_bucket")), "_carry")).drop("_bucket", "_carry")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], column: str, function: str, out: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Running sum, count, avg, min or max up to each row."""
    return running_all(df, keys, order, {out: (function, column)}, rows)


def running_all(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Mapping[str, tuple[str, str]], rows: int = BUCKET_ROWS) -> DataFrame:
    """Several running values (``out``: function and column) over one order: the time line is cut once, and all rows are dealt
    and sorted once."""
    plain = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}
    upto = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts, few = _cut(df, keys, order[0], rows) if divisible(df, order[0]) else (None, False)
    if parts is None:
        w = upto(Window.partitionBy(*keys))
        return df.withColumns({out: plain[f](c).over(w) for out, (f, c) in values.items()})
    own = upto(Window.partitionBy(*keys, "_bucket"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums, merges, here, out_of = [], {}, {}, {}
    for k, (out, (function, column)) in enumerate(values.items()):
        names = [(f"_v{k}", function)] if function != "avg" else [(f"_v{k}", "sum"), (f"_w{k}", "count")]
        for name, f in names:
            sums.append(plain[f](column).alias(name))
            merges[name] = F.sum if f == "count" else plain[f]
            here[name] = plain[f](column).over(own)
        now, before = F.col(f"_v{k}"), F.col(f"_carry._v{k}")
        if function in ("min", "max"):
            value = (F.least if function == "min" else F.greatest)(now, before)
        elif function == "avg":
            n = F.col(f"_w{k}") + zero(F.col(f"_carry._w{k}"))
            value = F.when(n > 0, (zero(now) + zero(before)) / n)
        else:
            value = F.coalesce(now + before, now, before)
        out_of[out] = value
    before = carries(parts, keys, F.struct(*sums), lambda s, w: F.struct(*[merge(s[name]).over(w).alias(name) for name, merge in merges.items()]))
    both = parts.withColumns(here).join(F.broadcast(before) if few else before, same(keys) & (F.col("_bucket") == F.col("_b")), "left")
    return both.withColumns(out_of).drop("_bucket", "_carry", "_b", *here, *[f"_k{i}" for i in range(len(keys))])
