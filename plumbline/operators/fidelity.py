"""Cross-table fidelity: conservation, coverage, alignment, materiality, synchronisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import merge_upsert
from .joins import compare, full_join


def _totals(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(column).cast("decimal(20,3)")).alias(out))


def conservation(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str, tolerance: float) -> DataFrame:
    """Sums of both sides by key, their gap, and whether it is within tolerance."""
    both = full_join(_totals(a, keys, column, "_a"), _totals(b, keys, column, "_b"), keys)
    gap = F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)))
    return both.select(*keys, F.col("_a").cast("double").alias("total_a"), F.col("_b").cast("double").alias("total_b"), gap.cast("double").alias("gap"), (gap <= tolerance).alias("holds"))


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    x = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    both = full_join(x, y, keys).select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.withColumn("holds", F.col("n_b") >= F.col("n_a"))


def alignment(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose field differs between the sides."""
    y = b.select(key, F.col(column).alias("_b"))
    return a.select(key, F.col(column).alias("value_a")).join(y, key).where(~F.col("value_a").eqNullSafe(F.col("_b"))).select(key, "value_a", F.col("_b").alias("value_b"))


def containment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_anti")


def severity(gap: Column, missing: Column, material: float) -> Column:
    return F.when(missing, "CRITICAL").when(gap >= material, "MATERIAL").when(gap > 0, "IMMATERIAL").otherwise("NONE")


def multi_grain(a: DataFrame, b: DataFrame, date: str, column: str, levels: Sequence[str]) -> DataFrame:
    """One row a level: how many periods there are and how many differ."""
    out = None
    for level in levels:
        x, y = (d.select(F.date_trunc(level, date).alias("period"), column) for d in (a, b))
        c = conservation(x, y, ["period"], column, 0).agg(F.count(F.lit(1)).alias("periods"), F.count_if(~F.col("holds")).alias("differ"))
        part = c.select(F.lit(level).alias("level"), "periods", "differ")
        out = part if out is None else out.unionByName(part)
    return out


def sample_check(a: DataFrame, b: DataFrame, key: str, column: str, share: int) -> DataFrame:
    """Mean difference on a hash sample of keys with a 95 % interval."""
    x = a.where(F.pmod(F.xxhash64(key), F.lit(100)) < share).select(key, F.col(column).alias("_a"))
    d = x.join(b.select(key, F.col(column).alias("_b")), key).select((F.col("_a") - F.col("_b")).alias("d"))
    half = 1.96 * F.stddev_samp("d") / F.sqrt(F.count("d"))
    return d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.avg("d") - half).alias("low"), (F.avg("d") + half).alias("high"))


def breaches(results: DataFrame, reverse: DataFrame, key: str, limit: float) -> DataFrame:
    """Rows over the limit with expected, actual, excess and the keys that contribute."""
    over = results.where(F.col("gap") > limit)
    sources = reverse.join(over.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_sources"), F.min("source_key").alias("first_source"), F.max("source_key").alias("last_source"))
    return over.join(sources, key).select(key, F.col("total_a").alias("expected"), F.col("total_b").alias("actual"), F.round(F.col("gap") - limit, 3).alias("excess"), "n_sources", "first_source", "last_source")


def contributors(results: DataFrame, reverse: DataFrame, key: str, limit: float) -> DataFrame:
    """The source keys behind each row over the limit, as (key, source key) pairs."""
    return reverse.join(results.where(F.col("gap") > limit).select(key), key, "left_semi").select(key, "source_key")


def percent_severity(gap: Column, base: Column, missing: Column, percent: float) -> Column:
    """Severity by the gap's share of the base value; a gap on a zero base is material."""
    return severity(F.when(base != 0, 100 * gap / F.abs(base)).otherwise(F.when(gap > 0, F.lit(100.0 + percent)).otherwise(0.0)), missing, percent)


#: What a pre-flight check decides when an invariant would break.
MODES = {"STRICT": "REJECTED", "DEFERRED": "PENDING", "ADVISORY": "WARNED"}


def preflight(before: DataFrame, changes: DataFrame, keys: Sequence[str], invariant: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Apply changes virtually and evaluate an invariant (rows with ``holds``) on the result: its rows with ``decision``, which
    is ACCEPTED unless a row breaks, and then what the mode says."""
    results = invariant(merge_upsert(before, changes, keys))
    broken = results.agg(F.count_if(~F.coalesce("holds", F.lit(False))).alias("_broken"))  # one row
    return results.crossJoin(broken).withColumn("decision", F.when(F.col("_broken") > 0, MODES[mode]).otherwise("ACCEPTED")).drop("_broken")


def incremental(a: DataFrame, b: DataFrame, changed: DataFrame, keys: Sequence[str], column: str, tolerance: float) -> DataFrame:
    """Conservation only for the keys that have changed."""
    own = changed.select(*keys).distinct()
    return conservation(a.join(own, list(keys), "left_semi"), b.join(own, list(keys), "left_semi"), keys, column, tolerance)


def diff_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: how many keys the second run has added, removed and changed."""
    status = compare(a, b, keys, columns)
    names = (("added", "RIGHT_ONLY"), ("removed", "LEFT_ONLY"), ("changed", "DIFFERENT"))
    return status.agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in names])


def fingerprint(df: DataFrame) -> DataFrame:
    """Count, sum and exclusive-or of row hashes: the same for any order of rows."""
    h = F.xxhash64(*df.columns)
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))
    return one.withColumn("digest", F.sha2(F.concat_ws(":", "n", "hash_sum", "hash_xor"), 256))


def verify_chain(certificates: DataFrame, contract: str = "contract") -> DataFrame:
    """Per contract: broken links, gaps between dates, last date. Columns: contract, day, hash, previous."""
    w = Window.partitionBy(contract).orderBy("day")
    linked = certificates.select(contract, "day", F.lag("hash").over(w).alias("_h"), "previous", F.datediff("day", F.lag("day").over(w)).alias("_d"))
    return linked.groupBy(contract).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_h").isNotNull() & ~F.col("_h").eqNullSafe(F.col("previous"))).alias("broken"), F.count_if(F.col("_d") > 1).alias("gaps"), F.max("day").alias("last_day"))


def chain_coverage(certificates: DataFrame, today: Column, contract: str = "contract") -> DataFrame:
    """Per contract: the share of days from the first to the last that have a certificate, and days since the last."""
    span = F.datediff(F.max("day"), F.min("day")) + 1
    return certificates.groupBy(contract).agg(F.round(100 * F.count_distinct("day") / span, 6).alias("coverage"), F.datediff(today, F.max("day")).alias("days_since"))


def merge_columns(base: DataFrame, a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """MERGE in both directions: each column takes the side that changed it; where both did, the base value stays and the
    column is named in ``conflicts``."""
    x = base.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    both = full_join(x, a.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns]), [key])
    both = full_join(both, b.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns]), [key])
    merged, marks = [], []
    for c in columns:
        o, p, q = (F.col(f"_{s}_{c}") for s in "oab")
        conflict = ~p.eqNullSafe(o) & ~q.eqNullSafe(o) & ~p.eqNullSafe(q)
        merged.append(F.when(conflict, o).when(~p.eqNullSafe(o), p).otherwise(q).alias(c))
        marks.append(F.when(conflict, F.lit(c)))
    return both.select(key, *merged, F.array_join(F.filter(F.array(*marks), lambda m: m.isNotNull()), ",").alias("conflicts"))


def sync(base: DataFrame, a: DataFrame, b: DataFrame, key: str, column: str, strategy: str) -> DataFrame:
    """Three-way merge of one column: the side that changed wins; if both did, the strategy decides."""
    x = base.select(key, F.col(column).alias("_o"))
    both = full_join(full_join(x, a.select(key, F.col(column).alias("_a")), [key]), b.select(key, F.col(column).alias("_b")), [key])
    ca, cb = ~F.col("_a").eqNullSafe(F.col("_o")), ~F.col("_b").eqNullSafe(F.col("_o"))
    conflict = ca & cb & ~F.col("_a").eqNullSafe(F.col("_b"))
    chosen = {"SOURCE_WINS": F.col("_a"), "TARGET_WINS": F.col("_b"), "FAIL": F.raise_error(F.concat(F.lit("both sides changed "), F.col(key).cast("string")))}[strategy]
    return both.select(key, F.when(conflict, chosen).when(ca, F.col("_a")).otherwise(F.col("_b")).alias("merged"), conflict.alias("conflict"))
