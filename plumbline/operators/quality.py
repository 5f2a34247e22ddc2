"""Data quality: volume, profiles, drift, integrity, lateness, sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import CODES, error_rows
from .selection import distinct_and_percentiles, percentiles


def daily_volume(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def volume_check(counts: DataFrame, low: int, high: int) -> DataFrame:
    status = F.when(F.col("n") == 0, "EMPTY").when(F.col("n") < low, "LOW").when(F.col("n") > high, "HIGH").otherwise("OK")
    return counts.withColumn("status", status)


def volume_baseline(counts: DataFrame, scope: Column, days: int = 7, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Each day against the days before it in its scope; the day itself is left out."""
    w = Window.partitionBy(scope).orderBy("day").rowsBetween(-days, -1)
    base = F.avg("n").over(w)
    out = counts.select("day", "n", F.round(base, 4).alias("baseline"), F.min("n").over(w).alias("low"), F.max("n").over(w).alias("high"))
    return out.withColumn("status", F.when(F.col("baseline").isNull(), "NO_BASELINE").when(F.col("n") < low * F.col("baseline"), "LOW").when(F.col("n") > high * F.col("baseline"), "HIGH").otherwise("OK"))


def field_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a numeric column. Percentiles are exact, by selection; jobs run for them while the plan is built."""
    n = F.count(F.lit(1))
    distinct, found = distinct_and_percentiles(df, columns, [0.5, 0.99])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            n.alias("n"),
            F.try_divide(F.count_if(F.col(c).isNull()), n).alias("null_rate"),
            F.min(c).cast("double").alias("low"),
            F.max(c).cast("double").alias("high"),
            F.round(F.avg(F.col(c).cast("decimal(20,4)")).cast("double"), 4).alias("mean"),
            F.round(F.stddev_samp(c), 2).alias("deviation"),
            F.round(F.lit(found[c, 0.5]).cast("double"), 4).alias("median"),
            F.round(F.lit(found[c, 0.99]).cast("double"), 4).alias("p99"),
        ).alias(c)
        for c in columns
    ]
    out = df.agg(*rows).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")
    return out.join(distinct, "column_name", "left").select("column_name", "n", "null_rate", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "low", "high", "mean", "deviation", "median", "p99")


def rolling_baseline(counts: DataFrame, days: int = 7, width: float = 3.0) -> DataFrame:
    """Each day against the ``days`` calendar days before it, whether or not all of them have rows: mean, deviation, and a
    status by ``width`` deviations. The window runs over days alone."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(F.lit(0)).orderBy(number).rangeBetween(-days, -1)
    out = counts.select("day", "n", F.avg("n").over(w).alias("mean"), F.stddev_samp("n").over(w).alias("deviation"), F.count("n").over(w).alias("seen"))
    far = F.abs(F.col("n") - F.col("mean")) > width * F.col("deviation")
    status = F.when(F.col("seen") < 2, "NO_BASELINE").when(far & (F.col("n") < F.col("mean")), "LOW").when(far, "HIGH").otherwise("OK")
    return out.select("day", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "seen", status.alias("status"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column of any type: declared and inferred type, null and unique rate, lengths, and the most frequent value.

    Values are counted first, column by column, so that no buffer holds the values of a whole column.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("declared_type"), F.col(c).cast("string").alias("value")) for c, t in df.dtypes if c in columns])).alias("cell")
    counted = df.select(cells).groupBy("cell.column_name", "cell.declared_type", "cell.value").agg(F.count(F.lit(1)).alias("k"))
    some = F.col("value").isNotNull()
    fits = {k: F.bool_and(~some | F.col("value").try_cast(k).isNotNull()) for k in ("bigint", "double", "date", "boolean")}
    kind = F.lit("string")
    for name, fit in reversed(fits.items()):
        kind = F.when(fit, name).otherwise(kind)
    n, filled = F.sum("k"), F.sum(F.when(some, F.col("k")).otherwise(0))
    return counted.groupBy("column_name", "declared_type").agg(
        F.when(filled > 0, kind).alias("inferred_type"),
        n.alias("n"),
        F.round((n - filled) / n, 9).alias("null_rate"),
        F.count_if(some).alias("n_distinct"),
        F.round(F.count_if(some & (F.col("k") == 1)) / F.greatest(filled, F.lit(1)), 9).alias("unique_rate"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.max_by("value", F.when(some, F.struct("k", "value"))).alias("top_value"),
        F.max(F.when(some, F.col("k"))).alias("top_count"),
    )


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Frequency table: the ``n`` most frequent values, ties by value, with their share of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("t"))  # one row
    return counts.orderBy(F.desc("k"), "value").limit(n).crossJoin(total).select("value", "k", F.round(F.col("k") / F.col("t"), 9).alias("share"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / ((high - low) / bins))))
    return df.where(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def frequencies(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    a = base.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("e"))
    b = current.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("o"))
    both = a.join(b, F.expr("true") & a["value"].eqNullSafe(b["value"]), "full_outer").select(F.coalesce(a["value"], b["value"]).alias("value"), F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("o", F.lit(0)).alias("o"))
    totals = both.agg(F.sum("e").alias("te"), F.sum("o").alias("to"), F.count(F.lit(1)).alias("k"))  # one row
    return both.crossJoin(totals)


def drift_chi2(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Chi-squared of the current counts against the base shares, with half a row for unseen values."""
    f = frequencies(base, current, column)
    expected = F.greatest(F.col("e"), F.lit(0.5)) / F.col("te") * F.col("to")
    return f.agg(F.round(F.sum((F.col("o") - expected) ** 2 / expected), 6).alias("chi2"), (F.count(F.lit(1)) - 1).alias("freedom"))


def drift_kl(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Kullback-Leibler divergence of current from base, counts smoothed by one."""
    f = frequencies(base, current, column)
    p, q = (F.col("o") + 1) / (F.col("to") + F.col("k")), (F.col("e") + 1) / (F.col("te") + F.col("k"))
    return f.agg(F.round(F.sum(p * F.log(p / q)), 9).alias("kl"))


def drift_ks(base: DataFrame, current: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Largest distance of the binned cumulative shares; the window runs over the bins alone."""
    a = histogram(base, column, low, high, bins).withColumnRenamed("n", "e")
    b = histogram(current, column, low, high, bins).withColumnRenamed("n", "o")
    both = a.join(b, "bin", "full_outer").select("bin", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("o", F.lit(0)).alias("o"), F.lit(0).alias("g"))
    w = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("g")
    gap = F.abs(F.sum("e").over(w) / F.sum("e").over(every) - F.sum("o").over(w) / F.sum("o").over(every))
    return both.select(gap.alias("gap")).agg(F.round(F.max("gap"), 9).alias("ks"))


def drift_threshold(base: DataFrame, current: DataFrame, column: str, limit: float) -> DataFrame:
    """Null rate, distinct count and P99 of two periods with their relative change."""

    def m(df: DataFrame, s: str) -> DataFrame:
        distinct, found = distinct_and_percentiles(df, [column], [0.99])
        rate = df.agg(F.try_divide(F.count_if(F.col(column).isNull()), F.count(F.lit(1))).alias(f"null_{s}"))
        n = distinct.agg(F.coalesce(F.max("n_distinct"), F.lit(0)).alias(f"distinct_{s}"))
        return rate.crossJoin(n).withColumn(f"p99_{s}", F.round(F.lit(found[column, 0.99]).cast("double"), 4))  # one row each

    both = m(base, "a").crossJoin(m(current, "b"))  # one row each
    change = F.try_divide(F.abs(F.col("p99_b") - F.col("p99_a")), F.abs(F.col("p99_a")))
    return both.withColumn("p99_change", F.round(change, 6)).withColumn("drifted", change > limit)


def drift_flags(base: DataFrame, current: DataFrame, column: str, null_rate_max: float, null_rate_change: float, cardinality_change: float, p99_change: float) -> DataFrame:
    """One row for each monitored threshold: both periods, the change, and whether it is flagged.

    The null rate is held against a maximum and against its change in absolute terms, cardinality and P99 against their
    relative change; a change from zero or from nothing is flagged if the new value is something else.
    """
    one = drift_threshold(base, current, column, p99_change)

    def row(metric: str, a: Column, b: Column, limit: float, relative: bool) -> Column:
        change = F.try_divide(F.abs(b - a), F.abs(a)) if relative else F.abs(b - a)
        flagged = F.when(a.isNull() | (F.lit(relative) & (a == 0)), ~a.eqNullSafe(b)).when(b.isNull(), True).otherwise(change > limit)
        return F.struct(F.lit(metric).alias("metric"), a.cast("double").alias("base"), b.cast("double").alias("current"), F.round(change, 6).alias("change"), F.lit(limit).alias("limit"), flagged.alias("flagged"))

    c = F.col
    nothing = F.struct(F.lit("null_rate_max").alias("metric"), c("null_a").cast("double").alias("base"), c("null_b").cast("double").alias("current"), F.lit(None).cast("double").alias("change"), F.lit(null_rate_max).alias("limit"), F.coalesce(c("null_b") > null_rate_max, F.lit(False)).alias("flagged"))
    rows = [nothing, row("null_rate_change", c("null_a"), c("null_b"), null_rate_change, False), row("cardinality_change", c("distinct_a"), c("distinct_b"), cardinality_change, True), row("percentile_99_change", c("p99_a"), c("p99_b"), p99_change, True)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


PERCENTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def full_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``profile`` with, for numbers, range, mean, median, deviation and percentiles, and for texts the most frequent shape
    (letters as ``A``, digits as ``9``; ties by shape)."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))]
    texts = [c for c in columns if kinds[c] == "string"]
    found = percentiles(df, numeric, list(PERCENTILES.values())) if numeric else {}
    stats = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.min(c).cast("double").alias("low"),
            F.max(c).cast("double").alias("high"),
            F.round(F.avg(F.col(c).cast("decimal(20,4)")).cast("double"), 4).alias("mean"),
            F.round(F.stddev_samp(c), 2).alias("deviation"),
            F.round(F.lit(found[c, 0.5]).cast("double"), 4).alias("median"),
            *[F.round(F.lit(found[c, f]).cast("double"), 4).alias(n) for n, f in PERCENTILES.items()],
        ).alias(c)
        for c in numeric
    ]
    out = profile(df, columns)
    if numeric:
        out = out.join(df.agg(*stats).select(F.explode(F.array(*[F.col(c) for c in numeric])).alias("r")).select("r.*"), "column_name", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(n) for n in ("low", "high", "mean", "deviation", "median", *PERCENTILES)])
    if not texts:
        return out.withColumn("pattern", F.lit(None).cast("string"))
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, "[A-Za-z]", "A"), "[0-9]", "9")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), shape(F.col(c)).alias("shape")) for c in texts])).alias("cell")
    shapes = df.select(cells).where("cell.shape is not null").groupBy("cell.column_name", "cell.shape").agg(F.count(F.lit(1)).alias("k"))
    return out.join(shapes.groupBy("column_name").agg(F.min_by("shape", F.struct(-F.col("k"), "shape")).alias("pattern")), "column_name", "left")


def patterns(df: DataFrame, column: str) -> DataFrame:
    shape = F.regexp_replace(F.regexp_replace(column, "[A-Za-z]", "A"), "[0-9]", "9")
    counts = df.groupBy(shape.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t"))  # one row
    return counts.crossJoin(total).select("pattern", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


def referential(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    known = target.select(F.col(target_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    flagged = df.join(known, df[key] == F.col("_k"), "left")
    orphan = F.count_if(F.col("_hit").isNull())
    return flagged.agg(F.count_if(F.col("_hit")).alias("valid"), orphan.alias("orphan"), F.round(orphan / F.count(F.lit(1)), 9).alias("orphan_rate"))


def freshness(df: DataFrame, source: str, ts: str, now: Column, hours: float) -> DataFrame:
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.max(ts))) / 3600.0
    return df.groupBy(source).agg(F.max(ts).alias("newest"), F.round(age, 4).alias("age_hours"), (age > hours).alias("stale"))


def expectations(df: DataFrame, row_count_min: int, null_rate_max: Mapping[str, float], warn: float = 0.5) -> DataFrame:
    """PASS, WARN (half the limit is used) or FAIL for each expectation; one pass."""
    n = F.count(F.lit(1))
    rows = [F.struct(F.lit("row_count_min").alias("expectation"), n.cast("double").alias("measured"), F.when(n >= row_count_min, "PASS").otherwise("FAIL").alias("status")).alias("_n")]
    for c, limit in null_rate_max.items():
        rate = F.count_if(F.col(c).isNull()) / n
        rows.append(F.struct(F.lit(f"null_rate_max:{c}").alias("expectation"), F.round(rate, 9).alias("measured"), F.when(rate > limit, "FAIL").when(rate > warn * limit, "WARN").otherwise("PASS").alias("status")).alias(c))
    return df.agg(*rows).select(F.explode(F.array("_n", *[F.col(c) for c in null_rate_max])).alias("r")).select("r.*")


def mark_late(df: DataFrame, event: str, processing: str, close_hours: int, watermark_hours: int) -> DataFrame:
    """The epoch is the event's day, closed ``close_hours`` after its end; late is beyond the watermark after that."""
    close = F.date_trunc("day", event) + F.make_dt_interval(F.lit(1), F.lit(close_hours))
    return df.withColumn("epoch", F.to_date(event)).withColumn("late", F.col(processing) > close + F.make_dt_interval(F.lit(0), F.lit(watermark_hours)))


def route_late(df: DataFrame, strategy: str, processing: str = "processed_at") -> DataFrame:
    """Every row with where it goes: its epoch, or for a late one what the strategy says. Nothing is dropped."""
    target = {"REJECT": "ERROR", "REPROCESS": "REOPEN", "ACCUMULATE": "NEXT_EPOCH", "BACKFILL": "BACKFILL"}[strategy]
    epoch = F.date_add(F.to_date(processing), 1) if strategy == "ACCUMULATE" else F.col("epoch")
    return df.withColumn("route", F.when(F.col("late"), target).otherwise("CURRENT")).withColumn("target_epoch", F.when(F.col("late"), epoch).otherwise(F.col("epoch")))


def late_errors(df: DataFrame, key: str, epoch: str = "epoch") -> DataFrame:
    """Error rows for late rows that a REJECT leaves out of their epoch."""
    late = df.where("late")
    return error_rows(late, key, "LATE", CODES["validation"], epoch, "processed before the epoch closes", F.col(epoch)).withColumn("epoch", F.col("actual"))


def affected_epochs(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Closed epochs that late rows belong to, for REPROCESS, with how many rows each."""
    return df.where("late").groupBy(epoch).agg(F.count(F.lit(1)).alias("late_rows"))


def bounded_route(routed: DataFrame, most: int, epoch: str = "epoch") -> DataFrame:
    """Routes of ``route_late``, but rows that would be carried over more than ``most`` epochs go to ERROR."""
    far = (F.col("route") != "CURRENT") & (F.datediff("target_epoch", epoch) > most)
    return routed.withColumn("route", F.when(far, "ERROR").otherwise(F.col("route")))


def act(df: DataFrame, violations: DataFrame, action: str, epoch: str = "epoch") -> DataFrame:
    """QUARANTINE marks whole epochs, HALT returns none of their rows, WARN all."""
    bad = violations.select(epoch).distinct()
    if action == "HALT":
        return df.join(bad, epoch, "left_anti").withColumn("quarantined", F.lit(False))
    marked = df.join(bad.withColumn("_bad", F.lit(True)), epoch, "left")
    flag = F.coalesce("_bad", F.lit(False)) if action == "QUARANTINE" else F.lit(False)
    return marked.withColumn("quarantined", flag).drop("_bad")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the greatest by ``order``; pre-aggregated, so a hot key does not meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def reservoir(df: DataFrame, n: int, key: str) -> DataFrame:
    """Exactly ``n`` rows, the same every time: the smallest hashes of the key."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)


def share_of(df: DataFrame, key: str, percent: int) -> DataFrame:
    """RANDOM: about ``percent`` of the rows, the same every time, by the hash of the key."""
    return df.where(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % 100 < percent)


def stratified(df: DataFrame, stratum: str, key: str, hex_below: str) -> DataFrame:
    """Rows whose key hash starts below ``hex_below``, so about the same share of every stratum."""
    return df.where(F.substring(F.sha2(F.concat_ws(":", F.col(stratum), F.col(key).cast("string")), 256), 1, len(hex_below)) < hex_below)
