"""Sources, epoch slices, versioned reads and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Binding:
    """Where a logical table lies: format, path, declared schema and reader options."""

    format: str
    path: str
    schema: T.StructType | str | None = None
    options: dict[str, str] = field(default_factory=dict)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine alone a local one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def read_source(spark: SparkSession, binding: Binding) -> DataFrame:
    reader = spark.read.format(binding.format).options(**binding.options)
    if binding.schema is not None:
        reader = reader.schema(binding.schema)
    return reader.load(binding.path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, n: int, properties: dict[str, str]) -> DataFrame:
    """A table of a database in ``n`` partitions along a number, date or time column. The database is asked for the bounds;
    rows beyond them that arrive meanwhile, and rows without a value, are in the outer partitions. Filters and columns are
    pushed down as for any source."""
    quoted = f'"{column}"'
    low, high = spark.read.jdbc(url, f'(SELECT MIN({quoted}) AS "low", MAX({quoted}) AS "high" FROM {table}) bounds', properties=properties).first()
    if low is None:  # no rows, or none with a value
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=quoted, lowerBound=low, upperBound=high if high != low else low + 1, numPartitions=n, properties=properties)


def slice_epoch(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows of a closed interval; stays a plain comparison, so the scan can prune."""
    return df.where(F.col(column).between(low, high))


def read_temporal(ranges: Sequence[tuple[DataFrame, str, str]], column: str, low: str, high: str) -> DataFrame:
    """One logical table from several, each valid in a half-open range of ``column``; overlapping ranges are rejected. The
    epoch from ``low`` to ``high`` is closed, like that of ``slice_epoch``."""
    ordered = sorted(ranges, key=lambda r: r[1])
    for (_, _, end), (_, begin, _) in zip(ordered, ordered[1:], strict=False):
        if begin < end:
            raise ValueError(f"ranges overlap: {begin} < {end}")
    out = None
    for df, begin, end in ordered:
        if begin <= high and low < end:
            lo, hi, until = (F.lit(x).cast("timestamp_ntz") for x in (max(low, begin), high, end))
            part = df.where((F.col(column) >= lo) & (F.col(column) <= hi) & (F.col(column) < until))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no range covers the epoch")
    return out


def latest_snapshot(df: DataFrame, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """The newest version of each key; ``ties`` decide between equal versions."""
    order = F.struct(version, *ties) if ties else F.col(version)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def read_lookup(df: DataFrame, version_column: str, version=None, as_of=None) -> DataFrame:
    """A lookup at an explicit version, or at the newest one up to ``as_of``; neither given is an error."""
    if version is not None:
        return df.where(F.col(version_column) == version)
    if as_of is None:
        raise ValueError("a lookup needs a version or an as-of point")
    newest = df.where(F.col(version_column) <= as_of).agg(F.max(version_column).alias("_v"))
    return df.join(F.broadcast(newest), F.col(version_column) == F.col("_v"), "left_semi")  # one row


def read_alias(df: DataFrame, version_column: str, aliases: DataFrame, alias: str) -> DataFrame:
    """A lookup at the version that ``aliases`` (alias, version) names, the newest if it names several; an unknown alias has
    no rows."""
    named = aliases.where(F.col("alias") == alias).agg(F.max("version").alias("_v"))
    return df.join(F.broadcast(named), F.col(version_column) == F.col("_v"), "left_semi")  # one row


def slice_version(df: DataFrame, column: str, version) -> DataFrame:
    """Rows of one version or batch id."""
    return df.where(F.col(column) == version)


def write_result(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_errors(errors: DataFrame, path: str, format: str = "parquet") -> None:
    errors.write.mode("append").format(format).partitionBy("error_type").save(path)


def merge_upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``changes`` replace target rows of the same key; the rest stays."""
    return target.join(changes, list(keys), "left_anti").select(*target.columns).unionByName(changes.select(*target.columns))


def merge_since(target: DataFrame, changes: DataFrame, keys: Sequence[str], mark: str, closed: bool = True) -> DataFrame:
    """``merge_upsert`` of only those changes that the target's high-water mark leaves: those at it or, if not ``closed``,
    beyond it. With a mark as coarse as a day, changes of the mark's own day may still come in; taking them again does no
    harm. ``overtaken`` has the rest."""
    return merge_upsert(target, split_since(target, changes, mark, closed)[0], keys)


def split_since(target: DataFrame, changes: DataFrame, mark: str, closed: bool = True) -> tuple[DataFrame, DataFrame]:
    high = target.agg(F.max(mark).alias("_high"))  # one row
    fresh = (F.col(mark) >= F.col("_high")) if closed else (F.col(mark) > F.col("_high"))
    flagged = changes.crossJoin(high).withColumn("_fresh", F.col(mark).isNotNull() & (F.col("_high").isNull() | fresh))
    return flagged.where("_fresh").drop("_high", "_fresh"), flagged.where("not _fresh").drop("_high", "_fresh")


def overtaken(target: DataFrame, changes: DataFrame, key: str, mark: str, closed: bool = True) -> DataFrame:
    """Error rows for the changes that ``merge_since`` leaves out: without a mark, or behind the high-water mark."""
    from ..operators.errors import CODES, error_rows  # which publishes through this package

    left = split_since(target, changes, mark, closed)[1]
    bare = error_rows(left.where(F.col(mark).isNull()), key, "CHANGE", CODES["null_field"], mark, "a mark", F.lit(None).cast("string"))
    return bare.unionByName(error_rows(left.where(F.col(mark).isNotNull()), key, "CHANGE", CODES["validation"], mark, "the high-water mark or later", F.col(mark)))


EVENT_SCHEMA = "event_id long, ts string, user_id long, event_type string, value double, props string"


def parse_events(lines: DataFrame, schema: str = EVENT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """JSON lines as typed events, and the malformed lines."""
    parsed = lines.withColumn("_e", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("_e").isNull() | F.col("_e._bad").isNotNull()
    names = [f.split()[0] for f in schema.split(",")]
    return parsed.where(~bad).select(*[F.col(f"_e.{n}") for n in names]), parsed.where(bad).select("value")


def flattened(df: DataFrame, column: str, facets: Sequence[str]) -> DataFrame:
    """JSON facets of a text column as columns of their own (dots become underscores)."""
    return df.select("*", *[F.get_json_object(column, f"$.{f}").alias(f.replace(".", "_")) for f in facets])


def malformed(good: DataFrame, bad: DataFrame) -> DataFrame:
    """One row: how many lines were typed events and how many were not."""
    return good.agg(F.count(F.lit(1)).alias("parsed")).crossJoin(bad.agg(F.count(F.lit(1)).alias("malformed")))


def infer_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For text columns, how many values are there and fit each candidate type; one pass. A date has a year, a month and a
    day: a cast alone takes any number of four to seven digits for a year. Nor is a number a double by a ``d`` or ``f`` at its end."""
    fits = {"bigint": None, "double": lambda v: ~v.rlike(r"[\d.][dDfF]\s*$"), "date": lambda v: v.rlike(r"\d-\d{1,2}-\d"), "boolean": None}
    aggs = []
    for c in columns:
        col = F.col(c).cast("string")
        counts = []
        for kind, form in fits.items():
            tried = col.try_cast(kind)
            counts.append(F.count(tried if form is None else F.when(form(col), tried)).alias(f"n_{kind}"))
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(col).alias("n"), *counts).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each column of either snapshot: added, removed, changed or same, and how full it is in the new one."""
    before, after = dict(old.dtypes), dict(new.dtypes)
    names = [*before, *(c for c in after if c not in before)]

    def status(c: str) -> str:
        if c not in before:
            return "added"
        if c not in after:
            return "removed"
        return "same" if before[c] == after[c] else "changed"

    row = [F.struct(F.lit(c).alias("column_name"), F.lit(status(c)).alias("status"), (F.count(F.col(c)) / F.count(F.lit(1)) if c in after else F.lit(None).cast("double")).alias("fill_rate")) for c in names]
    return new.agg(F.array(*row).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def apply_scd2(history: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], at: Column) -> DataFrame:
    """Close the open interval of keys whose columns changed, append their new version, keep the rest.

    ``history`` has keys, columns, valid_from and valid_to (null: open); ``changes`` has keys and columns.
    """
    closed = history.where(F.col("valid_to").isNotNull())
    live = history.where(F.col("valid_to").isNull())
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_seen"))
    from ..operators.joins import full_join  # which publishes through this package

    both = full_join(live, new, keys)
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    changed = F.col("_seen").isNotNull() & differs
    known = F.col("valid_from").isNotNull()
    kept = both.where(known).select(*keys, *columns, "valid_from", F.when(changed, at).otherwise(F.col("valid_to")).alias("valid_to"))
    fresh = both.where(changed).select(*keys, *[F.col(f"_new_{c}").alias(c) for c in columns], at.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    order = [*keys, *columns, "valid_from", "valid_to"]
    return closed.select(*order).unionByName(kept.select(*order)).unionByName(fresh.select(*order))
