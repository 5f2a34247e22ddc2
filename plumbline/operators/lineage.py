"""Lineage: forward operators that keep the way back, and backward traversal. Reverse tables are key pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import BUCKET_ROWS, cut


def filter_traced(df: DataFrame, predicate: Column, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    flagged = df.withColumn("_ok", F.coalesce(predicate, F.lit(False)))
    return flagged.where("_ok").drop("_ok"), flagged.where(~F.col("_ok")).select(key, F.lit(text).alias("predicate"))


def aggregate_traced(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], source_key: str) -> tuple[DataFrame, DataFrame]:
    out = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out, df.select(*keys, F.col(source_key).alias("source_key"))


def expand_traced(df: DataFrame, array: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Children keyed by (parent key, position), and the map from child to parent."""
    out = df.select(key, F.posexplode(array).alias("pos", "value"))
    return out, out.select(F.concat_ws(":", key, "pos").alias("child_key"), F.col(key).alias("parent_key"))


def join_traced(left: DataFrame, right: DataFrame, on: Column, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    out = left.join(right, on)
    return out, out.select(F.col(left_key).alias("left_key"), F.col(right_key).alias("right_key"))


def backward(keys: DataFrame, reverse: DataFrame, on: Sequence[str]) -> DataFrame:
    """Target keys to their source keys."""
    return reverse.join(keys.select(*on).distinct(), list(on), "left_semi").select("source_key").distinct()


def impact(keys: DataFrame, steps: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Back through a chain of (reverse table, target column, source column), last step first."""
    current = keys
    for table, target, source in steps:
        current = table.join(current.select(F.col(current.columns[0]).alias(target)), target, "left_semi").select(source).distinct()
    return current


def reconcile(df: DataFrame, reverse: DataFrame, key: str) -> DataFrame:
    """Source keys that no target leads back to."""
    return df.select(F.col(key).alias("source_key")).join(reverse.select("source_key"), "source_key", "left_anti")


def capture_lineage(pairs: DataFrame, target: str, mode: str) -> DataFrame:
    """FULL key pairs, KEY_DERIVABLE envelopes (start, end, count), or a SAMPLED hundredth by hash."""
    if mode == "FULL":
        return pairs
    if mode == "KEY_DERIVABLE":
        return pairs.groupBy(target).agg(F.min("source_key").alias("start_key"), F.max("source_key").alias("end_key"), F.count(F.lit(1)).alias("n"))
    return pairs.where(F.pmod(F.xxhash64("source_key"), F.lit(100)) == 0)


def rebuild_from_envelopes(source: DataFrame, key: str, envelopes: DataFrame, target: str) -> DataFrame:
    """Per envelope, how many source keys of its target lie within it, how many it captured, and whether these agree. They do
    not where the source has keys between the ends that were not captured, or lacks captured ones."""
    inside = source.join(envelopes, (F.col(key) >= F.col("start_key")) & (F.col(key) <= F.col("end_key")) & (source[target] == envelopes[target]))
    counts = inside.groupBy(envelopes[target]).agg(F.count(F.lit(1)).alias("inside"))
    both = envelopes.select(target, "n").join(counts, target, "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    return both.select(target, "inside", "n", (F.col("inside") == F.col("n")).alias("complete"))


def islands(pairs: DataFrame, target: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Ranges of consecutive source keys (whole numbers) of each target.

    A target of more than ``rows`` keys is cut into buckets: ranges are found in each, and only those at the ends of
    buckets, two a bucket at most, are then joined where they meet.
    """
    keys = pairs.select(target, "source_key").distinct()
    parts = cut(keys, [target], "source_key", rows)
    own = [target, "_bucket"] if parts is not None else [target]
    numbered = (keys if parts is None else parts).withColumn("g", F.col("source_key") - F.row_number().over(Window.partitionBy(*own).orderBy("source_key")))
    found = numbered.groupBy(*own, "g").agg(F.min("source_key").alias("start_key"), F.max("source_key").alias("end_key"), F.count(F.lit(1)).alias("n")).drop("g")
    if parts is None:
        return found
    ends = parts.groupBy(F.col(target).alias("_t"), F.col("_bucket").alias("_b")).agg(F.min("source_key").alias("_first"), F.max("source_key").alias("_last"))
    placed = found.join(ends, F.col(target).eqNullSafe(F.col("_t")) & (F.col("_bucket") == F.col("_b"))).withColumn("_edge", (F.col("start_key") == F.col("_first")) | (F.col("end_key") == F.col("_last")))
    w = Window.partitionBy(target).orderBy("start_key")
    edge = placed.where("_edge").withColumn("_new", F.coalesce(F.lag("end_key").over(w) + 1 < F.col("start_key"), F.lit(True)).cast("int"))
    joined = edge.withColumn("_g", F.sum("_new").over(w)).groupBy(target, "_g").agg(F.min("start_key").alias("start_key"), F.max("end_key").alias("end_key"), F.sum("n").alias("n"))
    return placed.where("not _edge").select(target, "start_key", "end_key", "n").unionByName(joined.drop("_g"))


#: Source keys that one bitmap row covers; its position within them is a bit.
BITMAP = 32_768


def reverse_table(pairs: DataFrame, target: str, form: str, created_at: Column | None = None) -> DataFrame:
    """The way back from targets to whole-number source keys in a compact form.

    PAIRS has a row a pair, RANGES one a run of consecutive keys, ARRAY one a target and block of 32768 keys with the
    offsets, BITMAP the same with a bit a key. A block bounds every row, so a target with a third of all keys has many
    rows and no large one. ``created_at`` is kept for ``prune``.
    """
    block = (F.floor(F.col("source_key") / BITMAP)).cast("long").alias("block")
    offset = F.pmod(F.col("source_key"), F.lit(BITMAP))
    if form == "PAIRS":
        out = pairs.select(target, "source_key").distinct()
    elif form == "RANGES":
        out = islands(pairs, target)
    elif form == "ARRAY":
        out = pairs.groupBy(target, block).agg(F.sort_array(F.collect_set(offset.cast("int"))).alias("offsets"))
    elif form == "BITMAP":
        out = pairs.groupBy(target, block).agg(F.bitmap_construct_agg(offset).alias("bits"))
    else:
        raise ValueError(form)
    return out if created_at is None else out.withColumn("created_at", created_at)


def reverse_pairs(table: DataFrame, target: str, form: str) -> DataFrame:
    """The pairs (target, source_key) that a reverse table stands for."""
    if form == "PAIRS":
        return table.select(target, "source_key")
    if form == "RANGES":
        return table.select(target, F.explode(F.sequence("start_key", "end_key")).alias("source_key"))
    if form == "ARRAY":
        return table.select(target, "block", F.explode("offsets").alias("o")).select(target, (F.col("block") * BITMAP + F.col("o")).alias("source_key"))
    if form == "BITMAP":
        # eight places a byte; bytes without a bit are left out before they are taken apart
        at = table.select(target, "block", "bits", F.explode(F.sequence(F.lit(1), F.octet_length("bits"))).alias("at"))
        byte = at.select(target, "block", "at", F.conv(F.hex(F.substring("bits", F.col("at"), F.lit(1))), 16, 10).cast("int").alias("v")).where("v > 0")
        bits = byte.select(target, "block", "at", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where(F.expr("(shiftright(v, k) & 1) = 1"))
        return bits.select(target, (F.col("block") * BITMAP + (F.col("at") - 1) * 8 + F.col("k")).cast("long").alias("source_key"))
    raise ValueError(form)


def merged_bitmaps(tables: Sequence[DataFrame], target: str) -> DataFrame:
    """Bitmap tables of several runs as one; a bit set in any of them is set."""
    out = tables[0].select(target, "block", "bits")
    for t in tables[1:]:
        out = out.unionByName(t.select(target, "block", "bits"))
    return out.groupBy(target, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def prune(table: DataFrame, now: Column, days: int, created_at: str = "created_at") -> DataFrame:
    """Rows within the retention; rows of unknown age stay."""
    return table.where(F.col(created_at).isNull() | (F.col(created_at) >= now - F.make_dt_interval(F.lit(days))))


def table_size(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, and bytes of the given columns as text or binary."""
    size = F.lit(0)
    kinds = dict(table.dtypes)
    for c in columns:
        size = size + F.coalesce(F.octet_length(F.col(c) if kinds[c] in ("string", "binary") else F.array_join(F.col(c), ",") if kinds[c].startswith("array") else F.col(c).cast("string")), F.lit(0))
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"))


CLASSES = ("ISOMORPHISM", "EMBEDDING", "PROJECTION", "LOSSY")


def composed_class(*steps: Column) -> Column:
    """The class of a chain of steps: injective if all are, total if all are; a step of no known class makes it unknown."""
    known, injective, complete = F.lit(True), F.lit(True), F.lit(True)
    for s in steps:
        known = known & F.coalesce(s.isin(*CLASSES), F.lit(False))
        injective = injective & s.isin("ISOMORPHISM", "EMBEDDING")
        complete = complete & s.isin("ISOMORPHISM", "PROJECTION")
    return F.when(known, F.when(injective & complete, "ISOMORPHISM").when(injective, "EMBEDDING").when(complete, "PROJECTION").otherwise("LOSSY"))


def lineage_table(pairs: DataFrame, source: str, epoch: str, path: str, versions: Mapping[str, str], target: str) -> DataFrame:
    """One row an output key: entity, epoch, path, lookup versions, how many sources."""
    shown = ",".join(f"{k}={v}" for k, v in versions.items())
    return pairs.groupBy(F.col(target).alias("output_key")).agg(F.count(F.lit(1)).alias("n_sources")).select(F.lit(source).alias("entity"), F.lit(epoch).alias("epoch"), F.lit(path).alias("path"), F.lit(shown).alias("lookups"), "output_key", "n_sources")


def attribute(df: DataFrame, keys: Sequence[str], column: str, source_key: str) -> DataFrame:
    total = F.sum(column).over(Window.partitionBy(*keys))
    return df.select(*keys, source_key, F.round(F.col(column) / total, 6).alias("share"))


def find_subject(tables: Mapping[str, tuple[DataFrame, str, str]], subjects: DataFrame, subject_key: str) -> DataFrame:
    """Records of the subjects in several tables, as (table, record key)."""
    out = None
    for name, (df, on, record) in tables.items():
        part = df.join(subjects.select(F.col(subject_key).alias(on)), on, "left_semi").select(F.lit(name).alias("table_name"), F.col(record).cast("string").alias("record_key"))
        out = part if out is None else out.unionByName(part)
    return out


def measure_class(pairs: DataFrame, source: DataFrame, source_key: str, target: str) -> DataFrame:
    """Whether a step is injective and total on data, and the class that follows."""
    per = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_key").alias("sources"), F.count_distinct(target).alias("targets"))
    total = source.agg(F.count_distinct(source_key).alias("all_sources"))
    both = per.crossJoin(total)  # one row each
    injective, complete = F.col("sources") == F.col("targets"), F.col("sources") == F.col("all_sources")
    kind = F.when(injective & complete, "ISOMORPHISM").when(injective, "EMBEDDING").when(complete, "PROJECTION").otherwise("LOSSY")
    return both.select("sources", "targets", "all_sources", injective.alias("injective"), complete.alias("total"), kind.alias("step_class"))
