"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint of 64 bits maps to the bit counts of its 16 segments of 4 bits. One differing bit moves one count by one,
so the Manhattan distance of two count vectors never exceeds the Hamming distance. Fingerprints that differ in two bits
or fewer therefore share a grid point within distance one of both: every distinct fingerprint is sent to its own grid
point and its neighbours (30 rows or so), and the join on the grid point yields all candidates, which are verified by
exact comparison. A grid point that holds many fingerprints (a family of near copies) goes to the finest grid instead,
segments of one bit, where a point can hold 65 fingerprints at most and Manhattan and Hamming distance agree; there each
fingerprint links to the smallest one of its point when that is close enough, else by the same verification.

Defined results: a null or empty text has fingerprint zero and links like any other; equal fingerprints are one node, so
copies are never paired; the component of rows without any ``doc_id`` is null; repeated rows stay rows; extra columns
are ignored (``dedupe`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, slices, text_hash, written
from .graph import components
from .neartext import bands, shingles
from .neartext import links as alike_links

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 3
SEED = 42
DISTANCE = 2
#: A grid point with more fingerprints goes to the finest grid.
CROWDED = 32
SLICE_BYTES = 4 << 20
#: Words of a long text whose shingles are hashed at once.
CHUNK_WORDS = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as an unsigned number."""
    own = WORD.findall(text.lower()) if text else []
    if not own:
        return 0
    size, digest = min(shingle, len(own)), xxhash.xxh64_intdigest
    total, ones = len(own) - size + 1, np.zeros(64, np.int64)
    for i in range(0, total, CHUNK_WORDS):
        part = own[i : i + CHUNK_WORDS + size - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths) + np.arange(len(part))
        starts = (ends - lengths).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with ``fp`` (64 bits as a signed long)."""
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE_BYTES):
            raw = part.column(text).cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in raw], np.uint64).view(np.int64)
            cols = [*(part.column(c) for c in keep), pa.array(fps)]
            yield from pa.table(cols, names=[*keep, "fp"]).to_batches()

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(step, f"{kept + ', ' if kept else ''}fp long")


def counts(fp: Column) -> Column:
    """Bit counts of the 16 segments of 4 bits, each in its own 4 bits of a long; halves apart, so that no sum overflows."""

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x33333333))

    high = half(F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.shiftleft(high, 32).bitwiseOR(half(fp.bitwiseAND(F.lit(0xFFFFFFFF))))


def grid_points(c: Column) -> Column:
    """A count vector and those at Manhattan distance one from it."""
    around = [c]
    for k in range(16):
        own = F.shiftrightunsigned(c, 4 * k).bitwiseAND(F.lit(15))
        around += [F.when(own < 4, c + (1 << 4 * k)), F.when(own > 0, c - (1 << 4 * k))]
    return F.filter(F.array(*around), lambda x: x.isNotNull())


def flips(fp: Column) -> Column:
    """A fingerprint and those that differ from it in one bit."""
    masks = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    return F.concat(F.array(fp), F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: fp.bitwiseXOR(m)))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within the distance, directly or through others.

    Every verified candidate pair of an uncrowded grid point is an edge. At the finest grid all fingerprints of a point
    are one flip away from it, hence two from each other: an edge to the smallest one loses no connection. Spark takes
    exploded tables for as small as they were before, so a hint keeps their joins from collecting them for a broadcast.
    """
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.repartition(tasks, "fp")  # a small table, but each row becomes thirty
    points = distinct.select("fp", F.explode(grid_points(counts(F.col("fp")))).alias("point"))
    shared = points.groupBy("point").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = written(points.hint("merge").join(shared, "point"), "simhash-grid")
    left = held.where(F.col("n") <= CROWDED).select("point", F.col("fp").alias("a"))
    right = left.select("point", F.col("a").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    sparse = left.hint("merge").join(right, "point").where((F.col("a") > F.col("b")) & near).select("a", "b").distinct()
    crowded = held.where(F.col("n") > CROWDED).select("fp").distinct()
    fine = crowded.select(F.col("fp").alias("a"), F.explode(flips(F.col("fp"))).alias("point"))
    fine = fine.withColumn("b", F.min("a").over(Window.partitionBy("point"))).where("a <> b").select("a", "b").distinct()
    return sparse.unionByName(fine)


def grouped(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (written once), and for each distinct fingerprint its component and that component's
    first row (``first.id``: smallest id, ``first.text_hash``)."""
    own = docs.select(F.col(id).alias("id"), F.col(text).alias(text), text_hash(text).alias("text_hash"))
    marked = written(fingerprints(own, text), "simhash-rows")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    nodes = written(marked.groupBy("fp").agg(F.min(row).alias("first")), "simhash-nodes")
    found = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    joined = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = written(joined, "simhash-components")
    best = joined.groupBy("component").agg(F.min("first").alias("first"))
    return marked, joined.select("fp", "component").join(best, "component").select("fp", "first")


def op5(docs: DataFrame) -> DataFrame:
    marked, groups = grouped(docs)
    return marked.join(groups, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )


def sketched(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``text_hash``, ``fp``, and of the set of shingles: ``node`` (its hash), ``n`` (its size) and ``bands``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            raw = part.column("text").cast(pa.large_binary()).to_pylist()
            sets = [shingles(t) for t in raw]
            hashes = ([fingerprint(t) for t in raw], [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets])
            cols = [part.column("id"), part.column("text_hash"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in hashes)]
            cols += [pa.array([len(x) for x in sets], pa.int64()), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))]
            yield from pa.table(cols, names=["id", "text_hash", "fp", "node", "n", "bands"]).to_batches()

    own = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"), text_hash(text).alias("text_hash"))
    return written(own.mapInArrow(step, f"id {docs.schema[id].dataType.simpleString()}, text_hash long, fp long, node long, n long, bands array<long>"), "simhash-rows")


def alike_groups(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``first`` of each group of texts that the similarity of their shingle sets connects. Candidates are texts whose
    fingerprints the grid connects, and those of ``neartext``; all are verified on the whole sets."""
    rows = sketched(docs, id, text)
    row = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    nodes = written(rows.groupBy("node").agg(F.min(row).alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "simhash-nodes")
    pairs = written(rows.select("node", "fp").distinct(), "simhash-fingerprints")
    found = components(links(pairs.select("fp").distinct())).withColumnRenamed("node", "fp")
    placed = written(pairs.join(found, "fp", "left").select("node", F.coalesce("component", "fp").alias("group")), "simhash-components")
    low = placed.groupBy("group").agg(F.min("node").alias("b"))
    also = written(placed.join(low, "group").where("node <> b").select(F.col("node").alias("a"), "b"), "simhash-pairs")
    joined = nodes.join(components(alike_links(docs, nodes, also, text)), "node", "left")
    return written(joined.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first")), "simhash-groups")


def dedupe(docs: DataFrame, id: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """One document of each component: the one with the smallest id, of repeated rows one. Fingerprints link as in ``op5``;
    with ``similar``, texts link whose sets of five-word shingles are alike by 0.8 or more, however far their fingerprints.

    Equal texts are in one component, so a kept row is named by id and text hash; rows that share both are repeats, of
    which each task keeps one before anything is shuffled.
    """
    prepare(docs.sparkSession)
    return first_rows(docs, alike_groups(docs, id, text) if similar else grouped(docs, id, text)[1], id, text)


def first_rows(docs: DataFrame, groups: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``groups`` name as ``first`` (``id``, ``text_hash``), of repeated rows one."""
    kept = groups.select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash")).distinct()
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
    once = docs.groupBy(F.col(id).alias("_own"), text_hash(text).alias("_text")).agg(row)
    own = once.join(kept, once["_own"].eqNullSafe(kept["_id"]) & (once["_text"] == kept["_hash"]), "left_semi")
    return own.select("_row.*")


def brute(texts: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """The contract by comparing all pairs; for tests."""

    def plain(text: str | None) -> int:
        own = WORD.findall((text or "").encode().lower())
        if not own:
            return 0
        n = min(3, len(own))
        h = [xxhash.xxh64_intdigest(b" ".join(own[i : i + n]), 42) for i in range(len(own) - n + 1)]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    fps = [plain(t) for _, t in texts]
    first = list(range(len(fps)))

    def top(i: int) -> int:
        while first[i] != i:
            i = first[i]
        return i

    for i, f in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= 2:
                first[top(i)] = top(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(texts):
        low[top(i)] = min(low.get(top(i), d), d)
    return [(d, f"{f:016x}", low[top(i)]) for i, ((d, _), f) in enumerate(zip(texts, fps, strict=True))]
