"""Texts alike by the Jaccard similarity of their sets of ``SHINGLE``-word shingles: what SimHash dedup adds to its groups.

Fingerprints of texts alike by 0.8 differ in about ten of 64 bits, where no grid selects any more. Such pairs are found as
candidates that share one of ``BANDS`` bands of ``ROWS`` min-hashes, which a pair of similarity 0.8 misses with a chance of
6e-7 and a closer one more rarely; each candidate pair is verified on the whole sets. Texts with equal sets are one node.
Of a band value that many nodes share, all are first compared with a few hubs, which connects groups of near copies. What
a crowd still holds apart, such as texts that share a long passage and nothing else, is then joined by prefixes: of two
sets alike by 0.8, the first fifths in any common order share a shingle. Ordered by how many components have a shingle,
those fifths lack what a crowd has in common, and shingles of one component alone need no join, so a pair meets only where
both have something rare, and only where what follows it in both sets would still be enough. First all sets that share a
shingle so are compared with one of them, which joins most of a crowd with a pair for each prefix row; then all pairs of
different components are, but for those whose parity bits differ in more places than similar sets' could. None is left out.

Defined results: texts without words are copies of each other; a text of fewer words has one shingle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_hash, written
from .graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
SLICE_BYTES = 4 << 20

SHINGLE = 5
NEAR = 0.8
BANDS, ROWS = 20, 3
#: Nodes of one band value up to which all pairs are compared at once.
CROWDED = 32
#: Hubs that the bands of a crowd share.
HUBS = 4
MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 1 << 13
#: Bits that hold whether an odd number of a set's shingles fall on them, in longs.
PARITY = 1024


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    own = WORD.findall(text.lower()) if text else []
    if not own:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(own))
    joined = b" ".join(own)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths) + np.arange(len(own))
    starts = (ends - lengths).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)], np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """A signed hash of each band's min-hashes."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), STEP):
        mixed = (own[i : i + STEP, None] ^ (own[i : i + STEP, None] >> np.uint64(31))) * MULTIPLIERS
        low = np.minimum(low, mixed.min(axis=0))
    hashes = [xxhash.xxh64_intdigest(low[k : k + ROWS].tobytes(), k) for k in range(0, BANDS * ROWS, ROWS)]
    return np.array(hashes, np.uint64).view(np.int64).tolist()


def parity(own: np.ndarray) -> list[int]:
    """The parity bits of a set. Two sets' bits differ in no more places than the sets have shingles of their own."""
    place = (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARITY.bit_length() + 1)
    odd = (np.bincount(place.astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).tolist()


def shingle_sets(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """``node``, ``own`` (its shingles) and ``parity`` for nodes with their ``first`` row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            sets = [shingles(t).view(np.int64) for t in part.column("text").to_pylist()]
            bits = [parity(x) for x in sets]
            yield from pa.table([part.column("node"), *(pa.array(x, pa.list_(pa.int64())) for x in (sets, bits))], names=["node", "own", "parity"]).to_batches()

    need = nodes.select("node", F.col("first.text_hash").alias("_hash"))
    texts = docs.select(text_hash(text).alias("_hash"), F.col(text).cast("binary").alias("text")).join(need, "_hash")
    return written(texts.groupBy("node").agg(F.any_value("text").alias("text")).mapInArrow(step, "node long, own array<long>, parity array<long>"), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the node pairs (a, b) whose sets are similar enough."""
    pairs = written(pairs.distinct(), "near-pairs")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return written(both.where(same >= NEAR * (F.size("x") + F.size("y") - same)).select("a", "b"), "near-links")


def hub() -> Column:
    """A node of a band value, the same one for a crowd's bands that share a remainder."""
    return F.min_by("node", F.xxhash64("node", F.pmod("band", F.lit(HUBS)))).alias("hub")


def prefixes(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """The prefix rows (node, n, component, s, most) of nodes (node, n, component) that are needed to find pairs of different
    components. If ``s`` is the first shingle that two prefixes share, the sets have no more in common than either has from
    there on, which bounds the size of the other set (``most``); similar pairs are found at that shingle."""
    words = written(rest.join(sets, "node").select("node", "n", "component", F.explode("own").alias("s")), "near-words")
    spread = words.select("s", "component").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    size = (F.col("n") - F.ceil(NEAR * F.col("n") - 1e-9) + 1).cast("int")
    first = words.join(spread, "s").groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("all"))
    prefix = first.select("node", "n", "component", F.posexplode(F.slice("all", F.lit(1), size)).alias("at", "p")).where("p.c > 1")
    most = F.floor((1 + NEAR) / NEAR * (F.col("n") - F.col("at")) + 1e-6) - F.col("n")
    return written(prefix.select("node", "n", "component", F.col("p.s").alias("s"), most.alias("most")), "near-prefixes")


def star_pairs(prefix: DataFrame) -> DataFrame:
    """For each shingle of the prefixes one node, that with the least of its own before it, with all others: a pair a row."""
    star = prefix.groupBy("s").agg(F.max_by(F.struct("node", "component"), F.struct("most", "node")).alias("star"))
    return prefix.join(star, "s").where("component <> star.component").select(F.greatest("node", "star.node").alias("a"), F.least("node", "star.node").alias("b"))


def joined(rest: DataFrame, edges: DataFrame) -> DataFrame:
    """``rest`` with the components that edges between nodes (a, b) have joined."""
    own = rest.select("node", "component")
    ends = edges.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(ends).toDF("component", "low")
    return written(rest.join(found, "component", "left").select("node", "n", F.coalesce("low", "component").alias("component")), "near-joined")


def prefix_pairs(prefix: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a shingle of both prefixes, early enough in both. What two
    sets do not share is bounded from below by their parity bits, and for similar pairs from above by their sizes. Of a
    shingle's largest component (``big``) no two nodes are compared, so a crowd that is mostly connected costs what is still
    apart, times the crowd."""
    held = prefix.groupBy("s", "component").agg(F.count(F.lit(1)).alias("k"))
    big = held.groupBy("s").agg(F.max_by("component", F.struct("k", "component")).alias("big"))
    bits = sets.select("node", *(F.col("parity")[k].alias(f"p{k}") for k in range(PARITY // 64)))
    prefix = prefix.join(bits, "node")
    a = prefix.join(big, "s").where("component <> big").select("s", "big", *(F.col(c).alias(f"a_{c}") for c in prefix.columns if c != "s"))
    b = prefix.select("s", *(F.col(c).alias(f"b_{c}") for c in prefix.columns if c != "s"))
    apart = sum(F.bit_count(F.col(f"a_p{k}").bitwiseXOR(F.col(f"b_p{k}"))) for k in range(PARITY // 64))
    once = (F.col("b_component") == F.col("big")) | (F.col("a_node") < F.col("b_node"))
    alike = (F.col("b_n") <= F.col("a_most")) & (F.col("a_n") <= F.col("b_most")) & ((1 + NEAR) * apart <= (1 - NEAR) * (F.col("a_n") + F.col("b_n")) + 1e-6)
    return a.join(b, "s").where((F.col("a_component") != F.col("b_component")) & once & alike).select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, also: DataFrame, text: str) -> DataFrame:
    """Edges (a, b) that connect all nodes of sufficient similarity, directly or through others. ``nodes``: node, n (size of
    its set), bands and first; ``also``: candidate pairs (a, b) found elsewhere."""
    points = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = points.groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    held = written(points.hint("merge").join(shared, "band"), "near-bands")  # exploded: Spark sizes it too low for a broadcast
    ends = held.select("node").unionByName(also.select(F.col("a").alias("node"))).unionByName(also.select(F.col("b").alias("node")))
    sets = shingle_sets(docs, nodes.join(ends.distinct(), "node", "left_semi"), text)
    left = held.where(F.col("many") <= CROWDED).select("band", F.col("node").alias("a"), F.col("n").alias("na"))
    right = left.select("band", F.col("a").alias("b"), F.col("na").alias("nb"))
    alike = F.least("na", "nb") >= NEAR * F.greatest("na", "nb")
    sparse = left.hint("merge").join(right, "band").where((F.col("a") > F.col("b")) & alike).select("a", "b")
    crowded = held.where(F.col("many") > CROWDED)
    to_hub = crowded.join(crowded.groupBy("band").agg(hub()), "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    found = verified(sparse.unionByName(to_hub).unionByName(also), sets)
    if crowded.isEmpty():
        return found
    own = crowded.join(components(found), "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    own = written(own, "near-crowds")
    split = own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    rest = written(own.join(split, "band", "left_semi").select("node", "n", "component").distinct(), "near-apart")
    if rest.isEmpty():
        return found
    stars = verified(star_pairs(prefixes(rest, sets)), sets)
    return found.unionByName(stars).unionByName(verified(prefix_pairs(prefixes(joined(rest, stars), sets), sets), sets))
