"""Benchmark decontamination with an FM-index for each training shard.

Every Spark task cuts its documents into shards of a few megabytes. Words that occur in no benchmark item cannot be part
of a match, so they only separate runs; runs shorter than the shortest window are left out as well (both steps lose
nothing). The remaining word numbers form one sequence a shard, indexed by its Burrows-Wheeler transform, a wavelet
matrix for the ranks and a sampled suffix array. All windows are searched backward at once, their occurrences located
from the sampled positions, and the found word ranges merged into removal spans. No step shuffles.

Defined results: a null or empty text has no words and no hits; a null item has no windows; a null ``item_id`` counts as
the empty name; equal items each count; repeated documents are judged each for itself; further columns pass through, but
``find`` replaces columns that have the names of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, restored, set_aside, slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
#: Bytes of text in one indexed shard.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark text (two thirds of a million windows or so) whose windows travel to the executors at once; a larger
#: benchmark is searched block by block.
BLOCK_BYTES = 4 << 20
#: Every so many suffix positions are kept for locating.
SAMPLE = 8


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence of word numbers, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        if n < 2 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence: one bit plane a level, zeros moved before ones."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``i``."""
        start = np.zeros_like(i)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            up = (symbol >> level) & 1 == 1
            ones_i, ones_s = self.ones[k][i], self.ones[k][start]
            i = np.where(up, self.zeros[k] + ones_i, i - ones_i)
            start = np.where(up, self.zeros[k] + ones_s, start - ones_s)
        return i - start


class FMIndex:
    """Backward search and locate over a sequence of word numbers; number 0 is kept for the end."""

    def __init__(self, seq: np.ndarray, symbols: int):
        seq = np.append(seq, 0).astype(np.int64)
        order = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        self.ranks = WaveletMatrix(self.bwt, max(1, int(symbols - 1).bit_length()))
        marked = order % SAMPLE == 0
        self.marked = marked
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.kept = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns, one a row."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.before[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.before[c] + self.ranks.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix rows, walking back to the next sampled one."""
        out, steps, live = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            at = rows[live]
            here = self.marked[at]
            out[live[here]] = self.kept[self.marks[at[here]]] + steps[live[here]]
            live, at = live[~here], at[~here]
            c = self.bwt[at]
            rows[live] = self.before[c] + self.ranks.rank(c, at)
            steps[live] += 1
        return out


class Windows:
    """The windows of a block of benchmark items, by length, as word numbers from 2 on."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            own = [self.number.setdefault(w, len(self.number) + 2) for w in words(text)]
            if not own:
                continue
            self.names.append(name)
            n = min(window, len(own))
            for i in range(len(own) - n + 1):
                found.setdefault(tuple(own[i : i + n]), set()).add(len(self.names) - 1)
        self.by_length: list[tuple[int, np.ndarray, list[list[int]]]] = []
        for n in sorted({len(k) for k in found}):
            keys = [k for k in found if len(k) == n]
            self.by_length.append((n, np.array(keys, np.int64).reshape(-1, n), [sorted(found[k]) for k in keys]))
        self.shortest = min((n for n, _, _ in self.by_length), default=0)


def scan(texts: list[bytes | None], windows: Windows) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """For each text: words, words hit, names of the items found, and the merged ranges of hit words."""
    counts, parts, docs, firsts = [], [], [], []
    for d, text in enumerate(texts):
        own = words(text)
        counts.append(len(own))
        if not windows.shortest or len(own) < windows.shortest:
            continue
        seq = np.array([windows.number.get(w, 0) for w in own], np.int64)
        known = np.concatenate(([0], (seq > 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= windows.shortest:
                parts += [seq[a:b], np.ones(1, np.int64)]
                docs.append(d)
                firsts.append((a, b))
    hits: list[int] = [0] * len(texts)
    names: list[set[str]] = [set() for _ in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if parts:
        index = FMIndex(np.concatenate(parts), len(windows.number) + 2)
        lengths = np.array([b - a + 1 for a, b in firsts])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        cover = np.zeros(starts[-1] + 1, np.int64)
        for n, patterns, owners in windows.by_length:
            lo, hi = index.search(patterns)
            some = np.flatnonzero(lo < hi)
            if not len(some):
                continue
            sizes = hi[some] - lo[some]
            rows = np.repeat(lo[some] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            part = np.searchsorted(starts, at, side="right") - 1
            pairs = np.unique(np.stack([np.repeat(some, sizes), np.array(docs)[part]]), axis=1)
            for w, d in pairs.T.tolist():
                names[d].update(windows.names[o] for o in owners[w])
        covered = np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(covered))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            part = int(np.searchsorted(starts, a, side="right")) - 1
            first, d = firsts[part][0] - int(starts[part]), docs[part]
            spans[d].append((a + first, b + first))
            hits[d] += b - a
    return [(counts[d], hits[d], sorted(names[d]), spans[d]) for d in range(len(texts))]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("item_names", T.ArrayType(T.StringType())),
        T.StructField("word_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Windows]:
    """Windows of the benchmark, in blocks of a checked size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(total // BLOCK_BYTES)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)
        yield Windows([(r.name, bytes(r.text)) for r in part.collect()], window)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``n_words``, ``item_names`` (sorted) and ``word_spans`` (merged ranges of hit words, end exclusive) to ``docs``."""
    prepare(docs.sparkSession)
    out = docs = docs.drop(*FOUND.names)
    keep = docs.columns
    for k, windows in enumerate(benchmark_blocks(benchmark, window)):
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        schema = T.StructType([*docs.schema.fields, *FOUND.fields])

        def step(batches: Iterator[pa.RecordBatch], first: bool = k == 0, shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text, SHARD_BYTES):
                raw = part.column(text).cast(pa.large_binary()).to_pylist()
                found = scan(raw, shared.value)
                names, spans = [f[2] for f in found], [f[3] for f in found]
                if not first:
                    names = [sorted({*a, *b}) for a, b in zip(part.column("item_names").to_pylist(), names, strict=True)]
                    spans = [merged([*map(tuple, a), *b]) for a, b in zip(part.column("word_spans").to_pylist(), spans, strict=True)]
                cols = [part.column(c) for c in keep]
                cols += [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int64()))),
                ]
                yield from pa.table(cols, names=[*keep, *FOUND.names]).to_batches()

        out = out.mapInArrow(step, schema)
    return out


def judged(found: DataFrame) -> DataFrame:
    """Add ``n_hit`` and ``contaminated``: some word is hit, and hit words are a twentieth of all words or more."""
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    return restored(judged(find(set_aside(docs, "text"), benchmark)).where(~F.col("contaminated")), docs, "text")


def op9(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = judged(find(docs.select("doc_id", "text"), benchmark))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_names").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_names", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def brute(texts: list[str | None], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The contract by plain search over word lists; for tests."""
    out = []
    grams: dict[int, dict[tuple, set[str]]] = {}
    for name, text in items:
        own = words((text or "").encode())
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            grams.setdefault(n, {}).setdefault(tuple(own[i : i + n]), set()).add(name)
    for text in texts:
        own = words((text or "").encode())
        hit, found = [False] * len(own), set()
        for n, known in grams.items():
            for i in range(len(own) - n + 1):
                if (g := tuple(own[i : i + n])) in known:
                    found |= known[g]
                    hit[i : i + n] = [True] * n
        out.append((len(own), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out
