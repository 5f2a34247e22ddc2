"""Quality classifier from weak labels.

Overlapping heuristic labellers each raise a flag or not: seven for junk (symbols, table bars, bare punctuation,
shouting, stutter, few different words, doubled punctuation) and four for toxicity. No word is known beforehand: a bounded
sample of labelled rows is cut in two by the hash of the text, and each half shows for itself which words and beginnings
of words are tied to toxic texts. Two labellers fire on a word of the one half and of the other, so that what they have
in common is not chance of one sample; two more on a share and a larger share of either's words. Spark counts the flag patterns of all documents, at most 2^7 and 2^4 of them. Expectation-maximisation over the pattern counts estimates how often each
labeller fires on bad and on good documents, and thereby the posterior of every pattern. A bounded sample of documents
with posterior labels trains one sparse hashed linear scorer a task (FTRL-proximal with L1), which then scores every
document whole.

Bounds that are parameters: ``LABELLED`` rows for the toxic lexicon, ``LEXICON`` entries, ``TRAIN`` documents for the
scorers. Everything else covers all rows.

Defined results: a null or empty text has no flags and is kept; labels without a document, repeated labels and null
labels are ignored; without labels, or with fewer than eight different toxic texts in either half, no text is toxic; repeated documents are judged each for itself, also
those without a ``doc_id``; extra columns pass through, but ``scored`` replaces columns that have the names of its own.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, restored, set_aside, slices, written

#: Labelled rows that the toxic lexicon is read from.
LABELLED = 8000
#: Words and word beginnings in the lexicon at most.
LEXICON = 2000
#: Share of the toxic sample that a word or beginning must be in, copies counted once; eight documents at least.
LEAST = 0.02
#: Near copies in the labelled sample: min-hashes a text, those of a band, words of a shingle, and the share that must agree.
SKETCH, BAND, SHINGLE, ALIKE = 64, 4, 3, 0.7
MULTIPLIERS = np.random.default_rng(64).integers(1, 2**63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
#: Documents that the scorers are trained on.
TRAIN = 6000
BUCKETS = 1 << 22
SLICE_BYTES = 4 << 20
#: Tokens that a worker remembers before it starts anew; with their features some 40 MB.
REMEMBERED = 1 << 16

LETTERS = re.compile(r"[^\W\d_]+")
SYMBOLS = re.compile(r"[&%$#*@^~<>{}\[\]\\=+]")
BEGINNINGS = (3, 4, 5, 6, 7)
JUNK = ("symbols", "bars", "bare", "shouting", "stutter", "few_words", "doubled")
TOXIC = ("first", "second", "share", "dense")


def pieces(word: str) -> list[str]:
    """A word and its beginnings (marked by a hyphen)."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if len(word) > n]]


def hashed(word: str) -> list[int]:
    """Buckets of a word's beginnings and of the word; each hash goes on from the one before."""
    out, h, at, n = [], 0, 0, len(word)
    for k in BEGINNINGS:
        if k >= n:
            break
        h = zlib.crc32(word[at:k].encode(), h)
        out.append(h & (BUCKETS - 1))
        at = k
    out.append(zlib.crc32(word[at:].encode() + b"$", h) & (BUCKETS - 1))
    return out


@dataclass
class Scorer:
    """A sparse linear scorer over hashed features; those of single tokens count by the root of how many there are."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -9.0

    def of(self, buckets: list[int]) -> tuple[float, int]:
        found = [w for b in buckets if (w := self.weights.get(b)) is not None]
        return sum(found), len(found)


#: What a token adds: symbols, shouted, doubled, bare, in the first and in the second lexicon, then weight and number of features for
#: junk and for toxic, and its feature buckets.
Token = tuple[int, bool, bool, bool, bool, bool, float, int, float, int, list[int]]


@dataclass
class Reader:
    """Flags, features and scores of texts; remembers tokens."""

    lexicons: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())
    junk: Scorer = field(default_factory=Scorer)
    toxic: Scorer = field(default_factory=Scorer)
    features: bool = False
    known: dict[str, Token | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.starts = frozenset(p[:3] for own in self.lexicons for p in own)

    def token(self, raw: str) -> Token | None:
        """None for a token that adds nothing."""
        m = LETTERS.search(raw)
        word = m.group().lower() if m else ""
        plain = raw.isalpha()
        own = pieces(word) if word[:3] in self.starts else ()
        buckets = hashed(word) if word and (self.features or self.junk.weights or self.toxic.weights) else []
        t = (
            0 if plain else len(SYMBOLS.findall(raw)),
            len(word) > 1 and raw.isupper(),
            not plain and len(raw) > 1 and raw[-1] == raw[-2] and not raw[-1].isalnum() and raw[-1] != "_",
            not word and not any(map(str.isdigit, raw)),
            not self.lexicons[0].isdisjoint(own),
            not self.lexicons[1].isdisjoint(own),
            *self.junk.of(buckets),
            *self.toxic.of(buckets),
            buckets if self.features else [],
        )
        kept = t if any(t) else None
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(raw) <= 256:
            self.known[raw] = kept
        return kept

    def read(self, text: str | None) -> tuple[int, int, list[int], list[int], float, float]:
        """Junk flags, toxic flags, buckets of tokens and of the whole text, junk and toxic score (log odds)."""
        own = (text or "").split()
        if not own:
            return 0, 0, [], [], -9.0, -9.0
        counts, known, new = Counter(own), self.known, self.token
        n = len(own)
        symbols = upper = doubled = bare = first = second = hits = 0
        junk = toxic = 0.0
        junk_n = toxic_n = 0
        buckets: set[int] = set()
        for raw, k in counts.items():
            t = known[raw] if raw in known else new(raw)
            if t is None:
                continue
            symbols += t[0] * k
            upper += t[1] * k
            doubled += t[2] * k
            bare += t[3] * k
            first += t[4]
            second += t[5]
            hits += t[4] or t[5]
            junk += t[6]
            junk_n += t[7]
            toxic += t[8]
            toxic_n += t[9]
            if self.features:
                buckets.update(t[10])
        same = sum(map(str.__eq__, own, own[1:]))
        shares = (
            symbols / max(1, len(text)),
            counts.get("|", 0) / n if n >= 10 else 0.0,
            bare / n if n >= 10 else 0.0,
            upper / n if n >= 8 else 0.0,
            same / n if n >= 10 else 0.0,
            1 - len(counts) / n if n >= 20 else 0.0,
            doubled / n if n >= 5 else 0.0,
        )
        limits = (0.03, 0.05, 0.1, 0.5, 0.2, 0.8, 0.2)
        junk_flags = sum((s >= c) << i for i, (s, c) in enumerate(zip(shares, limits, strict=True)))
        share = hits / len(counts)
        toxic_flags = (first > 0) | (second > 0) << 1 | (share >= 0.005) << 2 | (share >= 0.01) << 3
        whole = [f"flag:{name}" for i, name in enumerate((*JUNK, *TOXIC)) if (junk_flags | toxic_flags << len(JUNK)) >> i & 1]
        whole += [f"flags:{junk_flags}:", f"toxic flags:{toxic_flags}:"]
        whole += [f"{name}:{int(s * 20)}" for name, s in zip(JUNK, shares, strict=True) if s >= 0.02]
        whole += [f"{name}:{min(x, 5)}" for name, x in (("first", first), ("second", second), ("hits", hits), ("share", int(200 * share))) if x]
        at = [bucket(w) for w in whole]
        return (
            junk_flags,
            toxic_flags,
            sorted(buckets) if self.features else [],
            at,
            self.junk.bias + self.junk.of(at)[0] + junk / math.sqrt(max(1, junk_n)),
            self.toxic.bias + self.toxic.of(at)[0] + toxic / math.sqrt(max(1, toxic_n)),
        )


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (BUCKETS - 1)


def estimate(counts: dict[int, int], labellers: int, rounds: int = 300) -> tuple[dict[int, float], np.ndarray, np.ndarray, float]:
    """Posterior of "bad" by flag pattern, how often each labeller fires on bad and on good, and the share of bad."""
    patterns = np.array(sorted(counts), np.int64)
    if not len(patterns):
        return {}, np.full(labellers, 0.5), np.full(labellers, 0.02), 0.1
    n = np.array([counts[p] for p in patterns.tolist()], float)
    fires = (patterns[:, None] >> np.arange(labellers)) & 1
    bad, good, share = np.full(labellers, 0.5), np.full(labellers, 0.01), 0.1
    for _ in range(rounds):
        a = np.log(share) + fires @ np.log(bad) + (1 - fires) @ np.log1p(-bad)
        b = np.log1p(-share) + fires @ np.log(good) + (1 - fires) @ np.log1p(-good)
        post = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        w = n * post
        bad = (fires.T @ w + 0.5) / (w.sum() + 1)
        good = (fires.T @ (n - w) + 0.01) / ((n - w).sum() + 1)
        share = float(np.clip(w.sum() / n.sum(), 1e-4, 0.5))
    return dict(zip(patterns.tolist(), post.tolist(), strict=True)), bad, good, share


def trained(tokens: list[np.ndarray], whole: list[np.ndarray], labels: np.ndarray, rounds: int = 8, alpha: float = 0.5, l1: float = 0.1, l2: float = 0.05, least: int = 5, tied: float = 4.0) -> Scorer:
    """Buckets that speak for bad are screened, then FTRL-proximal runs over the rows."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Scorer()
    rows = [np.unique(np.concatenate(x)) for x in zip(tokens, whole, strict=True)]
    # tables over all buckets: sorting what the rows hold together takes several times the rows' own memory
    seen, tied_to = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS)
    for r, y in zip(rows, labels.tolist(), strict=True):
        seen[r] += 1
        tied_to[r] += y
    buckets = np.flatnonzero(seen)
    n, bad = seen[buckets].astype(np.int64), tied_to[buckets]
    del seen, tied_to
    ok = (n >= least) & (bad - share * n >= tied * np.sqrt(n * share * (1 - share)))
    used, last = buckets[ok], int(ok.sum())
    del buckets, n, bad, ok
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(last)
    z, s = np.zeros(last + 1), np.zeros(last + 1)
    first, second = np.full(last + 1, l1), np.full(last + 1, l2)
    first[-1] = second[-1] = 0  # the bias is free
    own = []
    for r, w in zip(rows, whole, strict=True):
        at = place[r].astype(np.int64)
        known = at >= 0
        of_token = ~np.isin(r[known], w)
        value = np.where(of_token, 1 / math.sqrt(max(1, int(of_token.sum()))), 1.0)
        own.append((np.append(at[known], last), np.append(value, 1.0)))
    del rows, place

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - first[at], 0)
        return -shrunk / ((1 + np.sqrt(s[at])) / alpha + second[at])

    for _ in range(rounds):
        for (at, x), y in zip(own, labels.tolist(), strict=True):
            w = weights(at)
            e = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(w @ x))))) - y
            if abs(e) > 1e-3:
                g = e * x
                z[at] += g - (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / alpha * w
                s[at] += g * g
    w = weights(slice(None))
    return Scorer({int(b): float(x) for b, x in zip(used, w, strict=False)}, float(w[-1]))


def features(read: tuple) -> tuple[int, int, bytes, bytes]:
    """Flags and buckets as they travel to the driver."""
    return read[0], read[1], *(np.array(b, np.int32).tobytes() for b in read[2:4])


def mapped(df: DataFrame, text: str, columns: list[T.StructField], reader, row) -> DataFrame:
    """Run ``row(reader, text)`` over all texts; its values are appended as ``columns``."""
    shared = df.sparkSession.sparkContext.broadcast(reader)
    keep = df.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, text, SLICE_BYTES):
            values = [row(own, t) for t in part.column(text).to_pylist()]
            cols = [part.column(c) for c in keep]
            for k, f in enumerate(columns):
                kind = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[f.dataType.simpleString().replace("bigint", "long")]
                cols.append(pa.array([v[k] for v in values], kind))
            yield from pa.table(cols, names=[*keep, *(f.name for f in columns)]).to_batches()
        own.known.clear()  # the worker lives on

    return df.mapInArrow(step, T.StructType([*df.schema.fields, *columns]))


def sketch(text: str) -> bytes:
    """Min-hashes of the shingles of ``SHINGLE`` words; a text without words is only like its copies."""
    words = LETTERS.findall(text.lower())
    n = min(SHINGLE, len(words))
    own = {zlib.crc32(" ".join(words[i : i + n]).encode()) for i in range(len(words) - n + 1)} if words else {zlib.crc32(text.encode())}
    hashes, low = np.fromiter(own, np.uint64, len(own)), np.full(SKETCH, 2**32 - 1, np.uint64)
    for i in range(0, len(hashes), 1 << 14):
        mixed = (hashes[i : i + (1 << 14), None] + np.uint64(1)) * MULTIPLIERS
        low = np.minimum(low, (mixed >> np.uint64(32)).min(axis=0))
    return low.astype("<u4").tobytes()


def apart(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """Of (label, key, sketch) the label and key of rows that are no near copy of a kept one with their label; smaller keys
    are kept first. Near copies share a band of the sketch, and ``ALIKE`` of its places is verified."""
    kept: list[tuple[int, int]] = []
    held: list[np.ndarray] = []
    bands: dict[tuple, list[int]] = {}
    for label, key, raw in sorted(rows):
        own = np.frombuffer(raw, "<u4")
        names = [(label, k, own[k : k + BAND].tobytes()) for k in range(0, SKETCH, BAND)]
        near = sorted({i for name in names for i in bands.get(name, ())})
        if near and (np.stack([held[i] for i in near]) == own).mean(axis=1).max() >= ALIKE:
            continue
        for name in names:
            bands.setdefault(name, []).append(len(held))
        kept.append((label, key))
        held.append(own)
    return kept


def toxic_lexicon(docs: DataFrame, labels: DataFrame, text: str = "text") -> frozenset[str]:
    first, second = toxic_lexicons(docs, labels, text)
    return first | second


def toxic_lexicons(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[frozenset[str], frozenset[str]]:
    """Words and beginnings (marked by a hyphen) that speak for a toxic text in each half of the labelled sample."""
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = docs.select("doc_id", text).where(f"{text} is not null").join(F.broadcast(sample), "doc_id").select(text, F.col("toxic").cast("long").alias("toxic"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE_BYTES):
            sketches = [sketch(t) for t in part.column(text).to_pylist()]
            yield from part.append_column("sketch", pa.array(sketches, pa.binary())).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE_BYTES):
            seen: Counter[tuple[int, str]] = Counter()
            bad: Counter[tuple[int, str]] = Counter()
            for t, y, half in zip(*(part.column(c).to_pylist() for c in (text, "toxic", "half")), strict=True):
                own = {(half, p) for w in LETTERS.findall(t.lower()) for p in pieces(w)}
                seen.update(own)
                if y:
                    bad.update(own)
            keys = list(seen)
            cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())]
            yield pa.record_batch(cols, ["half", "piece", "n", "bad"])

    # copies and near copies count once
    once = rows.withColumn("key", F.xxhash64(text)).dropDuplicates(["key", "toxic"])
    rows = written(once.mapInArrow(sketched, f"{text} string, toxic long, key long, sketch binary"), "quality-sample", "zstd")
    kept = apart([(r.toxic, r.key, r.sketch) for r in rows.select("toxic", "key", "sketch").collect()])
    half = F.pmod("key", F.lit(2)).alias("half")
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "toxic long, key long")), ["toxic", "key"]).select(text, "toxic", half)
    totals = {r.half: r for r in rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).collect()}
    found = rows.mapInArrow(count, "half long, piece string, n long, bad long").groupBy("half", "piece").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = written(found.where((F.col("bad") >= 8) & (F.col("bad") >= 0.6 * F.col("n"))), "quality-pieces")
    out = []
    for k in (0, 1):
        if k not in totals or not totals[k].bad:
            out.append(frozenset())
            continue
        tied = found.where((F.col("half") == k) & (F.col("bad") >= LEAST * totals[k].bad))
        order = (F.col("bad") - totals[k].bad / totals[k].n * F.col("n")) / F.sqrt("n")
        out.append(frozenset(r.piece for r in tied.orderBy(order.desc(), "piece").limit(LEXICON // 2).collect()))
    return out[0], out[1]


def training_sample(docs: DataFrame, text: str = "text") -> DataFrame:
    """``TRAIN`` distinct texts with a word, by salted hash; copies are one piece of evidence and take one place."""
    worded = docs.where(F.col(text).rlike(r"\S")).select(F.xxhash64(text).alias("key"), text)
    keys = worded.select("key").distinct().orderBy(F.xxhash64("key", F.lit("train")), "key").limit(TRAIN)
    return worded.join(F.broadcast(keys), "key").groupBy("key").agg(F.any_value(text).alias(text)).select(text)


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text") -> Reader:
    """A reader with lexicon and scorers, from all documents' flag patterns and the bounded samples."""
    prepare(docs.sparkSession, SLICE_BYTES)
    lexicons = toxic_lexicons(docs, labels, text)
    plain = Reader(lexicons)
    long = [T.StructField("junk_flags", T.LongType()), T.StructField("toxic_flags", T.LongType())]
    flags = mapped(docs.select(text), text, long, plain, lambda r, t: r.read(t)[:2])
    held = flags.groupBy("junk_flags", "toxic_flags").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2048 rows
    junk_counts, toxic_counts = Counter(), Counter()
    for r in held:
        junk_counts[r.junk_flags] += r.n
        toxic_counts[r.toxic_flags] += r.n
    junk = estimate(junk_counts, len(JUNK))[0]
    toxic = estimate(toxic_counts, len(TOXIC))[0]
    drawn = training_sample(docs, text)
    columns = [*long, *(T.StructField(n, T.BinaryType()) for n in ("tokens", "whole"))]
    rows = mapped(drawn, text, columns, Reader(lexicons, features=True), lambda r, t: features(r.read(t))).drop(text)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            own = pa.Table.from_batches(held)
            tokens, whole = ([np.frombuffer(x, np.int32) for x in own.column(c).to_pylist()] for c in ("tokens", "whole"))
            likely = [np.array([post.get(x, 0.0) for x in own.column(c).to_pylist()]) for post, c in ((junk, "junk_flags"), (toxic, "toxic_flags"))]
            del held, own
            yield pa.record_batch([pa.array([pickle.dumps([trained(tokens, whole, x) for x in likely])])], ["scorers"])

    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("tokens"), "tokens", "whole").mapInArrow(fit, "scorers binary").collect()  # not in the driver's memory
    scorers = pickle.loads(found[0].scorers) if found else [trained([], [], np.zeros(0)) for _ in range(2)]
    return Reader(lexicons, *scorers)


def scored(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Add ``junk_score`` and ``toxic_score`` (log odds), the flags, and ``keep`` (neither is likely) to ``docs``."""
    docs = docs.drop("junk_flags", "toxic_flags", "junk_score", "toxic_score", "keep")
    reader = fitted(docs, labels, text)
    columns = [T.StructField(n, T.LongType()) for n in ("junk_flags", "toxic_flags")] + [T.StructField(n, T.DoubleType()) for n in ("junk_score", "toxic_score")]
    out = mapped(docs, text, columns, reader, lambda r, t: (lambda x: (x[0], x[1], x[4], x[5]))(r.read(t)))
    return out.withColumn("keep", (F.col("junk_score") < 0) & (F.col("toxic_score") < 0))


def held_out(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row: how documents of one fold of the labels (by a hash of the text, so copies stay together) are judged by a
    classifier that has seen no label of it: bad (junk or toxic), toxic, good, and how many of each were rejected."""
    own = docs.select("doc_id", "text").where("doc_id is not null")
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(folds)) == 0
    mine = own.where(fold).select("doc_id").distinct()
    judged = scored(own, labels.join(mine, "doc_id", "left_anti")).select("doc_id", "keep").join(mine, "doc_id", "left_semi")
    known = labels.where("quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    both = judged.join(known, "doc_id").select((~F.col("keep")).alias("gone"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"), (F.col("toxic") == 1).alias("toxic"))
    n = lambda c: F.count_if(c)
    return both.agg(n(F.col("bad")).alias("bad"), n(F.col("bad") & F.col("gone")).alias("bad_rejected"), n(F.col("toxic")).alias("toxic"), n(F.col("toxic") & F.col("gone")).alias("toxic_rejected"), n(~F.col("bad")).alias("good"), n(~F.col("bad") & F.col("gone")).alias("good_rejected"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the scorers keep, with their own columns."""
    return restored(scored(set_aside(docs, "doc_id", "text"), labels).where("keep"), docs, "doc_id", "text")


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), labels)
    chance = lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(c)))
    return out.select("doc_id", (1 - chance("junk_score")).alias("quality"), chance("toxic_score").alias("toxic"), "junk_flags", "toxic_flags", "keep")
