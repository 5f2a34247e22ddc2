"""Phrase collocations from bidirectional FM-indexes over word numbers, one a shard.

Every Spark task cuts its documents into shards of some megabytes. The words of a shard, numbered by language and text,
form one sequence in which zeros stand between pieces. Two Burrows-Wheeler transforms of it, of the sequence and of its
reverse, are sorted as deep as the longest phrase goes, and no deeper: an interval of suffixes that start with a phrase
is then known with its count, and each step takes all intervals of a depth at once. The symbols of the transform inside
an interval are the words before the phrase, those inside its mirrored interval in the reverse index the words behind it;
sums over smaller symbols give the intervals of the longer phrases in both indexes. The indexes are written once to the
shared folder and read by each counting round; counts are summed across shards.

Rounds prune without losing anything: a phrase is at most as frequent as its parts, so pairs are enumerated between words
that are frequent in the whole corpus, triples around pairs that are. Most pairs are rare; they are first summed by a
hash, which can only add to a pair's count, and spelled out only where that sum is high enough. A shard tests all
this in bit fields of hashes, which may let rare parts pass but hold back no frequent one; the sums and thresholds that
decide are always taken on the phrases themselves.

Defined results: a null or empty text has no words; a null language is ``und``; repeated documents count each; words that
are no plain text (control characters but the separators) are words; an empty table gives an empty one; further columns
play no part. ``id`` columns are not read, so null or repeated ids change nothing.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, slices, written

#: Least count of a candidate, and longest phrase.
LEAST = 10
DEPTH = 3
#: A longer candidate hides a shorter one inside it from this share of the shorter one's count (percent).
HIDES = 50
TOP = 2000
#: Parts of a language's phrases that are ranked by themselves before the whole.
PARTS = 256
#: Bytes of text in one indexed shard.
SHARD_BYTES = 4 << 20
#: Bytes of a row group of the index, so that a task holds one shard or two at once, however many it has.
GROUP_BYTES = 8 << 20
#: Bits of a field for each frequent part at least, and the most bits of a field (64 MiB); a fuller field prunes less.
BITS = 16
FIELD = 1 << 29
#: Bits of the hash that pairs are summed by first; on a corpus with more pairs than it has values it prunes less.
HASH = 40
#: Passes that pairs are summed by hash in, so that only a part's shuffle files are there at once.
PASSES = 2
#: Bytes of the index that travel to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Rows that a task gives back at once.
ROWS = 1 << 15
#: Hashes of pairs that a task sums before it sends them on.
HELD = 1 << 18

#: What ends a piece, and what stands between words, as bytes; A-Z become small letters.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(ENDS + b"\t" + bytes(range(65, 91)), b"\n" * len(ENDS) + b" " + bytes(range(97, 123)))

SHARD = "langs array<string>, first array<int>, words binary, counts binary, bwt binary, reverse binary"


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of each piece; bytes.split takes the blanks that are left for white space."""
    return [w for p in text.translate(FOLD).split(b"\n") if (w := p.split())]


class Numbers(dict):
    def __init__(self, first: int):
        self.next = first

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.next
        self.next = n + 1
        return n


def ordered(key: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0 on. Where place and number fit into 63 bits, sorting the two packed together is
    much faster than sorting places by number."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()) >> (63 - bits):
        return np.argsort(key, kind="stable")
    packed = key.astype(np.int64) << bits | np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1)


def depth_sorted(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by doubling; beyond the end are smaller symbols."""
    n, reach, rank = len(seq), 1, seq.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - reach] = rank[reach:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + second
        order = ordered(key)
        reach *= 2
        if reach >= depth:
            return order
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))


class Index:
    """Both transforms of a shard. Rows of the forward one are ordered by what follows, of the reverse one by what precedes."""

    def __init__(self, bwt: np.ndarray, reverse: np.ndarray | None):
        self.bwt, self.reverse = bwt, reverse
        self.before = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=1))))

    @classmethod
    def built(cls, seq: np.ndarray, depth: int = DEPTH + 1) -> Index:
        order, back = depth_sorted(seq, depth), depth_sorted(seq[::-1], depth)
        return cls(seq[order - 1], seq[::-1][back - 1])

    def words(self) -> Intervals:
        """The intervals of single words; a word has the same one in both indexes."""
        lo, hi = self.before[:-1], self.before[1:]
        some = np.flatnonzero(hi > lo)
        some = some[some > 0]
        return Intervals(some[:, None], lo[some], lo[some], hi[some] - lo[some])

    def extended(self, of: Intervals, left: bool, passes: Callable[[np.ndarray], np.ndarray], both: bool = True) -> Intervals:
        """All phrases one word longer, by a word before or behind, of those phrases that ``passes`` lets through. Without
        ``both`` their rows are given in the other index only, which is enough to go on in the other direction."""
        symbols, at = (self.bwt, of.lo) if left else (self.reverse, of.mirror)
        base = np.cumsum(of.n) - of.n
        owner = np.repeat(np.arange(len(of.n)), of.n)
        rows = np.repeat(at - base, of.n) + np.arange(len(owner))
        order = ordered(owner * len(self.before) + symbols[rows])
        word, row = symbols[rows][order], rows[order]  # stable: rows of an owner and word ascend
        if not len(word):
            return Intervals(np.zeros((0, of.phrase.shape[1] + 1), np.int64), *np.zeros((3, 0), np.int64))
        owner = owner[order]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))))
        n = np.diff(np.append(first, len(word)))
        own, w = owner[first], word[first]
        smaller = first - base[own]  # rows of the interval that hold a smaller symbol
        long = np.column_stack((w, of.phrase[own]) if left else (of.phrase[own], w))
        keep = np.flatnonzero(w > 0)
        keep = keep[passes(long[keep])]
        one = self.before[w[keep]] + self.rank(left, w[keep], row[first[keep]]) if both else np.full(len(keep), -1)
        other = smaller[keep]
        if left:
            return Intervals(long[keep], one, of.mirror[own[keep]] + other, n[keep])
        return Intervals(long[keep], of.lo[own[keep]] + other, one, n[keep])

    def rank(self, left: bool, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``word`` occurs in a transform before ``row``, where it does occur at ``row``."""
        if left not in self.ranks:
            symbols = self.bwt if left else self.reverse
            place = np.empty(len(symbols), np.int64)
            place[ordered(symbols)] = np.arange(len(symbols))
            self.ranks[left] = place - self.before[symbols]
        return self.ranks[left][row]

    @property
    def ranks(self) -> dict[bool, np.ndarray]:
        return self.__dict__.setdefault("_ranks", {})


class Intervals:
    """Phrases (a row of word numbers each), where their rows start in either index, and how many rows they have."""

    def __init__(self, phrase: np.ndarray, lo: np.ndarray, mirror: np.ndarray, n: np.ndarray):
        self.phrase, self.lo, self.mirror, self.n = phrase, lo, mirror, n

    def where(self, some: np.ndarray) -> Intervals:
        return Intervals(self.phrase[some], self.lo[some], self.mirror[some], self.n[some])


def planes(symbols: np.ndarray) -> bytes:
    """The first bytes of all symbols, then the second ones and so on, which compress better than whole symbols."""
    return symbols.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def symbols(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The index of each shard: its languages, the first word number of each, its words, their counts, and both transforms."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SHARD_BYTES):
            by: dict[str, list[bytes]] = {}
            for t, k in zip(part.column("text"), part.column("lang").to_pylist(), strict=True):
                if t.is_valid:
                    by.setdefault(k, []).append(t)
            seq, langs, first, words = array("i", [0]), [], [], []
            for k in sorted(by):
                number = Numbers(1 + len(words))
                for t in by[k]:
                    for p in pieces(t.as_py()):
                        seq.extend(map(number.__getitem__, p))
                        seq.append(0)
                if number:
                    langs.append(k)
                    first.append(1 + len(words))
                    words += number
            if not words:
                continue
            whole = np.frombuffer(seq, np.int32)
            index = Index.built(whole)
            blocks = (b"\n".join(words), np.bincount(whole)[1:].astype(np.int32), planes(index.bwt), planes(index.reverse))
            cols = [pa.array([langs]), pa.array([first], pa.list_(pa.int32()))] + [pa.array([bytes(b)], pa.binary()) for b in blocks]
            yield pa.record_batch(cols, ["langs", "first", "words", "counts", "bwt", "reverse"])

    own = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return own.mapInArrow(step, SHARD)


class Shard:
    """A row of ``shards`` read back."""

    def __init__(self, row: dict):
        self.langs, self.first = row["langs"], np.array(row["first"])
        self.words = row["words"].split(b"\n")
        self.counts = np.frombuffer(row["counts"], np.int32)
        if "bwt" in row:
            self.index = Index(symbols(row["bwt"]), symbols(row["reverse"]) if "reverse" in row else None)

    def lang(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, number, side="right") - 1

    def hashes(self) -> np.ndarray:
        """A number for each word and language; number 0 has none."""
        tags = [xxhash.xxh64_intdigest(k.encode()) for k in self.langs]
        of = self.lang(np.arange(1, len(self.words) + 1)).tolist()
        return np.array([0] + [xxhash.xxh64_intdigest(w, tags[k]) for w, k in zip(self.words, of, strict=True)], np.uint64)

    def counted(self, phrase: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Phrases as rows of language, text and count, some at a time."""
        for i in range(0, len(n), ROWS):
            part = phrase[i : i + ROWS]
            own = [b" ".join(map(self.words.__getitem__, p)).decode() for p in (part - 1).tolist()]
            langs = pa.DictionaryArray.from_arrays(pa.array(self.lang(part[:, 0]), pa.int32()), pa.array(self.langs)).cast(pa.string())
            yield pa.record_batch([langs, pa.array(own), pa.array(n[i : i + ROWS], pa.int64())], ["lang", "phrase", "f"])


def mixed(words: np.ndarray) -> np.ndarray:
    """One number from the numbers of a phrase's words (a row each), in order."""
    out = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Field:
    """Bits of the hashes of frequent phrases; what isn't set is rare. The size is a power of two."""

    def __init__(self, size: int, blocks: dict[int, bytes]):
        self.size, self.bits = size, np.zeros((size + 7) // 8, np.uint8)
        for at, block in blocks.items():
            own = np.frombuffer(block, np.uint8)[: len(self.bits) - at]
            self.bits[at : at + len(own)] = own

    def __call__(self, words: np.ndarray) -> np.ndarray:
        slot = mixed(words) & np.uint64(self.size - 1)
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def field(hashes: DataFrame) -> Field:
    """The bit field of a table of hashes (h). Its size is bounded by FIELD; only its blocks reach the driver."""
    n = max(1, hashes.count()) * BITS
    size = min(FIELD, 1 << (n - 1).bit_length())
    slot = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    bits = hashes.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    return Field(size, {(r.b - 1) * 4096: bytes(r.bits) for r in bits.toLocalIterator()})


def hashes_of(words: DataFrame) -> DataFrame:
    """The hashes (h) of a table of single words (lang, phrase)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags: dict[str, int] = {}
            own = [xxhash.xxh64_intdigest(p.encode(), tags[k] if k in tags else tags.setdefault(k, xxhash.xxh64_intdigest(k.encode()))) for k, p in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(mixed(np.array(own, np.uint64)[:, None]).view(np.int64))], ["h"])

    return words.select("lang", "phrase").mapInArrow(step, "h long")


def summed(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def words_of(index: DataFrame) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = Shard(batch.slice(k, 1).to_pylist()[0])
                yield from s.counted(np.arange(1, len(s.words) + 1)[:, None], s.counts)

    return index.select("langs", "first", "words", "counts").mapInArrow(step, "lang string, phrase string, f long")


def pair_intervals(s: Shard, words: Field, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[Intervals, np.ndarray, np.ndarray]:
    """Pairs of words that may both be frequent (the words before each word), the words' hashes, and which may be frequent."""
    h = s.hashes()
    known = np.concatenate(([False], words(h[1:, None])))
    one = s.index.words()
    two = s.index.extended(one.where(known[one.phrase[:, 0]]), True, lambda p: known[p[:, 0]] & (passes(h[p]) if passes else True), both=False)
    return two, h, known


def pair_sums(index: DataFrame, words: Broadcast[Field], part: int) -> DataFrame:
    """Hashes of pairs (h) with their counts (f), summed over some shards of a task; those of one of the PASSES parts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, sums = keys[first].view(np.int64), np.add.reduceat(counts, first)
            for i in range(0, len(keys), ROWS):
                yield pa.record_batch([pa.array(keys[i : i + ROWS]), pa.array(sums[i : i + ROWS], pa.int64())], ["h", "f"])

        for batch in batches:
            for k in range(batch.num_rows):
                two, h, _ = pair_intervals(Shard(batch.slice(k, 1).to_pylist()[0]), words.value)
                hashes = mixed(h[two.phrase]) & np.uint64((1 << HASH) - 1)
                own = hashes % np.uint64(PASSES) == part
                held.append((hashes[own], two.n[own]))
                if sum(len(n) for _, n in held) > HELD:
                    yield from out()
                    held.clear()
        if sum(len(n) for _, n in held):
            yield from out()

    return index.drop("reverse").mapInArrow(step, "h long, f long")


def phrases_of(index: DataFrame, words: Broadcast[Field], pairs: Broadcast[Field], length: int) -> DataFrame:
    """Pairs that may be frequent, or triples of words whose two pairs may be: the words behind each such pair."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = Shard(batch.slice(k, 1).to_pylist()[0])
                two, h, known = pair_intervals(s, words.value, pairs.value)
                if length == 2:
                    yield from s.counted(two.phrase, two.n)
                    continue
                three = s.index.extended(two, False, lambda p, known=known, h=h: known[p[:, 2]] & pairs.value(h[p[:, 1:]]), both=False)
                yield from s.counted(three.phrase, three.n)

    return (index.drop("reverse") if length == 2 else index).mapInArrow(step, "lang string, phrase string, f long")


def scored(part: DataFrame, unigrams: DataFrame, pairs: DataFrame, cuts: list[tuple[int, int]], words: int) -> DataFrame:
    """Candidates of so many words with l and r of their lowest-scoring cut; the first of ``cuts`` wins ties."""
    ws, big = F.split("phrase", " "), "decimal(38,0)"
    out, options = part.withColumnRenamed("f", "a"), []
    for left, right in cuts:
        for k, n, start in ((f"l{left}", left, 1), (f"r{left}", right, 1 + left)):
            source = unigrams if n == 1 else pairs
            key = F.array_join(F.slice(ws, start, n), " ")
            out = out.withColumn("key", key).join(source.select("lang", F.col("phrase").alias("key"), F.col("f").alias(k)), ["lang", "key"]).drop("key")
        ratio = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l{left} as decimal(19,0)) * cast(r{left} as decimal(19,0)))")
        options.append(F.struct(ratio.cast("long").alias("score"), F.lit(left).alias("k"), F.col(f"l{left}").alias("l"), F.col(f"r{left}").alias("r")))
    best = options[0] if len(options) == 1 else F.array_min(F.array(*options))
    return out.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.lit(words).alias("words"))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, hides: int = HIDES) -> tuple[DataFrame, DataFrame]:
    """The rows of ``collocations`` without ``n``, and ``n`` by language."""
    spark = docs.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    index = written(shards(docs, text, lang), "collocations-index", "zstd", group=GROUP_BYTES)
    unigrams = written(summed(words_of(index), 1), "collocations-words", clean=True)
    share = spark.sparkContext.broadcast
    frequent = unigrams.where(F.col("f") >= least)
    words = share(field(hashes_of(frequent)))
    high = [pair_sums(index, words, k).groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("h") for k in range(PASSES)]
    pairs = share(field(reduce(DataFrame.unionByName, [written(h, "collocations-hashes", clean=True) for h in high])))
    # two passes, so that the shuffle files of one are gone before those of the other come
    two, three = (written(summed(phrases_of(index, words, pairs, n), least), f"collocations-{n}", clean=True) for n in (2, 3))
    ws = F.split("phrase", " ")
    inner = three.select("lang", F.explode(F.array(F.array_join(F.slice(ws, 1, 2), " "), F.array_join(F.slice(ws, 2, 2), " "))).alias("phrase"), F.col("f").alias("longer"))
    hidden = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    short = scored(two, frequent, two, [(1, 1)], 2).join(hidden, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < hides * F.col("a"))).drop("longer")
    both = short.unionByName(scored(three, frequent, two, [(1, 2), (2, 1)], 3))
    n = unigrams.groupBy("lang").agg(F.sum("f").alias("n"))
    return both, n


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, hides: int = HIDES) -> DataFrame:
    """All candidates that no longer one hides: lang, phrase, a, l, r, score, words, and n (all words of the language)."""
    both, n = counted(docs, text, lang, least, hides)
    return both.join(n, "lang")


def op13(docs: DataFrame, top: int = TOP) -> DataFrame:
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # first within parts of a language, so that what is left for one task is PARTS * top rows at most
    found, n = counted(docs)
    dealt = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    led = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = led.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def brute(rows: list[tuple[str | None, str | None]], least: int = LEAST, hides: int = HIDES, top: int = TOP) -> list[tuple]:
    """The contract by counting every phrase in a dictionary; for tests. ``rows`` are texts with languages."""
    f: dict[tuple[str, tuple[bytes, ...]], int] = {}
    n: dict[str, int] = {}
    for text, lang in rows:
        k = "und" if lang is None else lang
        for p in pieces((text or "").encode()):
            n[k] = n.get(k, 0) + len(p)
            for d in range(1, DEPTH + 1):
                for i in range(len(p) - d + 1):
                    key = (k, tuple(p[i : i + d]))
                    f[key] = f.get(key, 0) + 1
    hidden: dict[tuple, int] = {}
    for (k, p), a in f.items():
        if len(p) == 3 and a >= least:
            for q in (p[:2], p[1:]):
                hidden[k, q] = max(hidden.get((k, q), 0), a)
    found: dict[str, list[tuple]] = {}
    for (k, p), a in f.items():
        if len(p) > 1 and a >= least and not 100 * hidden.get((k, p), -1) >= hides * a:
            score, _, left, right = min((1000000 * a * a // (f[k, p[:c]] * f[k, p[c:]]), c, f[k, p[:c]], f[k, p[c:]]) for c in range(1, len(p)))
            found.setdefault(k, []).append((-score, -a, b" ".join(p), left, right))
    return [(k, i + 1, p.decode(), -a, left, right, n[k], -s) for k, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])]
