"""Suffix-array dedup of repeated byte strings by distributed rank refinement.

Two equal strings of ``LENGTH`` bytes are found without a row for every byte position. Positions are grouped by anchors:
the smallest hash of a 37-byte gram within the string, which both occurrences share. All starts with one anchor form a
run, and only runs whose anchor gram repeats go on. From there the ranks are refined as in prefix doubling: Spark groups
positions by the rank of a string that all of them share, first 37 bytes, then 85, 97 and 100, so that each round takes
three quarters off what is missing to the threshold. A group's rank is its first position. Positions whose rank is unique
leave; runs that agree whole are decided at once (all but the first start earlier elsewhere); only runs that agree in
part are cut in four, as one run at each end of a repeated passage does. The rounds end past the threshold.

Tasks hold the hashes of half a megabyte at a time; hot strings are pre-aggregated before the shuffle and never gathered.
Two bit fields of a fixed size spare the second and third reading most rows; they decide nothing. Runs count as equal when
two hashes of 64 bits agree (of the shared string and of all bytes); bytes are not compared again.

Defined results: a null or empty text has no bytes; a null ``doc_id`` comes before all others; rows that repeat with
their ``doc_id`` and text count as one document and get one result each; strings are judged on the input; extra columns
are ignored; ids that are not whole numbers raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, written

LENGTH = 100
#: Starts that one anchor can have: places 0 to 63 before it.
PLACES = 64
GRAM = LENGTH - PLACES + 1
SLICE_BYTES = 8 << 20
#: Bytes of a long text that are hashed at once, and the bits of a position within them.
PIECE = 1 << 19
AT = np.uint64((1 << 20) - 1)
BITS = 1 << 26
BUCKETS = 1 << 19
NONE = -(1 << 63)
LETTER = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all grams of a byte array, by doubling."""
    h, size = LETTER[raw], 1
    while size < GRAM:
        step = min(size, GRAM - size)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[step:]
        size += step
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    rows = -(-len(x) // width)
    y = np.full(rows * width, np.uint64(2**64 - 1))
    y[: len(x)] = x
    y = y.reshape(rows, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


#: Where grams start that together cover a run's bytes, beside its last gram.
COVER = (0, GRAM, 2 * GRAM, 3 * GRAM)


@dataclass
class Runs:
    """Runs of starts with one anchor: the anchor's gram hash, a hash of all bytes and of the place of the anchor, the number
    of the text, the first start in it, how far the anchor is from there, and how many starts there are."""

    gram: np.ndarray
    s: np.ndarray
    text: np.ndarray
    p: np.ndarray
    back: np.ndarray
    n: np.ndarray

    def where(self, keep: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f.name)[keep] for f in fields(self)))


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = (out ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def runs(texts: list[bytes], whole: bool = True) -> Iterator[Runs]:
    """Runs of all texts, which are hashed end to end in pieces; no run crosses from one text to the next. Without ``whole``
    the hash of all bytes is left out."""
    flat = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    cuts = np.unique(np.concatenate([begins, np.maximum(begins, ends - LENGTH + 1)]))  # where texts and their last starts end
    for begin in range(0, len(flat) - LENGTH + 1, PIECE):
        raw = np.frombuffer(flat, np.uint8, min(PIECE + LENGTH - 1, len(flat) - begin), begin)
        h = gram_hashes(raw)
        low = sliding_min((h & ~AT) | np.arange(len(h), dtype=np.uint64), PLACES)
        anchor = (low & AT).astype(np.int64)
        edge = np.empty(len(anchor), bool)
        edge[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=edge[1:])
        own = cuts[np.searchsorted(cuts, begin) : np.searchsorted(cuts, begin + len(anchor))]
        edge[own - begin] = True
        first = np.flatnonzero(edge)
        end = np.append(first[1:], len(anchor))
        text = np.searchsorted(ends, first + begin, side="right")
        fits = ends[text] - (first + begin) >= LENGTH
        first, end, text = first[fits], end[fits], text[fits]
        at = anchor[first]
        content = h[at].view(np.int64)
        if whole:
            last = end + LENGTH - GRAM - 1
            content = mixed([*(h[np.minimum(first + k, last)] for k in COVER), h[last], end - first, at - first])
        yield Runs(h[at].view(np.int64), content, text, first + begin - begins[text], at - first, end - first)


def marks(gram: np.ndarray, s: np.ndarray, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The bit that stands for a run; ``mark_of`` is its twin over columns."""
    return (gram ^ s ^ (p << 3) ^ ((doc & 0xFFFFFFFF) << 9)) & (BITS - 1)


def mark_of() -> Column:
    doc = F.shiftleft(F.col("doc").bitwiseAND(F.lit(0xFFFFFFFF)), 9)
    return F.col("key").bitwiseXOR(F.col("s")).bitwiseXOR(F.shiftleft(F.col("p").cast("long"), 3)).bitwiseXOR(doc).bitwiseAND(F.lit(BITS - 1))


#: A run: its key, the hash of all its bytes, its document, its first start, how far the anchor is from there, how many
#: starts it has, whether an equal run of the same slice comes before it, and its bytes where they are needed.
RUN = "key long, s long, doc long, t long, p int, back int, n int, later boolean, content binary"
NAMES = ("key", "s", "doc", "t", "p", "back", "n", "later", "content")
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())


def batch_of(key: np.ndarray, s: np.ndarray, doc: np.ndarray, t: np.ndarray, p: np.ndarray, back: np.ndarray, n: np.ndarray, content: np.ndarray | None) -> pa.RecordBatch:
    """Rows of runs; of equal runs all but the first are marked as later, and only their starts are kept."""
    order = np.lexsort((p, t, doc, s, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (s[order][1:] != s[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.empty(len(order), bool)
    later[order] = (doc[order] != doc[first]) | (t[order] != t[first]) | (p[order] != p[first])  # repeated rows share a place
    gone = [later, later, None, None, None, later, None, None]
    cols = [pa.array(c, k, mask=m) for c, k, m in zip((key, s, doc, t, p, back, n, later), KINDS, gone, strict=False)]
    return pa.record_batch([*cols, pa.nulls(len(key), pa.binary()) if content is None else pa.array(content, pa.binary(), mask=later)], list(NAMES))


def run_rows(docs: DataFrame, bits, rows: bool = False) -> DataFrame:
    """Runs whose gram (with ``rows``: whose own mark) has its bit set; with ``rows`` each carries its bytes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            doc, t = part.column("doc").to_numpy(), part.column("t").to_numpy()
            texts = [x or b"" for x in part.column("text").to_pylist()]
            for own in runs(texts):
                at = marks(own.gram, own.s, doc[own.text], own.p) if rows else own.gram
                own = own.where(is_set(bits.value, at))
                content = None
                if rows:
                    content = np.empty(len(own.p), object)
                    content[:] = [texts[k][a : a + b + LENGTH - 1] for k, a, b in zip(own.text.tolist(), own.p.tolist(), own.n.tolist(), strict=True)]
                yield batch_of(own.gram, own.s, doc[own.text], t[own.text], own.p, own.back, own.n, content)

    return docs.mapInArrow(step, RUN)


def gram_counts(docs: DataFrame) -> DataFrame:
    """Low halves of the gram hashes of runs that occur more than once; they only set bits."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            found = [own.gram.astype(np.int32) for own in runs([x or b"" for x in part.column("text").to_pylist()], whole=False)]
            used, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(used), pa.array(np.minimum(n, 2).astype(np.int8))], ["g", "n"])

    return docs.select("text").mapInArrow(step, "g int, n tinyint").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("g").cast("long").alias("g"))


def bit_field(df: DataFrame, column: Column) -> np.ndarray:
    """Which of ``BITS`` bits the values of a column set; made in Spark, of a fixed size."""
    at = column.bitwiseAND(F.lit(BITS - 1))
    per = df.groupBy(F.bitmap_bucket_number(at + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in per.toLocalIterator():
        begin = (r.bucket - 1) * len(r.bits)
        out[begin : begin + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def is_set(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at & (BITS - 1)
    return (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def cut(df: DataFrame, size: int) -> DataFrame:
    """Cut runs at multiples of ``size`` places before their anchor; the key is what all starts of such a block share."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for doc, t, p, back, n, content in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "p", "back", "n", "content")), strict=True):
                low = back - n + 1
                for block in range(low // size, back // size + 1):
                    top, bottom = min(back, block * size + size - 1), max(low, block * size)
                    core = content[back - block * size : back + LENGTH - block * size - size + 1]
                    hull = content[back - top : back - bottom + LENGTH]
                    out.append((digest(core, block), digest(hull, top), doc, t, p + back - top, top, top - bottom + 1, hull))
            key, s, *rest, content = zip(*out, strict=True) if out else ((),) * 8
            hashes = (np.array(x, np.uint64).view(np.int64) for x in (key, s))
            yield batch_of(*hashes, *(np.array(x, np.int64) for x in rest), np.array(content, object))

    return df.select("doc", "t", "p", "back", "n", "content").mapInArrow(step, RUN)


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with an equal run before them, so that all their starts are repeats; and runs that are the first of their kind,
    but whose key has other kinds. All others leave. Minima are pre-aggregated and joined back, so no key is gathered: first
    by key alone, which decides all keys of one kind, then by kind."""
    rows = written(rows, "substring-runs")
    own = rows.where(~F.col("later"))
    place, starts = F.struct("doc", "t", "p"), ("doc", "t", "p", "n")
    keys = own.groupBy("key").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.min(place).alias("first"), F.count(F.lit(1)).alias("k"))
    keys = written(keys.where("k > 1").select("key", "first", (F.col("low") < F.col("high")).alias("several")), "substring-keys")
    met = own.join(keys, "key").where(F.col("several") | (place > F.col("first")))
    met = written(met.select("key", "s", *starts, "back", "content", "several"), "substring-met")
    mixed = met.where("several")
    kinds = written(mixed.groupBy("key", "s").agg(F.min(F.struct("doc", "t", "p", "back", "n", "content")).alias("first")), "substring-kinds")
    named = kinds.select("key", "s", F.struct("first.doc", "first.t", "first.p").alias("first"))
    again = mixed.join(named, ["key", "s"]).where(place > F.col("first"))
    later = rows.where("later").select(*starts).unionByName(met.where("not several").select(*starts)).unionByName(again.select(*starts))
    return written(later, "substring-later"), kinds.select("key", "s", "first.*")


def repeated(docs: DataFrame) -> DataFrame:
    """Runs of starts (``doc``, ``t``, ``p``, ``n``) whose string of ``LENGTH`` bytes also starts earlier."""
    spark = docs.sparkSession
    grams = written(gram_counts(docs), "substring-grams")
    bits = spark.sparkContext.broadcast(bit_field(grams, F.col("g")))
    out, parts = ranked(run_rows(docs, bits))
    bits = spark.sparkContext.broadcast(bit_field(parts, mark_of()))
    whole = run_rows(docs, bits, rows=True).select("doc", "t", "p", "content")
    current = written(parts.drop("content", "key", "s").join(whole, ["doc", "t", "p"]), "substring-parts")
    size = PLACES // 4
    while size and not current.isEmpty():
        later, current = ranked(cut(current, size))
        out = out.unionByName(later)
        size //= 4
    return out


def removed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes) and ``spans`` for every row."""
    prepare(docs.sparkSession)
    if docs.schema[id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id} must hold whole numbers, for they order the documents")
    raw = F.col(text).cast("binary")
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(id).cast("long"), F.lit(NONE)).alias("doc"), raw.alias("text"))
    again = own.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = own.withColumn("t", F.lit(0).cast("long") if again.isEmpty() else F.xxhash64("text"))  # only tells rows of one id apart
    starts = repeated(own.select("doc", "t", "text")).distinct()
    per = starts.groupBy("doc", "t").agg(F.collect_list(F.struct("p", "n")).alias("starts"))  # a document's own runs

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(part.column("text").to_pylist(), part.column("starts").to_pylist(), strict=True):
                text = text or b""
                spans: list[list[int]] = []
                for p, n in sorted((x["p"], x["n"]) for x in found or ()):
                    if spans and p <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], p + n - 1 + LENGTH)
                    else:
                        spans.append([p, p + n - 1 + LENGTH])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                for x, v in zip(out, (len(text), sum(b - a for a, b in spans), len(spans), b"".join(kept), spans), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
            cols = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            yield from pa.table([part.column("id"), *cols], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]).to_batches()

    kind = docs.schema[id].dataType.simpleString()
    # texts without a start of their own need no join: their bucket tells, of a number that does not grow
    bucket = F.pmod(F.xxhash64("doc", "t"), F.lit(BUCKETS)).alias("bucket")
    per = written(per, "substring-starts")
    touched = per.select(bucket).distinct().withColumn("some", F.lit(True))
    own = own.withColumn("bucket", bucket).join(F.broadcast(touched), "bucket", "left")
    met = own.where("some").join(per, ["doc", "t"], "left").select("id", "text", "starts")
    joined = met.unionByName(own.where("some is null").select("id", "text", F.lit(None).cast(per.schema["starts"].dataType).alias("starts")))
    out = joined.mapInArrow(step, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>")
    return out.withColumnRenamed("id", id)


def op10(docs: DataFrame) -> DataFrame:
    out = removed(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The contract with a table of all strings; for tests. Rows of one id and text count as one document."""
    first: dict[bytes, tuple[int, int]] = {}
    for d, text in sorted({(d, t or "") for d, t in rows}):
        raw = text.encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], (d, p))
    out = []
    for d, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (d, p):
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone[:-1].astype(np.int8), [0]))) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]) if raw else b""
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
