"""Byte-level BPE by replaying the merges over the words of a whole shard.

Every Spark task cuts its documents into shards of some megabytes. The distinct words of a shard lie in one array of
tokens, at first one a byte. An inverted index leads from each mergeable pair to its positions in that array. The pairs
are taken in rank order: all positions of a pair merge at once, only the neighbours of merged tokens are looked at again,
and the pairs that they form join the index. No step shuffles, a lost task is simply run again, and a shard needs memory
in proportion to its bytes.

A pair that a merge forms may have a lower rank than the pair just merged (the same bytes can be cut in several ways).
The index then takes the lower rank next, which is right unless the word still had further places of the first pair;
such words are replayed alone, one merge at a time. A word that is a token as a whole is that token, as in the library.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows are encoded each; special tokens
are ordinary text; further columns pass through, those named ``ids`` or ``decoded`` are replaced; an empty table gives an
empty one. ``decode`` turns a null list of ids into nothing and raises for an id that is no token.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LATIN, members
from .common import prepare, slices

#: Bytes of text whose distinct words are merged together.
SHARD_BYTES = 32 << 20
#: Bytes of text whose ids are given back at once.
SLICE_BYTES = 4 << 20
#: Fewer places of a pair than this are merged one by one.
FEW = 12


class Ranks:
    """A rank file: token bytes by rank, and for every cut of a token into two tokens the rank of the whole."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.none = 1 + max(self.rank.values())
        self.tokens = [b""] * self.none
        for t, r in self.rank.items():
            self.tokens[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pair = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.whole = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``none`` for those that don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.whole[at], self.none).astype(np.int32)

    def alone(self, word: bytes) -> list[int]:
        """One word by itself: the pair of lowest rank first, of equal ranks the leftmost."""
        ids, n = self.byte[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pair.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.pair.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k < n:
                prior[k] = i
                if (new := self.pair.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (new, i))
            if (p := prior[i]) >= 0 and (new := self.pair.get(ids[p] << 32 | r)) is not None:
                heapq.heappush(heap, (new, p))
        return [i for i in ids if i >= 0]


def distinct(held: list[np.ndarray | list[int]]) -> np.ndarray:
    places = np.sort(np.concatenate(held))
    return places[np.concatenate(([True], places[1:] != places[:-1]))]


class Replay:
    """The tokens of many words, merged together."""

    def __init__(self, ranks: Ranks, words: list[bytes]):
        self.ranks = ranks
        lengths = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(lengths)
        self.token = ranks.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(self.token)
        self.after = np.arange(1, n + 2, dtype=np.int32)
        self.prior = np.arange(-1, n, dtype=np.int32)
        self.after[self.ends[lengths > 0] - 1] = n  # place n stands for no place
        self.prior[(self.ends - lengths)[lengths > 0]] = n
        self.token = np.append(self.token, np.int32(ranks.none))
        self.alive = np.ones(n + 1, bool)
        self.alive[n] = False
        self.rank = np.full(n + 1, ranks.none, np.int32)
        inner = np.flatnonzero(self.after[:n] < n)
        self.rank[inner] = ranks.find(self.token[inner], self.token[inner + 1])
        self.index: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.odd: list[int] = []  # places in words that have to be replayed alone
        self.enter(inner)

    def enter(self, places: np.ndarray) -> None:
        """Put places into the index under the rank of their pair."""
        rank = self.rank[places]
        some = rank < self.ranks.none
        places, rank = places[some], rank[some]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        starts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        for r, a, b in zip(rank[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(rank)], strict=True):
            self.put(r, places[a:b])

    def put(self, r: int, places: np.ndarray | list[int]) -> None:
        if r in self.index:
            self.index[r].append(places)
        else:
            self.index[r] = [places]
            heapq.heappush(self.heap, r)

    def run(self) -> None:
        while self.heap:
            r = heapq.heappop(self.heap)
            held = self.index.pop(r)
            if sum(map(len, held)) < FEW:
                self.merge_few(r, sorted({int(i) for x in held for i in x}))
            else:
                places = distinct(held)
                self.merge(r, places[self.rank[places] == r])

    def merge_few(self, r: int, places: list[int]) -> None:
        token, after, prior, rank, n, pair, none = self.token, self.after, self.prior, self.rank, len(self.token) - 1, self.ranks.pair, self.ranks.none
        for i in places:
            if rank[i] != r:
                continue
            j = int(after[i])
            k, p = int(after[j]), int(prior[i])
            token[i], after[i], rank[j], self.alive[j] = r, k, none, False
            new = none
            if k < n:
                prior[k] = i
                new = pair.get(r << 32 | int(token[k]), none)
            for at, found in ((i, new), (p, pair.get(int(token[p]) << 32 | r, none) if p < n else none)):
                if at < n:
                    rank[at] = found
                    if found < none:
                        self.put(found, [at])
                        if found < r:
                            self.odd.append(at)

    def merge(self, r: int, places: np.ndarray) -> None:
        """Merge the pair of rank ``r`` at the given places (ascending); of places that overlap the leftmost goes first."""
        token, after, prior, rank, n = self.token, self.after, self.prior, self.rank, len(self.token) - 1
        chained = np.concatenate(([False], after[places[:-1]] == places[1:])) if len(places) else np.zeros(0, bool)
        if chained.any():
            at = np.arange(len(places))
            first = np.maximum.accumulate(np.where(chained, 0, at))
            places = places[(at - first) % 2 == 0]
        if not len(places):
            return
        gone = after[places]
        beyond = after[gone]
        waiting = np.isin(beyond, places, assume_unique=True)
        if waiting.any():  # pairs that exist only until the next place of this word merges
            early = self.ranks.find(np.full(int(waiting.sum()), r), token[beyond[waiting]])
            self.odd += places[waiting][early < r].tolist()
        token[places] = r
        after[places] = beyond
        prior[beyond] = places
        rank[gone] = self.ranks.none
        self.alive[gone] = False
        prior[n] = n
        left = prior[places]
        touched = distinct([places, left[left < n]])
        right = after[touched]
        found = np.where(right < n, self.ranks.find(token[touched], token[right]), self.ranks.none)
        rank[touched] = found
        self.odd += touched[found < r].tolist()
        self.enter(touched)


def merged(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and where each word's ids start (one more than there are words)."""
    whole = np.array([ranks.rank.get(w, -1) for w in words], np.int64)
    rest = np.flatnonzero(whole < 0)
    sizes = np.ones(len(words), np.int64)
    if len(rest):
        replay = Replay(ranks, [words[i] for i in rest.tolist()])
        replay.run()
        n = len(replay.token) - 1
        kept = np.flatnonzero(replay.alive[:n])
        flat, cuts = replay.token[kept], np.concatenate(([0], np.searchsorted(kept, replay.ends)))
        sizes[rest] = np.diff(cuts)
        odd = {int(i) for i in np.unique(np.searchsorted(replay.ends, np.array(replay.odd, np.int64), side="right"))} if replay.odd else set()
        redone = {i: ranks.alone(words[rest[i]]) for i in odd}
        for i, ids in redone.items():
            sizes[rest[i]] = len(ids)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(starts[-1], np.int32)
    known = np.flatnonzero(whole >= 0)
    out[starts[known]] = whole[known]
    if len(rest):
        same = np.ones(len(rest), bool)
        same[list(redone)] = False
        lengths = np.diff(cuts)
        take = np.repeat(same, lengths)
        place = np.repeat(starts[rest] - cuts[:-1], lengths) + np.arange(len(flat))
        out[place[take]] = flat[take]
        for i, ids in redone.items():
            out[starts[rest[i]] : starts[rest[i]] + len(ids)] = ids
    return out, starts


class Words(dict):
    """Numbers of words, in order of appearance."""

    def __init__(self):
        self.list: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.list)
        self.list.append(word)
        return n


class Splitter:
    """Text to words by a pattern whose classes for letters, numbers and white space are spelled out."""

    def __init__(self, pattern: str):
        self.any, self.latin = (re.compile(spelled(pattern, last)) for last in (sys.maxunicode, LATIN))
        self.beyond = re.compile(f"[^\x00-{chr(LATIN)}]")

    def words(self, text: str) -> list[str]:
        return (self.latin if text.isascii() or not self.beyond.search(text) else self.any).findall(text)


def spelled(pattern: str, last: int) -> str:
    own, out, inside, i = members(last), "", False, 0
    names = {r"\p{L}": own["L"], r"\p{N}": own["N"], r"\s": own["s"]}
    while i < len(pattern):
        name = next((x for x in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(x, i)), None)
        if name == r"\S":
            out += f"[^{own['s']}]"
        elif name:
            out += names[name] if inside else f"[{names[name]}]"
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out += pattern[i]
        i += len(name or " ")
    return out


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (binary: the ids decoded again) to ``docs``.

    ``rank_file`` is a path on the driver; its tables are broadcast (their size does not depend on the data). ``pattern``
    cuts a text into the words that are merged separately; it may use the classes of letters, numbers and white space.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("ids", "decoded")
    shared = spark.sparkContext.broadcast(Ranks(rank_file))
    keep = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = shared.value, Splitter(pattern)
        for shard in slices(batches, text, SHARD_BYTES):
            number, seen, ends = Words(), array("i"), [0]
            for chunk in shard.column(text).chunks:
                for t in chunk:
                    if t.is_valid:
                        seen.extend(map(number.__getitem__, split.words(t.as_py())))
                    ends.append(len(seen))
            flat, starts = merged(ranks, [w.encode() for w in number.list])
            del number
            words, ends = np.frombuffer(seen, np.int32) if seen else np.zeros(0, np.int32), np.array(ends, np.int64)
            sizes = np.diff(starts)
            at = 0
            for part in slices(iter(shard.to_batches()), text, SLICE_BYTES):
                cut = ends[at : at + part.num_rows + 1]
                at += part.num_rows
                own = words[cut[0] : cut[-1]]
                lengths = sizes[own]
                before = np.concatenate(([0], np.cumsum(lengths)))
                ids = flat[np.repeat(starts[own] - before[:-1], lengths) + np.arange(before[-1])]
                doc_ends = before[cut - cut[0]]
                lists = pa.ListArray.from_arrays(pa.array(doc_ends, pa.int32()), pa.array(ids, pa.int32()))
                tokens = list(map(ranks.tokens.__getitem__, ids.tolist()))
                texts = [b"".join(tokens[a:b]) for a, b in zip(doc_ends[:-1].tolist(), doc_ends[1:].tolist(), strict=True)]
                cols = [part.column(c).combine_chunks() for c in keep]
                yield from pa.table([*cols, lists, pa.array(texts, pa.binary())], names=[*keep, "ids", "decoded"]).to_batches()

    return docs.mapInArrow(step, schema)


def decode(coded: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) to a table with a column of ids."""
    spark = coded.sparkSession
    prepare(spark)
    coded = coded.drop("decoded")
    shared = spark.sparkContext.broadcast(Ranks(rank_file).tokens)
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(shared.value.__getitem__, x or [])) for x in batch.column(ids).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return coded.mapInArrow(step, schema)


def op12(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    coded = encode(docs.select("doc_id", "text"), rank_file, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
