"""BPE encoding and decoding with a minimal acyclic transducer for frequent words.

Spark counts the words of all documents; the most frequent ones are encoded once on the driver and compiled into a
shared-suffix automaton (Daciuk's construction over sorted words). Arcs carry numbers that add up to the word's place in
an id table, so the automaton is a transducer from word bytes to ids. It travels as a file through the shared folder and
is memory-mapped by every worker; words that it lacks are merged exactly, by lowest rank and then leftmost pair.

Normalisation and splitting follow the tokenizer file: special tokens are cut out of the raw text, the rest is composed
(NFC), lower-cased letter by letter and split by its pattern; white space goes. A file without a decoder decodes to its
token strings joined by one space.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded each; further
columns pass through, those named ``ids`` or ``decoded`` are replaced; a table without words gets an empty lexicon.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import sys
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, slices, work_dir, written

#: Words that the lexicon holds.
LEXICON_WORDS = 20_000
#: Encoded words that a worker remembers before it starts anew.
REMEMBERED = 1 << 19
#: Words longer than this many bytes are merged with a heap.
SHORT = 48
SLICE_BYTES = 4 << 20
#: Texts with no character beyond this one are split by a plain character list.
LATIN = 0x24F


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes take the letters from 256 on in order."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Merges:
    """The vocabulary and its merges, by ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for t, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = t
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the pair of lowest rank goes first, of equal ranks the leftmost."""
        ids = list(map(self.inner.__getitem__, word))
        ids[-1] = self.last[word[-1]]
        if len(ids) > SHORT:
            return self.merge_long(ids)
        get, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        ranks.append(none)
        while (best := min(ranks)) < none:
            at, new = ranks.index(best), made[best]
            ids[at] = new
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, none)
            if at + 1 < len(ids):
                ranks[at] = get(new << 20 | ids[at + 1], none)
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        n, get = len(ids), self.ranks.get
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            new = self.made[rank]
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                prior[after[j]] = i
                if (p := get(new << 20 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (p, i, new, ids[after[j]]))
            if (k := prior[i]) >= 0 and (p := get(ids[k] << 20 | new)) is not None:
                heapq.heappush(heap, (p, k, ids[k], new))
        return tuple(i for i in ids if i >= 0)


#: Fixed values. Letters and numbers that Unicode 16 adds to the tables of Python's unicodedata (15.1).
LETTERS_ADDED = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NUMBERS_ADDED = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Small letters of capitals that Unicode 16 and 17 add: capital, small letter, how many in a row.
LOWER_ADDED = ((0x1C89, 0x1C8A, 1), (0xA7CB, 0x0264, 1), (0xA7CC, 0xA7CD, 1), (0xA7CE, 0xA7CF, 1), (0xA7D2, 0xA7D3, 1), (0xA7D4, 0xA7D5, 1), (0xA7DA, 0xA7DB, 1), (0xA7DC, 0x019B, 1), (0x10D50, 0x10D70, 22), (0x16EA0, 0x16EBB, 25))
LOWERED = {a + k: b + k for a, b, n in LOWER_ADDED for k in range(n)}


#: Characters that the library's normalisation, of Unicode 9, does not know: nothing is reordered or composed across them.
UNKNOWN_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A"
    " 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def added(ranges: str) -> set[int]:
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return {c for r in ends for c in range(r[0], r[-1] + 1)}


def members(last: int) -> dict[str, str]:
    """The characters up to ``last`` of the classes for letters, numbers and white space, as ranges of a pattern."""
    more = {"L": added(LETTERS_ADDED), "N": added(NUMBERS_ADDED)}
    kinds = {k: [c for c in range(last + 1) if unicodedata.category(chr(c))[0] == k or c in more[k]] for k in "LN"}
    kinds["s"] = [c for c in range(last + 1) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    out = {}
    for k, own in kinds.items():
        starts = [c for c, d in zip(own, [-2, *own], strict=False) if c != d + 1]
        ends = [c for c, d in zip(own, [*own[1:], -2], strict=True) if d != c + 1]
        out[k] = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in zip(starts, ends, strict=True))
    return out


def explicit(pattern: str, last: int) -> re.Pattern[str]:
    """A pattern in which the classes for letters, numbers and white space list their characters up to ``last``."""
    own = members(last)
    for name, k in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "s")):
        pattern = pattern.replace(name, own[k])
    return re.compile(pattern)


class Splitter:
    """Raw text to words and special tokens."""

    def __init__(self, merges: Merges):
        self.word, self.latin_word = explicit(merges.pattern, sys.maxunicode), explicit(merges.pattern, LATIN)
        self.beyond, self.capital = re.compile(f"[^\x00-{chr(LATIN)}]"), re.compile(f"[{''.join(map(chr, LOWERED))}]")
        self.unknown = re.compile(f"([{''.join(map(chr, sorted(added(UNKNOWN_MARKS))))}])")
        self.special = merges.special
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(merges.special, key=len, reverse=True)) or r"(?!)")

    def composed(self, text: str) -> str:
        if self.unknown.search(text):
            return "".join(unicodedata.normalize("NFC", part) for part in self.unknown.split(text))
        return unicodedata.normalize("NFC", text)

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin_word.findall(text.lower())
        text = self.composed(text).replace("Σ", "σ").lower()
        if not self.beyond.search(text):
            return self.latin_word.findall(text)
        if self.capital.search(text):
            text = text.translate(LOWERED)
        return self.word.findall(text)

    def parts(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Stretches of words, each with the id of the special token behind it."""
        at = 0
        if "<" in text or not all("<" in s for s in self.special):
            for m in self.cut.finditer(text):
                yield self.plain(text[at : m.start()]), self.special[m.group()]
                at = m.end()
        yield self.plain(text[at:] if at else text), None


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The automaton and its id table as one block of 32-bit numbers.

    Head: states, letter classes, words, ids. Then a class for each byte (0: none), for each state and class the next
    state (0: none) and the number that the arc adds, for each state whether a word ends there, where the ids of each
    word start, and all ids. State 1 is the start.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = [(False, ()), (False, ())]
    counts = [0, 0]

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(int(node[0]) + sum(counts[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[False, []]]  # nodes of the last word: [final, arcs]
    labels: list[int] = []
    ordered = sorted(w for w in entries if w)
    for w in ordered:
        k = 0
        while k < len(labels) and k < len(w) and labels[k] == w[k]:
            k += 1
        while len(labels) > k:
            done = frozen(path.pop())
            path[-1][1].append((labels.pop(), done))
        for b in w[k:]:
            path.append([False, []])
            labels.append(b)
        path[-1][0] = True
    while labels:
        done = frozen(path.pop())
        path[-1][1].append((labels.pop(), done))
    states[1] = (path[0][0], tuple(path[0][1]))
    used = sorted({b for _, arcs in states for b, _ in arcs})
    classes = np.zeros(256, np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    nxt, add = np.zeros((len(states), width), np.int32), np.zeros((len(states), width), np.int32)
    for s, (final, arcs) in enumerate(states):
        seen = int(final)
        for b, t in arcs:
            nxt[s, classes[b]], add[s, classes[b]] = t, seen
            seen += counts[t]
    final = np.array([int(f) for f, _ in states], np.int32)
    ids = [entries[w] for w in ordered]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.array([i for x in ids for i in x], np.int32)
    head = np.array([len(states), width, len(ids), len(flat)], np.int32)
    return b"".join(x.tobytes() for x in (head, classes, nxt, add, final, starts, flat))


class Lexicon:
    """A compiled lexicon on a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        cells = memoryview(self.map).cast("i")
        n, self.width, w, m = cells[:4].tolist()
        sizes, at, views = (256, n * self.width, n * self.width, n, w + 1, m), 4, []
        for size in sizes:
            views.append(cells[at : at + size])
            at += size
        self.classes, self.next, self.add, self.final, self.starts, self.ids = views

    def find(self, word: bytes) -> tuple[int, ...] | None:
        state, number, width, classes, nxt, add = 1, 0, self.width, self.classes, self.next, self.add
        for b in word:
            cell = state * width + classes[b]
            state = nxt[cell]
            if not state:
                return None
            number += add[cell]
        if not self.final[state]:
            return None
        return tuple(self.ids[self.starts[number] : self.starts[number + 1]])


class Known(dict):
    """Ids of words met before; a new word is looked up in the lexicon, else merged."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        ids = self.lexicon.find(raw) if self.lexicon else None
        if ids is None:
            ids = self.merges.merge(raw)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(raw) <= 256:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts through the lexicon, with exact merges for the rest."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.split, self.known = merges, Splitter(merges), Known(merges, lexicon)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for words, special in self.split.parts(text or ""):
            out.extend(chain.from_iterable(map(self.known.__getitem__, words)))
            if special is not None:
                out.append(special)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.merges.tokens.__getitem__, ids))


OPEN: dict[str, Encoder] = {}


def frequent_words(docs: DataFrame, merges: Merges, text: str, n: int) -> list[str]:
    """The most frequent words of all documents, ``n`` at most: those above a frequency level that fits."""
    shared = docs.sparkSession.sparkContext.broadcast(merges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Splitter(shared.value), Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for words, _ in split.parts(t or ""):
                    seen.update(words)
                if len(seen) > REMEMBERED:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counts = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where((F.col("n") > 1) & (F.length("word") <= 256)), "word-counts")
    level = F.floor(F.log2("n") * 16).cast("int").alias("level")  # at most a thousand levels
    held, least = 0, None
    for r in counts.groupBy(level).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect():
        held += r.k
        if held > n:
            break
        least = r.level
    if least is None:
        return []
    return [r.word for r in counts.where(F.floor(F.log2("n") * 16) >= least).select("word").collect()]  # n words at most


def published(spark: SparkSession, block: bytes, name: str) -> None:
    """Put a file into the shared folder and hand it to all workers, present and later ones."""
    path = f"{work_dir(spark)}/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target)
    stream.write(block)
    stream.close()
    spark.sparkContext.addFile(path)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (the ids decoded again) to ``docs``.

    ``tokenizer`` is the path of a tokenizer file on the driver; its tables are broadcast (their size does not depend on
    the data).
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("ids", "decoded")
    merges = Merges(tokenizer)
    lexicon = {w.encode(): merges.merge(w.encode()) for w in frequent_words(docs, merges, text, lexicon_words)}
    name = f"lexicon-{uuid.uuid4().hex}"
    published(spark, compile_lexicon(lexicon), name)
    shared = spark.sparkContext.broadcast(merges)
    keep = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in OPEN:
            OPEN.clear()
            OPEN[name] = Encoder(shared.value, Lexicon(SparkFiles.get(name)))
        encoder = OPEN[name]
        for part in slices(batches, text, SLICE_BYTES):
            flat, ends, decoded = array("i"), [0], []
            for t in part.column(text).to_pylist():
                ids = encoder.encode(t)
                flat.extend(array("i", ids))
                ends.append(len(flat))
                decoded.append(encoder.decode(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            cols = [part.column(c).combine_chunks() for c in keep]
            yield from pa.table([*cols, lists, pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"]).to_batches()

    return docs.mapInArrow(step, schema)


def op2(docs: DataFrame, tokenizer: str) -> DataFrame:
    coded = encode(docs.select("doc_id", "text"), tokenizer)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
