"""Language-model scoring by online logistic context mixing.

A token is coded as binary decisions on a prefix tree: frequent words have leaves of their own, every other word goes to
the leaf of its first byte. Hashed-context bit predictors hold how often each decision fell either way: in general, after
the word before, after the two words before, and in the document so far. A gate (how much each context has been seen, and
the depth) selects the weights that mix their log odds; a second stage refines the mixed chance by its recent errors in
the same gate (an adaptive probability map). Behind a first-byte leaf a word of the training documents follows by its count, any other word is spelled: its bytes are eight
decisions each, mixed in the same way from contexts within the word. So the chances of all texts add up to one.

Spark does the gathering. Documents become word numbers in chunks of bounded size, once, and all passes read these; the
distinct words of a chunk are counted, added up over all chunks, and the counts go back to the chunks that hold the words. The tree is made from
the counts of all training documents, the decision counts are those of all of them and of all distinct words, added up block
by block. Weights and maps are fitted to all training documents too: these are in two folds by their text, and each decision
is judged by the counts of the other fold, as a text that the counts do not know; a word that is met once is judged by the
spellings of all others. Such decisions are counted by gate and rounded log odds, and Newton's steps find the likeliest weights
for these counts. All sums are of whole numbers, so nothing depends on how rows are dealt to tasks. The tables that travel to
all executors have fixed sizes; the word counts, which grow with the corpus, stay in Spark. While a document is scored, its
own contexts adapt; they start anew after ``STRETCH`` tokens, which bounds the memory of a long text.

Defined results: a null or empty text is one end token; a null ``doc_id`` counts as a training document; repeated rows
are scored each and counted each; without training documents all counts are zero; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, slices, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = b"\n"
#: Words with a leaf of their own.
LEAVES = 1500
#: Counter slots of the context of two words; one word has a counter for each pair of leaves.
SLOTS = 1 << 21
#: Counter slots of the speller's contexts: two to four bytes before, and the word so far.
SPELL_SLOTS = (1 << 17, 1 << 18, 1 << 18, 1 << 19)
SPELL_START = np.concatenate(([0], np.cumsum(SPELL_SLOTS)))
CHUNK_BYTES = 16 << 20
#: Bytes of words that wait to be spelled.
SLICE_BYTES = 4 << 20
#: Tokens after which a document's own contexts start anew, and tokens that are coded at once.
STRETCH, BATCH = 1 << 15, 1 << 12
#: Words that are spelled at once, those that wait to be dealt into such batches by their length, and bytes from which on
#: their contexts are shorter.
SPELL_BATCH, SPELL_HELD, LONG = 1 << 12, 1 << 16, 64
BLOCK = 1 << 13
#: Steps of the probability maps over log odds from -8 to 8, and parts of a step within which the chance is the same.
STEPS, PARTS = 33, 16
#: How much the former weights and maps count for against the decisions that they are fitted to, and steps of the fit.
WEIGHT_PRIOR, MAP_PRIOR, FIT_STEPS = 4.0, 60.0, 14
#: Rounded log odds: the least of each level above zero, and what stands for the levels.
BOUNDS, CENTRES = (0.375, 1.25, 2.25, 3.5, 5.25), (0.75, 1.75, 3.0, 4.25, 6.5)
LEVELS = 2 * len(BOUNDS) + 1
VALUES = np.array([*(-x for x in CENTRES[::-1]), 0.0, *CENTRES])
LEVEL = np.searchsorted([*(-x for x in BOUNDS[::-1]), *BOUNDS], np.arange(256) / 8 - 16 + 1 / 16).astype(np.int32)
PRIOR = np.float32(0.05)
#: Of the tables' own type, else numpy adds several times as slowly.
ONE = np.int32(1)


def tokens(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def hashed(x: np.ndarray) -> np.ndarray:
    out = x >> np.uint64(32)
    out ^= x
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def levels(n: np.ndarray, *bounds: int) -> np.ndarray:
    """How many of the bounds are exceeded."""
    out = np.zeros(n.shape, np.int64)
    for b in bounds:
        out += n > b
    return out


def level(odds: np.ndarray) -> np.ndarray:
    """Rounded log odds."""
    return LEVEL[((odds + 16) * 8).astype(np.int16)]


class Mixer:
    """Weights and probability maps by gate."""

    def __init__(self, gates: int, inputs: int):
        self.weights = np.full((gates, inputs), 1.0 / inputs, np.float32)
        line = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
        self.maps = np.tile(line.astype(np.float32), (gates, 1))
        self.costs: np.ndarray | None = None

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed log odds, and the cell of the refined chance that they fall into."""
        weights = np.ascontiguousarray(self.weights.T)
        dot = weights[0].take(gate) * odds[0]
        for k in range(1, len(odds)):
            dot += weights[k].take(gate) * odds[k]
        np.clip(dot, -8, 7.999, out=dot)
        return dot, gate * ((STEPS - 1) * PARTS) + ((dot + 8) * ((STEPS - 1) * PARTS / 16)).astype(np.int32)

    def chances(self) -> np.ndarray:
        """The refined chance of each cell: the mean of the mixed one and of the map."""
        at = (np.arange((STEPS - 1) * PARTS) + 0.5) / PARTS
        low = at.astype(np.int64)
        refined = self.maps[:, low] * (1 - (at - low)) + self.maps[:, low + 1] * (at - low)
        return np.clip((1 / (1 + np.exp(8 - at * 16 / (STEPS - 1))) + refined) / 2, 1e-5, 1 - 1e-5).ravel()

    def bits(self, odds: np.ndarray, gate: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits that decisions ``y`` take. ``odds``: log odds (inputs x decisions)."""
        if self.costs is None:
            p = self.chances()
            self.costs = -np.log2(np.stack([1 - p, p], 1)).ravel()
        return self.costs.take(self.mixed(odds, gate)[1] * 2 + y)

    def fit(self, table: np.ndarray) -> None:
        """The likeliest weights, and the maps, for decisions counted by gate, rounded log odds of all inputs, and bit."""
        gates, inputs = self.weights.shape
        table = table[: gates * LEVELS**inputs * 2].reshape(-1, 2)
        used = np.flatnonzero(table.any(axis=1))
        n0, n1 = table[used].T.astype(np.float64)
        gate, rest = np.divmod(used, LEVELS**inputs)
        odds = [VALUES[rest // LEVELS**k % LEVELS] for k in range(inputs)]

        def dots(weights: np.ndarray) -> np.ndarray:
            return np.clip(sum(weights[gate, k] * odds[k] for k in range(inputs)), -8, 7.999)

        start = self.weights.astype(np.float64)
        best, cost, way, share = start, np.full(gates, np.inf), np.zeros((gates, inputs)), np.ones(gates)
        for _ in range(FIT_STEPS):
            new = best + share[:, None] * way
            dot = dots(new)
            now = np.bincount(gate, n0 * np.logaddexp(0, dot) + n1 * np.logaddexp(0, -dot), gates) + WEIGHT_PRIOR / 2 * ((new - start) ** 2).sum(axis=1)
            good = now < cost
            best, cost, share = np.where(good[:, None], new, best), np.where(good, now, cost), np.where(good, 1.0, share / 2)
            p = 1 / (1 + np.exp(-dots(best)))
            error, curve = n1 - (n0 + n1) * p, (n0 + n1) * p * (1 - p)
            slope = np.stack([np.bincount(gate, error * x, gates) for x in odds], 1) - WEIGHT_PRIOR * (best - start)
            bend = np.stack([np.bincount(gate, curve * x * y, gates) for x in odds for y in odds], 1).reshape(gates, inputs, inputs)
            way = np.linalg.solve(bend + WEIGHT_PRIOR * np.eye(inputs), slope[:, :, None])[:, :, 0]
        self.weights = best.astype(np.float32)
        near = gate * STEPS + np.rint((dots(best) + 8) * ((STEPS - 1) / 16)).astype(np.int64)
        ones, both = (np.bincount(near, x, gates * STEPS).reshape(gates, STEPS) for x in (n1, n0 + n1))
        self.maps = ((self.maps * MAP_PRIOR + ones) / (MAP_PRIOR + both)).astype(np.float32)
        self.costs = None


# The prefix tree


def prefix_tree(weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's tree: depth of each leaf, and the inner nodes and bits on the way to it, padded."""
    heap: list[tuple[float, int]] = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    n = len(weights)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        above[x], above[y] = (n, 0), (n, 1)
        heapq.heappush(heap, (a + b, n))
        n += 1
    ways = []
    for leaf in range(len(weights)):
        way, at = [], leaf
        while at in above:
            at, bit = above[at]
            way.append((n - 1 - at, bit))  # the root is node 0
        ways.append(way[::-1])
    depth = np.array([len(w) for w in ways], np.int64)
    nodes, bits = np.zeros((len(ways), depth.max()), np.int32), np.zeros((len(ways), depth.max()), np.int8)
    for leaf, way in enumerate(ways):
        for k, (node, bit) in enumerate(way):
            nodes[leaf, k], bits[leaf, k] = node, bit
    return depth, nodes, bits


def before(keys: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each decision how often earlier ones with its key were zero and one. Keys of 40 bits, a million decisions."""
    packed = keys << 22
    packed += np.arange(0, 2 * len(keys), 2)
    packed += y
    packed.sort()
    ones = (packed & 1).astype(np.int32)
    total, at = np.cumsum(ones, dtype=np.int32), np.arange(len(keys), dtype=np.int32)
    total -= ones
    new = np.ones(len(keys), bool)
    np.greater((packed[1:] ^ packed[:-1]) >> 22, 0, out=new[1:])
    order = (packed >> 1) & ((1 << 21) - 1)
    n1 = np.empty(len(keys), np.int32)
    n = np.empty(len(keys), np.int32)
    n1[order] = total - np.maximum.accumulate(np.where(new, total, 0))  # totals do not fall
    n[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return n - n1, n1


@dataclass
class Decisions:
    """Decisions of a batch of tokens: how many each token has, their cell among the ways to the leaves, node and bit, and the
    slots of one and of two words."""

    size: np.ndarray
    cell: np.ndarray
    node: np.ndarray
    y: np.ndarray
    one: np.ndarray
    two: np.ndarray

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.node, self.one, self.two


class Tree:
    """The leaves of words and the decisions of token sequences."""

    def __init__(self, top: list[bytes], counts: list[int], classes: np.ndarray):
        self.top = {w: k for k, w in enumerate(top)}
        self.depth, self.nodes, self.bits = prefix_tree([*map(float, counts), *(classes + 0.5)])
        self.size = len(self.depth)
        #: By cell: the node, what it adds to the hash of two words, the bit, and the depth's part of the gate.
        self.node_of = self.nodes.ravel().astype(np.int64)
        self.salt_of = self.node_of.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        self.bit_of = self.bits.ravel().astype(np.int64)
        self.deep_of = np.tile(levels(np.arange(self.nodes.shape[1]), 0, 4) * (GATES // 3), self.size)
        #: Cells for pairs of leaves, and with those of two words.
        self.pairs = (self.size + 1) * self.size
        self.cells = self.pairs + 2 * SLOTS

    def leaf(self, word: bytes) -> int:
        k = self.top.get(word)
        return len(self.top) + word[0] if k is None else k

    def decisions(self, leaf: np.ndarray, fresh: np.ndarray, name: np.ndarray) -> Decisions:
        """``leaf`` and ``name`` (hash) of each token, and whether it begins a document."""
        size = self.depth[leaf]
        cell = np.repeat(leaf * self.nodes.shape[1] - np.cumsum(size) + size, size)
        cell += np.arange(len(cell))
        node = self.node_of.take(cell)
        two = np.repeat(self.pair(fresh, name), size)
        two += self.salt_of.take(cell)
        two = hashed(two)
        two &= np.uint64(SLOTS - 1)
        one = np.repeat(self.last(leaf, fresh) * self.size, size)
        one += node
        return Decisions(size, cell, node, self.bit_of.take(cell), one, two.view(np.int64))

    def last(self, leaf: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The leaf of the word before; at the beginning a number of its own."""
        out = np.full(len(leaf), self.size)
        out[1:] = leaf[:-1]
        out[fresh] = self.size
        return out

    def pair(self, fresh: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The two words before as one hash."""
        one, two = np.zeros(len(name), np.uint64), np.zeros(len(name), np.uint64)
        one[1:] = name[:-1]
        one[fresh] = 1
        two[1:] = one[:-1]
        two[fresh] = 2
        return hashed(one * np.uint64(0xD6E8FEB86659FD93) + two)

    def add(self, table: np.ndarray, codes: list[np.ndarray], words: np.ndarray) -> None:
        """Add how often each leaf follows each leaf, and zeros and ones after two words, of texts of word numbers."""
        leaves, names, slots = words[0].view(np.int64), words[1], table[self.pairs :]
        for _, flat, fresh, _ in batches_of(codes):
            leaf = leaves[flat]
            np.add.at(table, self.last(leaf, fresh) * self.size + leaf, ONE)
            size = self.depth[leaf]
            cell = np.repeat(leaf * self.nodes.shape[1] - np.cumsum(size) + size, size)
            cell += np.arange(len(cell))
            two = np.repeat(self.pair(fresh, names[flat]), size)
            two += self.salt_of.take(cell)
            at = hashed(two)
            at &= np.uint64(SLOTS - 1)
            at <<= np.uint64(1)
            at = at.view(np.int64)
            at += self.bit_of.take(cell)
            np.add.at(slots, at, ONE)

    def by_node(self, pairs: np.ndarray) -> np.ndarray:
        """From how often each leaf followed each context (contexts x leaves) to zeros and ones (2 x contexts x nodes)."""
        out = np.zeros((2, len(pairs), self.size), np.float32)
        for leaf in range(self.size):
            for k in range(self.depth[leaf]):
                out[self.bits[leaf, k], :, self.nodes[leaf, k]] += pairs[:, leaf]
        return out


#: Depth, and how often the contexts have been met: one word, two words, the document.
GATES = 3 * 4 * 4 * 3
INPUTS = 4
#: Levels of how often a context has been met, and what a level counts for in the gate.
MET = (((), 0), ((0, 8, 100), 12), ((0, 1, 8), 3), ((1, 12), 1))


@dataclass
class Corpus:
    """Zeros and ones of the corpus contexts: of nodes in general, of nodes after a leaf, and of two-word slots."""

    node: np.ndarray
    one: np.ndarray
    two: np.ndarray


def ready(table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``judged`` for all counts of a table, piece by piece."""
    n = table.shape[1]
    odds, met = np.empty(n, np.float32), np.empty(n, np.int8)
    for at in range(0, n, 1 << 18):
        part = slice(at, at + (1 << 18))
        odds[part], met[part] = judged(table[0, part], table[1, part], k)
    return odds, met


def rounded(table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each counts of a table, and what the bytes stand for: parts of the numbers that ``Mixer.fit`` reads."""
    codes = np.empty(table.shape[1], np.uint8)
    steps = max(1, MET[k][1])
    for at in range(0, len(codes), 1 << 18):
        part = slice(at, at + (1 << 18))
        odds, met = judged(table[0, part], table[1, part], k)
        codes[part] = level(odds) + LEVELS * (met // steps)
    parts = np.arange(LEVELS * (len(MET[k][0]) + 1))
    return codes, parts % LEVELS * LEVELS**k + parts // LEVELS * steps * LEVELS**INPUTS


def judged(n0: np.ndarray, n1: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of context ``k`` and what it adds to the gate."""
    a, b = n0.astype(np.float32), n1.astype(np.float32)
    bounds, counts = MET[k]
    return np.log((b + PRIOR) / (a + PRIOR)), (levels(a + b, *bounds) * counts).astype(np.int8)


class Coder:
    """Codes token sequences by the tree's decisions."""

    def __init__(self, tree: Tree, corpus: Corpus, mixer: Mixer):
        self.tree, self.mixer = tree, mixer
        self.tables = corpus.node, corpus.one, corpus.two
        self.ready = [ready(t, k) for k, t in enumerate(self.tables)]

    def bits(self, leaf: np.ndarray, name: np.ndarray, doc: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Bits of each token. ``doc`` names the stretch of text that a token's own context is drawn from."""
        d = self.tree.decisions(leaf, fresh, name)
        costs = self.mixer.bits(*self.inputs(d, doc), d.y)
        return np.add.reduceat(costs, np.cumsum(d.size) - d.size)  # no token is without decisions

    def inputs(self, d: Decisions, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Log odds of all contexts, and the gate."""
        found = [(odds.take(s), met.take(s)) for (odds, met), s in zip(self.ready, d.slots(), strict=True)]
        found.append(own_context(self.tree, d, doc))
        gate = self.tree.deep_of.take(d.cell)
        for _, met in found[1:]:
            gate += met
        return [o for o, _ in found], gate


def own_context(tree: Tree, d: Decisions, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the stretch of text so far says."""
    key = np.repeat(doc * tree.size, d.size)
    key += d.node
    return judged(*before(key, d.y), INPUTS - 1)


# Spelling


def byte_bits(live: np.ndarray, byte: np.ndarray, last: np.ndarray, whole: np.ndarray, place: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The eight decisions of bytes, given the bytes before (``last``) and the word so far."""
    base = [last & np.uint64(0xFFFF), last & np.uint64(0xFFFFFF), last & np.uint64(0xFFFFFFFF), whole]
    mixed = [hashed(b * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 8 * (place == 1))) for k, b in enumerate(base)]
    node, held = np.ones(len(live), np.uint64), np.empty(len(live), np.uint64)
    for bit in range(8):
        y = (byte >> np.uint64(7 - bit)) & np.uint64(1)
        salt = node * np.uint64(0x2545F4914F6CDD1D)
        slots = np.empty((len(mixed), len(live)), np.uint64)
        for k, (m, size) in enumerate(zip(mixed, SPELL_SLOTS, strict=True)):  # ``hashed`` without copies
            h = np.add(m, salt, out=slots[k])
            h ^= np.right_shift(h, np.uint64(32), out=held)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= np.right_shift(h, np.uint64(29), out=held)
            h &= np.uint64(size - 1)
            h += np.uint64(SPELL_START[k])
        yield live, slots.view(np.int64), y.view(np.int64), bit * 3 + min(2, place - 1)
        node = node * np.uint64(2) + y


def spelling(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each bit of the bytes behind the first: the words that reach it, their slots (contexts x words), their bits, and
    the place (bit, then second byte, third, or later). A word ends with a space; the end symbol has no further byte. From
    ``LONG`` bytes on the last eight bytes stand for the word so far, and all bytes of a word are coded at once."""
    closed = [w if w == END else w + b" " for w in words]
    lengths = np.array([len(w) for w in closed])
    width = min(LONG, int(lengths.max(initial=1)))
    raw = np.frombuffer(b"".join([w[:width].ljust(width, b"\0") for w in closed]), np.uint8).reshape(len(closed), width)
    recent = raw[:, 0].astype(np.uint64)
    whole = hashed(recent + np.uint64(1))
    for place in range(1, raw.shape[1]):
        live = np.flatnonzero(lengths > place)
        byte, last = raw[live, place].astype(np.uint64), recent[live]
        yield from byte_bits(live, byte, last, whole[live], place)
        whole[live] = hashed(whole[live] * np.uint64(0x100000001B3) + byte + np.uint64(1))
        recent[live] = last << np.uint64(8) | byte
    for i in np.flatnonzero(lengths > LONG).tolist():
        own = np.frombuffer(closed[i], np.uint8).astype(np.uint64)
        for at in range(LONG, len(own), SPELL_BATCH):
            here = np.arange(at, min(at + SPELL_BATCH, len(own)))
            last = np.zeros(len(here), np.uint64)
            for k in range(8, 0, -1):
                last = last << np.uint64(8) | own[here - k]
            yield from byte_bits(np.full(len(here), i), own[here], last, hashed(last + np.uint64(3)), LONG)


SPELL_GATES = 8 * 3 * 4 * 3


class Speller:
    """Bits of words behind their first byte. ``table``: zeros and ones of all slots over distinct training words."""

    def __init__(self, table: np.ndarray, mixer: Mixer):
        self.table, self.mixer = table, mixer

    def inputs(self, slots: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and gate."""
        n = self.table[:, slots].astype(np.float32)
        seen = n[0] + n[1]
        return np.log((n[1] + PRIOR) / (n[0] + PRIOR)), (place * 4 + levels(seen[-1], 0, 2, 20)) * 3 + levels(seen[-2], 0, 20)

    def parts(self) -> np.ndarray:
        """By slot and bit: its parts of the number that ``Mixer.fit`` reads, without what that bit has added to the slot."""
        out = np.empty((self.table.shape[1], 2), np.int32)
        for k, (at, end) in enumerate(zip(SPELL_START[:-1], SPELL_START[1:], strict=True)):
            for y in (0, 1):
                n = self.table[:, at:end].astype(np.float32)
                n[y] = np.maximum(n[y] - 1, 0)
                seen = n[0] + n[1]
                gate = {2: levels(seen, 0, 20), 3: levels(seen, 0, 2, 20) * 3}.get(k, 0)
                out[at:end, y] = 2 * (gate * LEVELS ** len(SPELL_SLOTS) + level(np.log((n[1] + PRIOR) / (n[0] + PRIOR))) * LEVELS**k)
        return out.ravel()

    def bits(self, words: list[bytes]) -> np.ndarray:
        """In batches of similar length."""
        out = np.zeros(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), SPELL_BATCH):
            index = np.array(order[at : at + SPELL_BATCH])
            for live, slots, y, place in spelling([words[i] for i in index.tolist()]):
                np.add.at(out, index[live], self.mixer.bits(*self.inputs(slots, place), y))
        return out

    def count(self, table: np.ndarray, words: list[bytes], parts: np.ndarray) -> None:
        """Count the decisions of words that are in the table once each, as ``Mixer.fit`` reads them."""
        for at in range(0, len(words), SPELL_BATCH):
            for _, slots, y, place in spelling(words[at : at + SPELL_BATCH]):
                slots <<= 1
                slots += y
                number = parts.take(slots[0]).astype(np.int64)
                for s in slots[1:]:
                    number += parts.take(s)
                number += y + place * 12 * 2 * LEVELS ** len(SPELL_SLOTS)
                np.add.at(table, number, ONE)


# Gathering in Spark


def coded(docs: DataFrame) -> DataFrame:
    """Documents (of ``trained``) in chunks of about ``CHUNK_BYTES`` of text, a row each: ``ids`` (an Arrow stream), ``folds`` (by
    text, so that copies share one: 0, 1, or ``HELD_OUT``), ``sizes`` and ``codes`` (the documents' words as numbers within the
    chunk), ``words`` (its distinct words in order) and ``counts`` (how often each is in training documents)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_BYTES):
            numbers, codes, folds = Numbers(), [], bytearray()
            for batch in part.select(["text", "held_out"]).to_batches():
                for t, h in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    t = t.as_py()
                    codes.append(numbers.of(t))
                    folds.append(HELD_OUT if h else zlib.crc32(t or b"") >> 8 & 1)
            counts = np.zeros(len(numbers), np.int64)
            for c, f in zip(codes, folds, strict=True):
                if f != HELD_OUT:
                    np.add.at(counts, c, 1)
            ids = pa.BufferOutputStream()
            with pa.ipc.new_stream(ids, pa.schema([part.schema.field("id")])) as stream:
                stream.write_table(part.select(["id"]))
            sizes = np.fromiter(map(len, codes), np.int32, len(codes))
            values = [uuid.uuid4().int >> 65, ids.getvalue().to_pybytes(), bytes(folds), sizes.tobytes(), np.concatenate(codes).tobytes(), counts.tobytes(), b" ".join(numbers)]
            yield pa.record_batch([pa.array([x], pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(values)], NAMES)

    return written(docs.mapInArrow(step, ", ".join(f"{n} {'binary' if k else 'long'}" for k, n in enumerate(NAMES))), "mixing-coded", "zstd")


NAMES = ["chunk", "ids", "folds", "sizes", "codes", "counts", "words"]
HELD_OUT = 2


def texts_of(codes: bytes, sizes: bytes) -> list[np.ndarray]:
    """The word numbers of each document of a chunk."""
    return np.split(np.frombuffer(codes, np.int32), np.cumsum(np.frombuffer(sizes, np.int32))[:-1])


PLANES = ["block", "shift", "plane"]


def blocks(size: int) -> int:
    return -(-size // BLOCK) * BLOCK


def training(chunks: DataFrame, tree: Broadcast, gather: Callable[[Tree, np.ndarray], Callable], size: int) -> np.ndarray:
    """A table of ``size`` counts, added up over all training documents. ``gather`` gives, for a tree and a task's table, what
    counts texts of word numbers: it takes their fold, their numbers, and the words."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(blocks(size), np.int32)
        count = gather(tree.value, table)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("folds", "sizes", "codes", "words")), strict=True):
                folds, sizes, codes, words = (x.as_py() for x in row)
                texts, known = texts_of(codes, sizes), described(words.split(b" "), tree.value)
                for fold in (0, 1):
                    count(fold, [c for c, f in zip(texts, folds, strict=True) if f == fold], known)
        for planes in planes_of(table):
            yield pa.record_batch(planes, PLANES)

    planes = chunks.select("folds", "sizes", "codes", "words").mapInArrow(step, "block long, shift long, plane binary")
    return added(written(planes, "mixing-planes", "zstd"), size)


def planes_of(table: np.ndarray) -> Iterator[list[pa.Array]]:
    """Blocks of a table as planes of bytes (``block``, ``shift``, ``plane``); what is zero is left out."""
    table = table.reshape(-1, BLOCK)
    for at in range(0, len(table), 256):
        part = table[at : at + 256]
        for shift in range(0, 64, 8):
            if not part.any():
                break
            low = (part & 255).astype(np.uint8)
            used = np.flatnonzero(low.any(axis=1))
            raw = [low[b].tobytes() for b in used.tolist()]
            yield [pa.array(used + at, pa.int64()), pa.array([shift] * len(used), pa.int64()), pa.array(raw, pa.binary())]
            part = part >> 8


def added(planes: DataFrame, size: int) -> np.ndarray:
    """The sum of the tables that planes stand for; they are added up block by block as they stream in."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, shift, raw in zip(*(batch.column(k).to_pylist() for k in ("block", "shift", "plane")), strict=True):
                if b not in sums:
                    sums[b] = np.zeros(BLOCK, np.int64)
                sums[b] += np.frombuffer(raw, np.uint8).astype(np.int64) << shift
        raw = [x.astype(np.float32).tobytes() for x in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array(raw, pa.binary())], ["block", "sums"])

    sums = written(planes.repartition("block").mapInArrow(total, "block long, sums binary"), "mixing-table", clean=True)
    out = np.zeros(blocks(size), np.float32)
    for r in sums.toLocalIterator():  # of a fixed size, whatever the corpus
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.float32)
    return out[:size]


def counts_of(chunks: DataFrame) -> DataFrame:
    """From the chunks' distinct words: a row for each word (``word``, ``c``: how often it is in all training documents) and
    for each chunk that does not hold all of them (``chunk``, ``at``, ``c``); one row may serve as both."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, words in zip(*(batch.column(k) for k in ("chunk", "counts", "words")), strict=True):
                own, n = words.as_py().split(b" "), np.frombuffer(raw.as_py(), np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)]
                    cols = [pa.array(np.full(len(part), chunk.as_py())), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part, pa.binary()), pa.array(n[at : at + (1 << 16)])]
                    yield pa.record_batch(cols, ["chunk", "at", "word", "n"])

    listed = chunks.select("chunk", "counts", "words").mapInArrow(step, "chunk long, at int, word binary, n long")
    of_word = Window.partitionBy("word")  # a row a chunk at most
    total = listed.withColumns({"c": F.sum("n").over(of_word), "k": F.row_number().over(of_word.orderBy("chunk"))})
    back = F.col("n") != F.col("c")
    return written(total.where((F.col("k") == 1) | back).select(F.when(back, F.col("chunk")).alias("home"), "at", F.when(F.col("k") == 1, F.col("word")).alias("word"), "c"), "mixing-counts")


def trained(docs: DataFrame, id: str, text: str) -> DataFrame:
    train = F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 10 != 0, F.lit(True))
    return docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"), (~train).alias("held_out"))


def shrunk(table: np.ndarray) -> np.ndarray:
    """Counts (zeros and ones first) in 16 bits; larger ones keep their ratio."""
    return (table / np.maximum(1, table.max(axis=0) / 65535)).astype(np.uint16)


class Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k

    def of(self, text: bytes | None) -> np.ndarray:
        own = tokens(text)
        own.append(END)
        return np.fromiter(map(self.__getitem__, own), np.int32, len(own))


def described(words, tree: Tree) -> np.ndarray:
    """Leaf and name of words."""
    leaf = np.fromiter(map(tree.leaf, words), np.uint64, len(words))
    return np.stack([leaf, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))])


def add_spelling(table: np.ndarray, words: list[bytes]) -> None:
    for at in range(0, len(words), SPELL_BATCH):
        for _, slots, y, _ in spelling(words[at : at + SPELL_BATCH]):
            slots <<= 1
            slots += y
            np.add.at(table, slots.ravel(), ONE)


def tree_of(words: DataFrame) -> Tree:
    """The tree by the counts (``word``, ``c``) of all training words; a row for each leaf and first byte reaches the driver."""
    met = words.where("c > 0")
    top = met.orderBy(F.desc("c"), "word").limit(LEAVES).collect()
    classes = np.zeros(256)
    for r in met.groupBy(first_byte("word")).agg(F.sum("c").alias("c")).collect():
        classes[r["first"]] = r.c
    for r in top:
        classes[r.word[0]] -= r.c
    return Tree([bytes(r.word) for r in top], [r.c for r in top], classes)


def first_byte(word: str) -> Column:
    return F.conv(F.hex(F.substring(word, 1, 1)), 16, 10).cast("int").alias("first")


def corpora_of(chunks: DataFrame, tree: Tree, sent: Broadcast) -> tuple[Corpus, list[Corpus]]:
    """Decision counts of all training documents, and of each fold."""
    cells = tree.cells

    def gather(tree: Tree, table: np.ndarray) -> Callable:
        return lambda fold, codes, words: tree.add(table[fold * cells : (fold + 1) * cells], codes, words)

    table = training(chunks, sent, gather, 2 * cells).reshape(2, cells)

    def corpus(own: np.ndarray) -> Corpus:
        one = tree.by_node(own[: tree.pairs].reshape(tree.size + 1, tree.size))
        return Corpus(one.sum(axis=1), shrunk(one.reshape(2, -1)), shrunk(own[tree.pairs :].reshape(SLOTS, 2).T))

    folds = [corpus(x) for x in table]
    return corpus(table[0] + table[1]), folds


def mixer_of(chunks: DataFrame, sent: Broadcast, folds: list[Corpus]) -> Mixer:
    """Weights and maps for the decisions of all training documents, each judged by the counts of the other fold."""
    others = chunks.sparkSession.sparkContext.broadcast([[rounded(t, k) for k, t in enumerate((c.node, c.one, c.two))] for c in folds[::-1]])

    def gather(tree: Tree, table: np.ndarray) -> Callable:
        found, deep = others.value, tree.deep_of * LEVELS**INPUTS

        def count(fold: int, codes: list[np.ndarray], words: np.ndarray) -> None:
            leaves, names = words[0].view(np.int64), words[1]
            for _, flat, fresh, stretch in batches_of(codes):
                d = tree.decisions(leaves[flat], fresh, names[flat])
                odds, met = own_context(tree, d, stretch)
                number = deep.take(d.cell)
                number += level(odds) * np.int32(LEVELS ** (INPUTS - 1))
                number += met * np.int32(LEVELS**INPUTS)
                for (codes_of, parts), slot in zip(found[fold], d.slots(), strict=True):
                    number += parts.take(codes_of.take(slot))
                number <<= 1
                number += d.y
                np.add.at(table, number, ONE)

        return count

    out = Mixer(GATES, INPUTS)
    out.fit(training(chunks, sent, gather, GATES * LEVELS**INPUTS * 2))
    others.unpersist()
    return out


def speller_of(words: DataFrame) -> Speller:
    """A speller over all distinct training words; its weights are fitted to all those met once."""
    size, cells = 2 * int(SPELL_START[-1]), SPELL_GATES * LEVELS ** len(SPELL_SLOTS) * 2

    def summed(words: DataFrame, count: Callable[[np.ndarray, list[bytes]], None], size: int) -> np.ndarray:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(blocks(size), np.int32)
            held, waiting = [], 0
            for batch in batches:
                held += batch.column("word").to_pylist()
                waiting += batch.column("word").nbytes
                if len(held) >= SPELL_HELD or waiting >= SLICE_BYTES:
                    count(table, sorted(held, key=len))
                    held, waiting = [], 0
            count(table, sorted(held, key=len))
            for planes in planes_of(table):
                yield pa.record_batch(planes, PLANES)

        return added(words.select("word").mapInArrow(step, "block long, shift long, plane binary"), size)

    met = words.where("c > 0")
    out = Speller(shrunk(summed(met, add_spelling, size).reshape(-1, 2).T), Mixer(SPELL_GATES, len(SPELL_SLOTS)))
    sent = words.sparkSession.sparkContext.broadcast((out, out.parts()))
    once = met.where((F.col("c") == 1) & (F.col("word") != F.lit(END)))
    out.mixer.fit(summed(once, lambda table, own: sent.value[0].count(table, own, sent.value[1]), cells))
    return out


@dataclass
class Counts:
    """Totals of the training words: all tokens, distinct words, and by first byte (words without a leaf of their own) the
    tokens, distinct words and words met once; ``less`` is taken off each count for words never met."""

    n: int
    v: int
    tokens: np.ndarray
    words: np.ndarray
    once: np.ndarray
    less: float

    def bits(self, first: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Bits of words behind their first byte: of being known and by their count, or of being unknown."""
        new = np.where(self.words > 0, (self.once + 0.5) / (self.tokens + 1), 1.0)[first]
        share = (c - self.less) / np.maximum(self.tokens - self.less * self.words, 1e-9)[first]
        return -np.log2(np.where(c > 0, np.maximum((1 - new) * share, 1e-300), new))


def counted(words: DataFrame, tree: Tree) -> Counts:
    """Totals from the word counts; a row for each first byte reaches the driver."""
    met = words.where("c > 0").withColumn("own", F.col("word").isin(list(tree.top)) if tree.top else F.lit(False))
    other = ~F.col("own")
    rows = met.groupBy(first_byte("word")).agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("v"),
        F.sum(F.when(other, F.col("c")).otherwise(0)).alias("tokens"),
        F.count_if(other).alias("words"),
        F.count_if(other & (F.col("c") == 1)).alias("once"),
        F.count_if(F.col("c") == 1).alias("singles"),
        F.count_if(F.col("c") == 2).alias("pairs"),
    )
    tokens, kinds, once = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
    total = Counter()
    for r in rows.collect():
        tokens[r["first"]], kinds[r["first"]], once[r["first"]] = r.tokens, r.words, r.once
        total.update({k: r[k] for k in ("n", "v", "singles", "pairs")})
    less = min(0.9, max(0.1, total["singles"] / max(1, total["singles"] + 2 * total["pairs"])))
    return Counts(total["n"], total["v"], tokens, kinds, once, less)


@dataclass
class Model:
    """What scoring needs besides the word counts and the corpus tables; of a fixed size."""

    tree: Tree
    counts: Counts
    mixer: Mixer
    speller: Speller
    #: Made once in each worker.
    coder: Coder | None = None


def fitted(chunks: DataFrame, words: DataFrame) -> tuple[Model, Broadcast]:
    """The model of the training documents and their words and, already sent to the executors, its corpus tables."""
    context = chunks.sparkSession.sparkContext
    tree = tree_of(words)
    sent = context.broadcast(tree)
    corpus, folds = corpora_of(chunks, tree, sent)
    return Model(tree, counted(words, tree), mixer_of(chunks, sent, folds), speller_of(words)), context.broadcast(corpus)


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``."""
    spark = docs.sparkSession
    prepare(spark)
    raw = trained(docs, id, text)
    chunks = coded(raw)
    known = counts_of(chunks)
    model, corpus = fitted(chunks, known.where("word is not null").select("word", "c"))
    total = model.counts.n
    shared = spark.sparkContext.broadcast(model)

    def score(key: tuple, own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        tree, counts = m.tree, m.counts
        coder = m.coder = m.coder or Coder(tree, corpus.value, m.mixer)
        chunk = own.iloc[0]
        listed = bytes(chunk["words"]).split(b" ")
        c = np.frombuffer(chunk["counts"], np.int64).copy()
        c[known["at"].to_numpy()] = known["c"]
        leaf, name = described(listed, tree)
        leaf = leaf.view(np.int64)
        long = np.fromiter(map(len, listed), np.int64, len(listed)) + 1
        base = np.log10((c + 0.1) / (counts.n + 0.1 * (counts.v + 1)))
        rest = np.zeros(len(listed))
        plain = np.flatnonzero(leaf >= len(tree.top))
        rest[plain] = counts.bits(leaf[plain] - len(tree.top), c[plain])
        new = plain[c[plain] == 0]
        rest[new] += m.speller.bits([listed[i] for i in new.tolist()])
        codes = texts_of(chunk["codes"], chunk["sizes"])
        sizes = np.array([len(x) for x in codes])
        bits = np.zeros(len(codes))
        for docs, flat, fresh, stretch in batches_of(codes):
            each = coder.bits(leaf[flat], name[flat], stretch, fresh) + rest[flat]
            bits += np.bincount(docs, each, len(codes))
        return pd.DataFrame(
            {
                "id": pd.Series(pa.ipc.open_stream(chunk["ids"]).read_all().column(0).to_pylist(), dtype=object),
                "held_out": np.frombuffer(chunk["folds"], np.uint8) == HELD_OUT,
                "n_tokens": sizes,
                "n_known": [int((c[x] > 0).sum()) for x in codes],
                "base_score": [float(base[x].sum()) for x in codes],
                "bits": bits,
                "size": [int(long[x].sum()) - 1 for x in codes],
            }
        )

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, bits double, size long"
    back = known.where("home is not null").select("home", "at", "c")
    out = chunks.groupBy("chunk").cogroup(back.groupBy("home")).applyInPandas(score, schema)
    return out.select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        (-F.col("bits") * float(np.log10(2))).alias("score"),
        (F.col("bits") / F.greatest(F.col("size"), F.lit(1))).alias("bits_per_byte"),
    )


def batches_of(codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in batches of about ``BATCH`` tokens, long ones cut after every ``STRETCH``: the document of each token, its
    word number, whether it begins a stretch, and its stretch."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for _, x in held])
        fresh = np.zeros(lengths.sum(), bool)
        fresh[np.cumsum(lengths) - lengths] = True
        return np.repeat([d for d, _ in held], lengths), np.concatenate([x for _, x in held]), fresh, np.repeat(np.arange(len(held)), lengths)

    for d, own in enumerate(codes):
        for at in range(0, len(own), STRETCH):
            part = own[at : at + STRETCH]
            if held and size + len(part) > BATCH:
                yield out()
                held, size = [], 0
            held.append((d, part))
            size += len(part)
    if held:
        yield out()


def op8(docs: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"))


def brute_base(rows: list[tuple[int, str | None]]) -> list[tuple[int, bool, int, int, int, float]]:
    """The contract's counts and base score; for tests."""
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    seen: Counter[bytes] = Counter()
    for d, t in rows:
        if not held[d]:
            seen.update([*tokens((t or "").encode()), END])
    n, v = sum(seen.values()), len(seen)
    out = []
    for d, t in rows:
        own = [*tokens((t or "").encode()), END]
        out.append((d, held[d], len(own), sum(seen[w] > 0 for w in own), n, float(sum(np.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))))
    return out
