"""The context-mixing scorer: a chance over all texts, a plain scorer that agrees, and results that do not depend on dealing."""

import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.common import table


def model_of(rows):
    """Tree, counts and corpus tables of the training rows, without Spark."""
    c = Counter()
    train = [t.encode() for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    for t in train:
        c.update([*mixing.tokens(t), mixing.END])
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: mixing.LEAVES]
    n, v, once = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
    for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[mixing.LEAVES :]:
        n[w[0]] += k
        v[w[0]] += 1
        once[w[0]] += k == 1
    ones, twos = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    counts = mixing.Counts(sum(c.values()), len(c), n, v, once, min(0.9, max(0.1, ones / max(1, ones + 2 * twos))))
    tree = mixing.Tree([w for w, _ in top], [k for _, k in top], n)
    return c, train, counts, tree


def slot(one, two, node):
    """Where the counts of a node after two words are: contexts are hashed, so a few share a slot."""

    def spread(x):
        x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 % 2**64
        return x ^ x >> 29

    return spread((spread((one * 0xD6E8FEB86659FD93 + two) % 2**64) + node * 0x2545F4914F6CDD1D) % 2**64) % mixing.SLOTS


def plain_score(text, c, train, counts, tree, mixer, speller):
    """log10 of the chance of a text, decision by decision, with contexts in dictionaries."""
    tables = [defaultdict(lambda: [0, 0]) for _ in range(3)]

    def walk(words, seen):
        last, before, own = None, (1, 2), defaultdict(lambda: [0, 0])
        for w in words:
            leaf = tree.leaf(w)
            for k in range(tree.depth[leaf]):
                node, y = int(tree.nodes[leaf, k]), int(tree.bits[leaf, k])
                seen(k, y, [(0, node), (1, (last, node)), (2, slot(*before, node))], own[node])
                own[node][y] += 1
            last, before = leaf, (xxhash.xxh3_64_intdigest(w), before[0])

    def learn(k, y, keys, own):
        for t, key in keys:
            tables[t][key][y] += 1

    for t in train:
        walk([*mixing.tokens(t), mixing.END], learn)
    total = 0.0

    def code(k, y, keys, own):
        nonlocal total
        pairs = [tables[t][key] for t, key in keys] + [own]
        odds = np.array([[np.log((np.float32(b) + mixing.PRIOR) / (np.float32(a) + mixing.PRIOR))] for a, b in pairs], np.float32)
        gate = sum(k > b for b in (0, 4))
        for (a, b), bounds in zip(pairs[1:], ((0, 8, 100), (0, 1, 8), (1, 12)), strict=True):
            gate = gate * (len(bounds) + 1) + sum(a + b > x for x in bounds)
        total += float(mixer.bits(odds, np.array([gate]), np.array([y]))[0])

    words = [*mixing.tokens(text), mixing.END]
    walk(words, code)
    for w in words:
        if w not in tree.top:
            first, new = w[0], 1.0
            if counts.words[first]:
                new = (counts.once[first] + 0.5) / (counts.tokens[first] + 1)
            if c[w]:
                total -= math.log2((1 - new) * (c[w] - counts.less) / (counts.tokens[first] - counts.less * counts.words[first]))
            else:
                total -= math.log2(new)
                total += float(speller.bits([w])[0])
    return -total * math.log10(2)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(12)
    vocabulary = ["".join(r.choice(list("abcde"), r.integers(1, 6))) for _ in range(150)]
    return [(i, " ".join(vocabulary[int(x)] for x in np.minimum(r.zipf(1.4, r.integers(1, 40)), 150) - 1)) for i in range(150)]


def test_score_is_that_of_a_plain_scorer(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "LEAVES", 30)
    found = {}
    plain = mixing.fitted

    def kept(*args):
        found["model"], corpus = plain(*args)
        return found["model"], corpus

    monkeypatch.setattr(mixing, "fitted", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in mixing.op8(df).collect()}
    c, train, counts, tree = model_of(rows)
    m = found["model"]
    assert m.tree.top == tree.top and (m.counts.tokens == counts.tokens).all() and m.counts.less == counts.less
    for d, t in rows[::5]:
        want = plain_score(t.encode(), c, train, counts, tree, m.mixer, m.speller)
        assert abs(got[d].score - want) <= 1e-4 * abs(want) + 1e-4


def test_chances_add_up_to_one(rows):
    c, train, counts, tree = model_of(rows)
    mixer = mixing.Mixer(mixing.GATES, mixing.INPUTS)
    corpus = mixing.Corpus(*(np.random.default_rng(1).integers(0, 9, (2, n)).astype(np.uint16) for n in (tree.size, tree.size * (tree.size + 1), mixing.SLOTS)))
    coder = mixing.Coder(tree, corpus, mixer)
    total = 0.0
    for leaf in range(tree.size):  # after two given words, every leaf
        leaves = np.array([3, 5, leaf])
        total += 2 ** -coder.bits(leaves, np.array([7, 9, leaf], np.uint64), np.zeros(3, np.int64), np.arange(3) == 0)[2]
    assert abs(total - 1) < 1e-4
    speller = mixing.Speller(np.random.default_rng(2).integers(0, 9, (2, int(mixing.SPELL_START[-1]))).astype(np.uint16), mixing.Mixer(mixing.SPELL_GATES, len(mixing.SPELL_SLOTS)))
    share = sum(2 ** -speller.bits([b"a" + bytes([x])])[0] for x in range(1, 256))  # all words of two bytes, closed by a space
    assert 0 < share <= 1 + 1e-6
    began = time.time()
    assert speller.bits([b"z" * 200_000, b"ab"])[0] > 0 and time.time() - began < 10
    known = [w for w in c if w not in tree.top]
    for first in {w[0] for w in known}:
        own = np.array([c[w] for w in known if w[0] == first])
        chances = 2 ** -counts.bits(np.full(len(own), first), own)
        assert abs(chances.sum() + 2 ** -counts.bits(np.array([first]), np.array([0]))[0] - 1) < 1e-9


def test_before_counts_earlier_decisions():
    r = np.random.default_rng(5)
    keys, y = r.integers(0, 9, 500), r.integers(0, 2, 500)
    n0, n1 = mixing.before(keys, y)
    for i in range(500):
        own = y[:i][keys[:i] == keys[i]]
        assert (n0[i], n1[i]) == ((own == 0).sum(), (own == 1).sum())


def test_dealing_does_not_matter(spark, rows):
    rows = rows + [(None, "a b a"), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    results = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        results.append(sorted((str(x.doc_id), x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 6)) for x in mixing.op8(df).collect()))
    assert results[0] == results[1] and len(results[0]) == len(rows)


def test_long_texts_cross_stretches(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 16)
    monkeypatch.setattr(mixing, "BATCH", 40)
    long = [(500, " ".join(t for _, t in rows[:40])), (501, "x" * 50_000), (502, "é😀 " * 300)]
    out = {x.doc_id: x for x in mixing.op8(spark.createDataFrame(rows + long, "doc_id long, text string")).collect()}
    for d, held, n, known, train, base in mixing.brute_base(rows + long):
        assert (out[d].held_out, out[d].n_tokens, out[d].n_known, out[d].train_tokens) == (held, n, known, train)
        assert math.isfinite(out[d].score) and out[d].score < 0


def test_held_out_texts_score_above_the_base(spark):
    out = mixing.op8(table(spark, "/root/testdata/sf0.01", "documents"))
    r = out.where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert r.score > r.base


def test_everything_learns_from_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAVES", 30)
    r = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 6) % 400) + f" only{i}") for i in range(2500)]
    fits, trees, plain = [], [], mixing.Mixer.fit

    def fit(mixer, table):
        fits.append(int(table.sum()))
        plain(mixer, table)

    monkeypatch.setattr(mixing.Mixer, "fit", fit)
    kept = mixing.fitted
    monkeypatch.setattr(mixing, "fitted", lambda *args: (trees.append(out := kept(*args)), out)[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert mixing.op8(df).count() == len(rows)
    c, train, _, tree = model_of(rows)
    assert len(train) > 2200 and trees[0][0].tree.top == tree.top
    decisions = sum(int(tree.depth[tree.leaf(w)]) * n for w, n in c.items())
    spelled = sum(8 * len(w) for w, n in c.items() if n == 1)  # behind the first byte, and a space
    assert fits == [decisions, spelled]


def test_fitted_weights_are_the_likeliest():
    r = np.random.default_rng(8)
    table = np.zeros((3, mixing.LEVELS**2, 2))
    table[0] = r.integers(0, 50, table[0].shape)
    table[1, ::5] = r.integers(0, 3, table[1, ::5].shape)
    mixer = mixing.Mixer(3, 2)
    start = mixer.weights.astype(float)
    mixer.fit(table.ravel())
    at = np.arange(mixing.LEVELS**2)
    x = np.stack([mixing.VALUES[at % mixing.LEVELS], mixing.VALUES[at // mixing.LEVELS]])

    def cost(gate, w):
        dot = np.clip(w @ x, -8, 7.999)
        return float((table[gate, :, 0] * np.logaddexp(0, dot) + table[gate, :, 1] * np.logaddexp(0, -dot)).sum() + mixing.WEIGHT_PRIOR / 2 * ((w - start[gate]) ** 2).sum())

    for gate in range(3):
        own = mixer.weights[gate].astype(float)
        for step in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
            assert cost(gate, own) <= cost(gate, own + np.array(step)) + 1e-6
    assert (mixer.weights[2] == start[2]).all()
