"""What one Python worker of the quality stage may hold."""

import math
import tracemalloc

import numpy as np

from plumbline.llm import quality


def plain_trained(rows, whole, labels, l1=0.1, l2=0.05, alpha=0.5):
    """The scorer of ``quality.trained``, with dictionaries."""
    share = labels.mean()
    own = [sorted({*t.tolist(), *w.tolist()}) for t, w in zip(rows, whole, strict=True)]
    n, bad = {}, {}
    for r, y in zip(own, labels.tolist(), strict=True):
        for b in r:
            n[b], bad[b] = n.get(b, 0) + 1, bad.get(b, 0.0) + y
    used = {b for b in n if n[b] >= 5 and bad[b] - share * n[b] >= 4 * math.sqrt(n[b] * share * (1 - share))}
    z, s = dict.fromkeys([*used, None], 0.0), dict.fromkeys([*used, None], 0.0)

    def weight(b):
        shrunk = math.copysign(max(abs(z[b]) - (l1 if b is not None else 0), 0), z[b])
        return -shrunk / ((1 + math.sqrt(s[b])) / alpha + (l2 if b is not None else 0))

    for _ in range(8):
        for r, w, y in zip(own, whole, labels.tolist(), strict=True):
            tokens = sum(b in used and b not in w for b in r)
            x = {b: 1.0 if b in w else 1 / math.sqrt(max(1, tokens)) for b in r if b in used} | {None: 1.0}
            weights = {b: weight(b) for b in x}
            e = 1 / (1 + math.exp(-min(30.0, max(-30.0, sum(weights[b] * x[b] for b in x))))) - y
            if abs(e) > 1e-3:
                for b in x:
                    g = e * x[b]
                    z[b] += g - (math.sqrt(s[b] + g * g) - math.sqrt(s[b])) / alpha * weights[b]
                    s[b] += g * g
    return {b: weight(b) for b in used}, weight(None)


def test_scorer_is_that_of_plain_training():
    r = np.random.default_rng(4)
    labels = (r.random(300) < 0.3) * 0.9
    rows = [np.unique(np.concatenate([r.integers(0, 5000, 40), r.integers(6000, 6010, 4) if y else []])).astype(np.int32) for y in labels]
    whole = [np.array([7000 + int(y > 0), 7005], np.int32) for y in labels]
    got = quality.trained(rows, whole, labels)
    weights, bias = plain_trained(rows, whole, labels)
    assert len(weights) > 5 and got.weights.keys() == weights.keys()
    assert all(abs(got.weights[b] - w) < 1e-9 for b, w in weights.items()) and abs(got.bias - bias) < 1e-9


def test_training_holds_little_besides_its_rows():
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, quality.BUCKETS, 2500)).astype(np.int32) for _ in range(1500)]
    whole = [np.array([3], np.int32)] * len(rows)
    tracemalloc.start()
    quality.trained(rows, whole, np.arange(len(rows)) % 2 * 1.0, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * sum(r.nbytes for r in rows) + 32 * quality.BUCKETS / 2  # sorted at once: 160 MB


def test_remembered_tokens_are_bounded():
    reader = quality.Reader(features=True)
    tracemalloc.start()
    for k in range(4):
        reader.read(" ".join(chr(97 + i % 26) + f"{'' if i % 2 else 'long'}word".replace("w", chr(97 + i // 26 % 26)) + chr(97 + i // 676 % 26) + chr(97 + i // 17576 % 26) + chr(97 + k) for i in range(65000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60e6  # all of them: over 100 MB


def test_a_task_leaves_no_remembered_tokens(spark, monkeypatch):
    left = []
    reader = quality.Reader()

    class Shared:
        value = reader

    frame = spark.createDataFrame([("some words here",)], "text string")
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: Shared)
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, step, schema: left.append(step))
    quality.mapped(frame, "text", [], reader, lambda r, t: r.read(t))
    assert list(left[0](iter(frame.toArrow().to_batches()))) and not reader.known
