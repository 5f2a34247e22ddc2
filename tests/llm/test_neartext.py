"""The prefix join over what crowds hold apart: no similar pair lost, and few others made."""

import numpy as np

from plumbline.llm import neartext, simhash


def near_copies(n):
    """Most pairs are alike by about 0.72, those that share a change or have one only by 0.8."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(n):
        own = list(base)
        for k, at in enumerate(r.integers(5, 145, 2 if i % 6 else 1).tolist()):
            own[at] = f"other{i} {k}"
        texts.append(" ".join(own))
    return texts


def test_pairs_of_a_crowd_grow_with_it(spark, monkeypatch):
    made, plain = [], neartext.verified

    def counted(pairs, sets):
        made.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(neartext, "verified", counted)
    rows = list(enumerate(near_copies(300)))
    kept = simhash.dedupe(spark.createDataFrame(rows, "doc_id long, text string"), similar=True).count()
    sets = [set(neartext.shingles(t.encode()).tolist()) for _, t in rows]
    low = list(range(len(rows)))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
    for _ in range(8):
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    assert kept == len(set(low))
    assert sum(made[1:]) < 20 * len(rows), made


def test_prefix_pairs_of_near_copies_below_the_threshold(spark):
    texts = near_copies(120)
    sets = [neartext.shingles(t.encode()).view(np.int64) for t in texts]
    rows = [(i, len(x), -1 if i % 3 == 0 else i) for i, x in enumerate(sets)]  # a third is one component already
    rest = spark.createDataFrame(rows, "node long, n long, component long")
    frame = spark.createDataFrame([(i, x.tolist(), neartext.parity(x)) for i, x in enumerate(sets)], "node long, own array<long>, parity array<long>")
    got = [(x.a, x.b) for x in neartext.prefix_pairs(neartext.prefixes(rest, frame), frame).collect()]
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if rows[i][2] != rows[j][2] and same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                want.add((i, j))
    pairs = set(got)
    assert want and want <= pairs
    assert all(rows[a][2] != rows[b][2] for a, b in pairs)
    stars = neartext.verified(neartext.star_pairs(neartext.prefixes(rest, frame)), frame)
    low = {x.node: x.component for x in neartext.joined(rest, stars).collect()}
    assert len(set(low.values())) < len({x[2] for x in rows}) / 2
    assert all(low[x.a] == low[x.b] for x in stars.collect())


def test_parity_bits_differ_in_no_more_places_than_the_sets():
    r = np.random.default_rng(4)
    for n in (0, 1, 40, 3000):
        a = np.unique(r.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, n // 3, np.uint64)]))
        x, y = (np.array(neartext.parity(z), np.int64).view(np.uint64) for z in (a, b))
        assert len(x) == neartext.PARITY // 64 and int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    """Spark sizes them by what was exploded, so a broadcast would hold many times its limit in the driver."""
    from plumbline.llm import graph

    plans = []

    def noted(df, name, *more, **named):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, name, *more, **named)

    plain = simhash.written
    for module in (simhash, neartext, graph):
        monkeypatch.setattr(module, "written", noted)
    docs = spark.createDataFrame(list(enumerate(near_copies(40))), "doc_id long, text string")
    assert simhash.op5(docs).count() == 40
    simhash.dedupe(docs, similar=True)
    first = next(plan for name, plan in plans if name == "components")
    own = [plan for name, plan in plans if name in ("simhash-grid", "near-bands")] + [first]
    assert len(own) == 4 and all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in own)
