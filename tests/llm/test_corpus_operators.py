"""The corpus operators against brute force on small tables, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, common, decontaminate, graph, htmltext, mixing, neargraph, neartext, pii, quality, shards, simhash, substrings

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards box with daft zebras near a quiet river bank today"
TEXTS = [
    None, "", " ", "one", "one two", PASSAGE, PASSAGE, PASSAGE + " x", "y " + PASSAGE[:-9], "z" * 400, "ab" * 150, "a" * 3000 + " b",
    "mail a.b@c.de now 10.0.0.255 or 4111 1111 1111 1111 and +1 (017) 555-7713 end", "é😀 a@b.c%d@e.f " + PASSAGE, PASSAGE.upper(), PASSAGE * 40,
    "<|endoftext|> don't stop\x00 ΑΣ", "1.2.3.4.5.6.7.8 256.1.1.1 000.1.02.255 +1(((",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids_note string, fp_note string")


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_decontaminate(spark, docs, rows, empty):
    items = [("1", PASSAGE), ("2", "one two"), ("3", None), ("4", ""), ("5", PASSAGE)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.op9(spark, docs, bench).collect()}
    assert [got[i] for i, _ in rows] == decontaminate.brute([t for _, t in rows], items)
    assert decontaminate.op9(spark, empty, bench).count() == 0
    assert decontaminate.op9(spark, docs, bench.limit(0)).where("contaminated").count() == 0
    assert set(decontaminate.clean(docs, bench).columns) == set(docs.columns)


def test_decontaminate_blocks(spark, docs, rows, monkeypatch):
    items = [(str(k), PASSAGE[k * 3 :]) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.op9(spark, docs, bench).collect()}
    assert [got[i] for i, _ in rows] == decontaminate.brute([t for _, t in rows], items)


def test_fm_index():
    seq = np.random.default_rng(1).integers(1, 5, 400)
    index = decontaminate.FMIndex(seq, 5)
    for pattern in ([1], [2, 3], [4, 4, 1], [1, 2, 3, 4, 1, 2, 3]):
        lo, hi = index.search(np.array([pattern]))
        want = [i for i in range(len(seq)) if seq[i : i + len(pattern)].tolist() == pattern]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_bpe(docs, rows, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.op2(docs, path).collect()}
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.op2(empty, path).count() == 0


def test_written_tables_can_be_released(spark):
    import os

    df = common.written(spark.range(5), "some")
    path = common.WRITTEN[-1]
    assert df.count() == 5 and os.path.isdir(path)
    common.release(spark)
    assert not os.path.exists(path) and not common.WRITTEN


def test_lexicon_is_exact_and_shares_suffixes(tmp_path):
    words = {w.encode(): (k, k + 1) for k, w in enumerate(["walking", "talking", "walked", "talked", "walk", "talk"])}
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
    assert all(lexicon.find(w) == ids for w, ids in words.items())
    assert lexicon.find(b"walks") is None and lexicon.find(b"wal") is None and lexicon.find(b"") is None
    assert len(lexicon.final) < 14  # 30 letters share their ends


def test_shards(docs, empty, spark):
    out = shards.op4(docs).collect()
    counts = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in counts.values()) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    import zlib

    for r in out:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert shards.op4(empty).count() == 0
    twice = spark.createDataFrame([(7, "x")] * 20 + [(None, None)] * 3, "doc_id long, text string")
    assert sorted({(r.shard, r.slot) for r in shards.op4(twice).collect()}).__len__() == 23


def test_ring_moves_keys_only_to_the_new_shard():
    a, owner_a = shards.ring(8)
    b, owner_b = shards.ring(9)
    moved = [owner_b[y] for x, y in zip(a, b, strict=True) if owner_a[x] != owner_b[y]]
    assert set(moved) == {8} and len(moved) < len(a) / 4


def test_flow_overflows_clockwise():
    parts = shards.flow([5, 0, 1], [0, 1, 2], [2, 2, 2])
    assert sorted(parts) == [(0, 0, 2, 0, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 0), (2, 0, 1, 2, 1)]


def test_simhash(docs, rows, empty, spark):
    got = {r.doc_id: (r.doc_id, r.fingerprint, r.component_id) for r in simhash.op5(docs).collect()}
    assert [got[i] for i, _ in rows] == simhash.brute(rows)
    assert simhash.op5(empty).count() == 0
    kept = simhash.dedupe(docs.union(docs))
    assert kept.count() == len({c for _, _, c in got.values()}) and kept.columns == docs.columns


def test_dedupe_with_null_and_shared_ids(spark):
    r = np.random.default_rng(9)
    own = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 40)) for _ in range(24)]
    rows = [(None, t) for t in own[:8]] * 2 + [(7, t) for t in own[8:16]] * 2 + [(i, t) for i, t in enumerate(own[16:], 100)] + [(None, own[16])]
    kept = simhash.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(k.text for k in kept) == sorted(own)
    assert {k.doc_id for k in kept if k.text == own[16]} == {100}


@pytest.mark.parametrize("crowd", [1, 32])
def test_near_duplicates_stage(spark, monkeypatch, crowd):
    monkeypatch.setattr(neartext, "CROWDED", crowd)
    r = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in r.integers(0, 10**6, 150)]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):  # an edit in the middle changes five shingles
            new = list(words)
            for at in r.choice(np.arange(5, 145, 8), edits, replace=False):
                new[at] = f"v{r.integers(0, 10**6)}"
            texts.append(" ".join(new))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    low = list(range(len(texts)))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)]
    for _ in range(5):
        for i, j in near:
            low[i] = min(low[i], low[j])
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, texts[0].upper()), (901, None), (902, " "), (None, texts[3])]
    kept = corpus_pipeline.deduped(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(k.doc_id for k in kept.collect()) == [*sorted(set(low)), 901] and len(set(low)) < 40


def test_simhash_links_in_crowds(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = int(r.integers(-(2**62), 2**62))
    fps = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 20, (60, 2))} | {int(x) for x in r.integers(-(2**62), 2**62, 50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {}
    for f in fps:
        want[f] = min((g for g in fps if ((f ^ g) & (2**64 - 1)).bit_count() <= 2), default=f)
    for crowd in (0, 4, 1000):
        monkeypatch.setattr(simhash, "CROWDED", crowd)
        comp = {x.node: x.component for x in graph.components(simhash.links(df)).collect()}
        for f in fps:
            assert comp.get(f, f) == comp.get(want[f], want[f])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (5, 5), (300, 100), (-4, 100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[300] == got[-4] == -4
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, empty):
    good = ["The river runs past the old mill and the road turns north toward hills of pine %d" % i for i in range(60)]
    junk = ["&&& Xx%% yy$$ zz### " * 12 + str(i) for i in range(12)] + ["| a | b | c | d " * 10 + str(i) for i in range(12)]
    r = np.random.default_rng(9)
    name = lambda: "".join(chr(97 + int(x)) for x in r.integers(0, 26, 7))
    slurs = ["blorvex", "grobnak", "snarfel", "dwimble", "quonkit"]  # made up: the operator has to learn them from labels
    bad = [" ".join([*(name() for _ in range(30)), *map(str, r.permutation(slurs)[:3])]) for _ in range(80)]
    more = [" ".join(name() for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate([*good, *junk, *bad, *more, None, ""])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(84 + i, 1, 1) for i in range(60)] + [(164 + i, 1, 0) for i in range(100)] + [(None, 1, 1), (90, None, None), (95, 1, 1)], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.op6(docs, labels).collect()}
    assert all(keep[i] for i in range(60)) and not any(keep[i] for i in range(60, 84)) and keep[364] and keep[365]
    assert sum(not keep[i] for i in range(84, 144)) >= 57 and sum(not keep[i] for i in range(144, 164)) >= 19  # the last have no labels
    assert sum(keep[i] for i in range(164, 364)) >= 190
    row = quality.held_out(docs, labels, 4).first()
    assert row.toxic >= 5 and row.toxic_rejected >= 0.9 * row.toxic and row.good_rejected <= 0.1 * row.good
    assert quality.op6(empty, labels).count() == 0
    assert quality.clean(docs, labels.limit(0)).columns == docs.columns


def test_quality_learns_beside_nulls_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN", 100)
    good = ["The river runs past the old mill and the road turns north toward hills of pine %d" % i for i in range(60)]
    junk = ["&&& Xx%% yy$$ zz### " * 12 + str(i) for i in range(12)] + ["| a | b | c | d " * 10 + str(i) for i in range(12)]
    rest = [None, ""] * 1000 + good[:1] * 500
    docs = spark.createDataFrame(list(enumerate([*good, *junk, *rest])), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.op6(docs, labels).collect()}
    assert not any(keep[i] for i in range(60, 84)) and all(keep[i] for i in keep if not 60 <= i < 84)


def test_lexicon_counts_near_copies_once_and_keeps_unrelated_texts(spark):
    r = np.random.default_rng(6)
    name = lambda: "".join(chr(97 + int(x)) for x in r.integers(0, 26, 9))
    vocabulary = [name() for _ in range(60)]  # long texts hold all of it, so they share the smallest word hash
    mixed = lambda *more: " ".join([*map(str, r.permutation(vocabulary)), *more])
    copies = [mixed("grobnak") for _ in range(1)] * 30
    toxic = [mixed("blorvex") for _ in range(20)] + [f"{t} {name()}" for t in copies]
    clean = [mixed() for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < len(toxic))) for i in range(len(toxic + clean))], "doc_id long, quality int, toxic int")
    lexicon = quality.toxic_lexicon(docs, labels)
    assert "blorvex" in lexicon and "grobnak" not in lexicon


def test_label_model_against_all_assignments():
    """EM ends where the likelihood of the flag patterns has a maximum, found here by a search over all parameters around it."""
    counts = {0: 700, 1: 60, 2: 50, 3: 90, 4: 40, 5: 70, 6: 60, 7: 130}
    _, bad, good, share = quality.estimate(counts, 3, 3000)

    def likelihood(x):
        total = 0.0
        for p, n in counts.items():
            f = [(p >> k) & 1 for k in range(3)]
            a, b = x[6], 1 - x[6]
            for k in range(3):
                a *= x[k] if f[k] else 1 - x[k]
                b *= x[3 + k] if f[k] else 1 - x[3 + k]
            total += n * np.log(a + b)
        return total

    at = [*bad, *good, share]
    best = likelihood(at)
    for k in range(7):
        for step in (-0.05, -0.02, 0.02, 0.05):
            assert likelihood([v + step * (i == k) for i, v in enumerate(at)]) < best + 0.05
    r = np.random.default_rng(5)
    for _ in range(3000):
        assert likelihood(np.clip(np.array(at) + r.normal(0, 0.03, 7), 0.001, 0.999)) < best + 0.05


def test_label_model():
    truth = np.random.default_rng(0).random(4000) < 0.2
    r = np.random.default_rng(1)
    fires = [truth & (r.random(4000) < a) | ~truth & (r.random(4000) < 0.02) for a in (0.9, 0.7, 0.5)]
    counts = {}
    for p in (sum(f.astype(int) << k for k, f in enumerate(fires))).tolist():
        counts[p] = counts.get(p, 0) + 1
    _, bad, good, share = quality.estimate(counts, 3)
    assert np.allclose(bad, (0.9, 0.7, 0.5), atol=0.08) and (good < 0.06).all() and abs(share - 0.2) < 0.03


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
        return 9 <= len(d) <= 15 if kind == "phone" else True

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN for m in re.finditer(p, text or "") if ok(k, m.group())]


def test_pii(docs, rows, empty):
    got = {r.doc_id: r for r in pii.op7(docs).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans(t)).encode()).hexdigest(), t
    assert pii.op7(empty).count() == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[12] == "mail [EMAIL] now [IP] or [CARD] and [PHONE] end" and clean[0] is None and clean[5] == PASSAGE
    assert not any(spans(t) for t in clean.values())


def test_pii_terms(spark):
    told = [(i, f"line {w} says Brunhilde wrote to b.h@example.org about {w}") for i, w in enumerate(["apples", "pears", "plums", "figs"])]
    other = [(10 + i, f"somebody says and wrote about line {i}") for i in range(30)]
    out = {r.doc_id: r.spans for r in pii.op7(spark.createDataFrame(told + other, "doc_id long, text string")).collect()}
    assert all("term:" in out[i] for i in range(4)) and not any(out[10 + i] for i in range(30))
    text = pii.sanitise(spark.createDataFrame(told, "doc_id long, text string").union(spark.createDataFrame(other, "doc_id long, text string"))).where("doc_id = 0").first().text
    assert "Brunhilde" not in text and "[EMAIL]" in text and "wrote" in text


def test_pii_terms_with_copies_and_one_signature(spark):
    told = [(i, f"line {w} says Brunhilde wrote to b.h@example.org about {w}") for i, w in enumerate(["apples", "pears", "plums", "figs"])]
    told += [(10 + i, told[0][1]) for i in range(1000)]
    signed = [(2000 + i, f"note {i} about the {w}\nGreetings from Kunibert, k.u@example.org") for i, w in enumerate(["sun", "moon", "sea", "hill", "road"])]
    other = [(3000 + i, f"somebody says and wrote about line {i}, greetings from the note") for i in range(30)]
    df = spark.createDataFrame(told + signed + other, "doc_id long, text string")
    text = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any("Brunhilde" in t or "Kunibert" in t for t in text.values())
    assert all(text[i] == t for i, t in other) and text[2000] == "note 0 about the sun\nGreetings from [TERM], [EMAIL]"


def disclosing(texts):
    """Disclosing terms by counting every pair of a term and an entity on a line."""
    own, met = {}, {}
    for text in set(texts):
        for w in {m.lower() for m in re.findall(r"[^\W\d_]{3,}", text)}:
            own.setdefault(w, set()).add(text)
        for line in text.split("\n"):
            entities = {line[int(i) : int(j)] for _, i, j in (x.split(":") for x in spans(line))}
            for e in entities:
                for w in {m.lower() for m in re.findall(r"[^\W\d_]{3,}", line)}:
                    if w not in e.lower():
                        met.setdefault((w, e), set()).add(text)
    return {w for (w, e), found in met.items() if len(found) >= 3 and 2 * len(found) >= len(own[w])}


def test_pii_terms_against_all_pairs(spark):
    r = random.Random(4)
    names, common = [f"name{chr(97 + i)}" for i in range(12)], ["the", "and", "wrote", "saw", "letter", "house", "Maria"]
    mails = [f"m{k}@example.org" for k in range(len(names))] + ["+49 170 1234567", "10.0.0.7"]

    def line():
        k = r.randrange(len(names))
        near = [names[k]] * (r.random() < 0.7) + [mails[k]] * (r.random() < 0.6 + k / 30) + [r.choice(mails)] * (r.random() < 0.2)
        out = near + r.choices(common, k=r.randrange(5)) + [r.choice(names)] * (r.random() < 0.1)
        return r.shuffle(out) or " ".join(out)

    texts = ["\n".join(line() for _ in range(r.randrange(4))) for _ in range(150)]
    texts += texts[:40] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = disclosing([t for t in texts if t is not None])
    assert {r.term for r in pii.disclosing(df).collect()} == want and 3 <= len(want) < len(names) + len(common)
    got = {r.doc_id: r.spans.split(",") if r.spans else [] for r in pii.op7(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == spans(t) + [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m.group().lower() in want]


def test_pii_term_far_from_its_entity(spark):
    told = [(i, f"Brunhilde {'and so on ' * (600 + i)} b.h@example.org") for i in range(3)]
    other = [(10 + i, f"and so on {i}") for i in range(30)]
    out = {r.doc_id: r.spans for r in pii.op7(spark.createDataFrame(told + other, "doc_id long, text string")).collect()}
    assert all(out[i].endswith(",term:0:9") for i in range(3)) and not any(out[10 + i] for i in range(30))


def test_pii_hundred_thousand_matches_in_a_text(spark):
    text = " ".join(f"u{i}@example.org" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "a@b.c")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.with_base(df).selectExpr("doc_id", "size(base) AS n", "base").collect()}
    assert [(b.start, b.end) for b in got[1].base] == [m.span() for m in re.finditer(r"\S+", text)] and got[2].n == 1
    clean = {r.doc_id: r.text for r in pii.generalised(pii.with_base(df), "base").collect()}
    assert clean == {1: " ".join(["[EMAIL]"] * 100_000), 2: "[EMAIL]"}
    assert time.monotonic() - began < 60


def test_mixing_counts(docs, rows, empty):
    got = {r.doc_id: r for r in mixing.op8(docs).collect()}
    for d, held, n, known, train, base in mixing.brute_base(rows):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert abs(r.base_score - base) <= 1e-9 * abs(base) + 1e-9 and r.score < 0
    assert mixing.op8(empty).count() == 0


def test_mixing_counts_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 60)
    rows = [(i, f"both w{i % 40} w{(i * 7 + 3) % 40} only{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in mixing.op8(df).collect()}
    for d, held, n, known, train, base in mixing.brute_base(rows):
        assert (got[d].held_out, got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (held, n, known, train)
        assert abs(got[d].base_score - base) <= 1e-9 * abs(base)


def test_substrings(docs, rows, empty):
    got = {r.doc_id: tuple(r) for r in substrings.op10(docs).collect()}
    assert [got[i] for i, _ in rows] == substrings.brute(rows)
    assert substrings.op10(empty).count() == 0


def test_substrings_pieces_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 300)
    rows = [(1, PASSAGE * 9), (2, "q" + PASSAGE * 7), (2, "q" + PASSAGE * 7), (2, PASSAGE[::-1] * 2), (None, PASSAGE), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substrings.op10(df).collect()), key=str)
    want = sorted(((None if d == -1 else d, *x) for d, *x in substrings.brute([(-1 if d is None else d, t) for d, t in rows])), key=str)
    assert [g[:4] for g in got if g[0] != 2] == [tuple(w[:4]) for w in want if w[0] != 2]


def test_near_graph(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 64))
    x = np.concatenate([base, base[:10] + r.normal(0, 0.02, (10, 64)), base[:5], base[0] + r.normal(0, 0.03, (30, 64))])
    x = [list(map(float, np.float32(v))) for v in x] + [None, [0.0] * 64, [float("nan")] * 64, [1.0, None] + [0.0] * 62]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    got = {t.vec_id: t for t in neargraph.op1(df).collect()}
    m = np.array(x[:85], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= 0.95
    assert sum(got[i].n_links for i in range(85)) >= 0.9 * (hit.sum() - 85)
    assert all(got[i].n_links <= hit[i].sum() - 1 for i in range(85))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(85, 89)) and got[0].kept and not got[50].kept
    assert neargraph.op1(df.limit(0)).count() == 0


def test_near_graph_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(neargraph, "CROWD", 40)
    r = np.random.default_rng(5)
    x = r.normal(size=64) + r.normal(0, 0.02, (150, 64))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = neargraph.op1(df).collect()
    assert {t.n_links for t in out} == {149} and {t.component_id for t in out} == {0}


PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Head &amp; shoulders</h1><p>First   para&#8217;s <b>text</b>.<br><p>Second\npara here.</article><footer>&copy; x</footer>"


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate([PAGE.replace("First", f"First{k}") for k in range(40)] + [None, ""])], "page_id long, url string, html string")
    got = {r.page_id: r for r in htmltext.op3(pages).collect()}
    assert got[0].text == "Head & shoulders\nFirst0 para’s text.\nSecond para here." and got[0].n_chars == len(got[0].text)
    assert got[40].text == got[41].text == ""
    assert htmltext.op3(pages.limit(0)).count() == 0


def test_labeller_gradient():
    m = htmltext.Labeller()
    r = np.random.default_rng(2)
    x, live = htmltext.padded([r.normal(size=(5, htmltext.DIM)), r.normal(size=(3, htmltext.DIM))])
    y = r.random(live.shape) < 0.5

    def loss():
        p, _ = m.chance(x, live)
        return float(-(np.where(y, np.log(p), np.log(1 - p)) * live).sum())

    p, (both, ka, kb) = m.chance(x, live)
    back = ((p - y) * live)[..., None] @ m.w["out"].T
    for name, g in (("ahead", m.grad(back[..., : htmltext.HIDDEN], m.w["ahead"], ka)), ("back", m.grad(back[::-1, :, htmltext.HIDDEN : 2 * htmltext.HIDDEN], m.w["back"], kb))):
        for at in ((3, 5), (htmltext.DIM + 2, 20), (htmltext.DIM + htmltext.HIDDEN, 40)):
            old = m.w[name][at]
            m.w[name][at] = old + 1e-5
            up = loss()
            m.w[name][at] = old - 1e-5
            down = loss()
            m.w[name][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_near_graph_against_all_pairs(spark):
    r = np.random.default_rng(14)
    centres = r.normal(size=(60, 32))
    x = np.concatenate([centres[k] + r.normal(0, 0.12, (12, 32)) for k in range(60)])
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(None, list(map(float, x[0]))), (5, list(map(float, x[9]))), (5, list(map(float, x[9])))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, share = neargraph.audited(df)
    got = {t.vec_id: t for t in out.where("vec_id is not null and vec_id <> 5").collect()}
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = m @ m.T >= 0.95
    weight = np.ones(len(x))
    weight[9] += 2
    want = hit @ weight - 1
    right = sum(got[i].n_links == want[i] for i in got)
    assert share >= 0.97 and right >= 0.97 * len(got) and all(got[i].n_links <= want[i] for i in got)
    low = np.arange(len(x))
    low[9] = 5
    for _ in range(20):
        for i in range(len(x)):
            low[i] = min(low[i], low[hit[i]].min())
    assert sum(got[i].component_id == low[i] for i in got) >= 0.95 * len(got)
    assert out.where("vec_id is null").first().n_links == 0


def test_near_graph_reports_a_low_recall(spark, monkeypatch):
    monkeypatch.setattr(neargraph, "recall", lambda nodes, links: 0.5)
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError):
        neargraph.op1(df)


def test_near_graph_finds_equally_near_members():
    """Groups whose members all lie about equally near, or exactly so: every pair within the threshold is found."""
    r = np.random.default_rng(3)
    tight = r.normal(size=64) + r.normal(0, 0.09, (400, 64))
    loose = r.normal(size=64) + r.normal(0, 0.22, (200, 64))
    scaled = np.outer(r.uniform(0.1, 9, 150), r.normal(size=64))
    raw = [neargraph.unit(list(v)) for v in np.concatenate([tight, loose, scaled, r.normal(size=(400, 64))])]
    x = neargraph.matrix(raw)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    assert 0 < hit[400:600, 400:600].mean() < 0.9
    nodes = np.arange(len(x))
    table = pd.DataFrame({"node": nodes, "vec": raw, "copies": 1, "shard": 0, "i": 0, "j": 0, "piece": 0, "shards": [[0]] * len(x)})
    found = neargraph.search(table.merge(neargraph.build(table), on="node"))
    want = hit.sum(axis=1)
    assert dict(zip(found["node"], found["links"], strict=True)) == {i: want[i] for i in nodes if want[i]}
    table["piece"] = table["node"] % 2
    table["j"] = 1
    table["near"] = [[]] * len(x)  # two pieces whose lists know nothing of each other
    found = neargraph.search(table)
    want = (hit & (nodes[:, None] % 2 != nodes % 2)).sum(axis=1)
    assert dict(zip(found["node"], found["links"], strict=True)) == {i: want[i] for i in nodes if want[i]}
