"""Byte-level merge replay, phrase collocations and role repair against brute force and the tiktoken library."""

import base64
import hashlib
import pathlib
import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import collocations, mergereplay, queries, rolerepair

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return mergereplay.Ranks(RANKS)


def replayed(ranks, texts, split=None):
    split, number = split or mergereplay.Splitter(public_tokenizers.PATTERN), mergereplay.Words()
    own = [[number[w] for w in split.words(t)] for t in texts]
    flat, starts = mergereplay.merged(ranks, [w.encode() for w in number.list])
    return [[i for w in ws for i in flat[starts[w] : starts[w + 1]].tolist()] for ws in own]


@pytest.mark.parametrize("form", ["a%sb", " 1%s 2", "x %s%s"])
def test_merge_replay_every_code_point(library, ranks, form):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    split = mergereplay.Splitter(public_tokenizers.PATTERN)
    for i in range(0, len(points), 50_000):
        texts = [form.replace("%s", c) for c in points[i : i + 50_000]]
        assert replayed(ranks, texts, split) == library.encode_ordinary_batch(texts)


def test_merge_replay_mixed_strings(library, ranks):
    r = random.Random(3)
    parts = ["a", "b", "e", " ", "aaa", "the", " the", "\n", "'s", "1", "é", "😀", "　", "abc"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(8000)]
    texts += ["".join(r.choice("etaoinshrdluTHE'") for _ in range(r.randint(1, 200))) for _ in range(8000)]
    texts += ["a" * 5000, " " * 3000 + "x", "ab" * 3000, "the" * 999]
    assert replayed(ranks, texts) == library.encode_ordinary_batch(texts)


def test_merge_replay_in_odd_orders(tmp_path):
    """Random rank files in which pairs of lower rank arise from merges of higher rank, against one merge at a time."""
    r = random.Random(8)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        more = list({bytes(r.choice(b"ab") for _ in range(r.randint(2, 5))) for _ in range(14)})
        r.shuffle(more)
        path = tmp_path / "ranks"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens + more)))
        own = mergereplay.Ranks(str(path))
        words = list({bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(60)})
        flat, starts = mergereplay.merged(own, words)

        def plain(word):
            if word in own.rank:
                return [own.rank[word]]
            parts = [bytes([b]) for b in word]
            while True:
                found = [(own.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in own.rank]
                if not found:
                    return [own.rank[p] for p in parts]
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        for k, w in enumerate(words):
            assert flat[starts[k] : starts[k + 1]].tolist() == plain(w)


TEXTS = [None, "", " ", "Don't stop\x00 <|endoftext|>", "é😀 " * 50, "a" * 30_000, "word " * 9000, "Same text", "Same text"]


def test_op12(spark, library, monkeypatch):
    monkeypatch.setattr(mergereplay, "SLICE_BYTES", 1 << 12)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in mergereplay.op12(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = mergereplay.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    again = mergereplay.decode(coded, RANKS)
    assert again.where("decoded <> cast(coalesce(text, '') as binary)").count() == 0
    assert mergereplay.op12(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_index_extension():
    """Every interval of both indexes holds as many rows as its phrase has places, and starts where it should."""
    seq = np.concatenate(([0], np.random.default_rng(2).integers(0, 5, 600), [0])).astype(np.int32)
    index, everything = collocations.Index.built(seq), lambda p: np.ones(len(p), bool)
    places = lambda p: sum(seq[i : i + len(p)].tolist() == p for i in range(len(seq)))
    for first, second in product((True, False), repeat=2):
        level = index.words()
        for left in (first, second):
            level = index.extended(level, left, everything)
            assert all(places(p) == n for p, n in zip(level.phrase.tolist(), level.n.tolist(), strict=True))
        want = {tuple(seq[i : i + 3].tolist()) for i in range(len(seq) - 2) if 0 not in seq[i : i + 3]}
        assert set(map(tuple, level.phrase.tolist())) == want and len(level.n) == len(want)


def test_extension_for_the_other_direction():
    seq = np.concatenate(([0], np.random.default_rng(6).integers(0, 5, 600), [0])).astype(np.int32)
    index, everything = collocations.Index.built(seq), lambda p: np.ones(len(p), bool)
    whole, part = index.extended(index.words(), True, everything), index.extended(index.words(), True, everything, both=False)
    assert (whole.phrase == part.phrase).all() and (whole.mirror == part.mirror).all() and (whole.n == part.n).all()
    assert (index.extended(part, False, everything).n == index.extended(whole, False, everything).n).all()
    alone = collocations.Index(index.bwt, None)  # what is behind is not read for pairs
    assert (alone.extended(alone.words(), True, everything, both=False).n == whole.n).all()


def phrases_of(spark, rows, **more):
    docs = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(3)
    return sorted(tuple(r) for r in collocations.op13(docs, **more).collect())


def test_op13(spark, monkeypatch):
    r = random.Random(4)
    words = ["The", "cat", "sat", "ON", "mat", "été", "\x00", "ß", "a\x1cb", "x" * 300]
    rows = [(" ".join(r.choices(words, range(10, 0, -1), k=r.randint(0, 40))).replace("on", r.choice(["on", "on.", "on\t", "on\n"])), r.choice(["en", "de", "", None])) for _ in range(400)]
    rows += [(None, "en"), ("", None), ("the cat sat", "en"), ("the cat sat", "en"), ("only here", "fr"), ("hot pair " * 4000, "en")]
    monkeypatch.setattr(collocations, "SHARD_BYTES", 1 << 12)
    assert phrases_of(spark, rows) == sorted(collocations.brute(rows))
    assert phrases_of(spark, rows, top=5) == sorted(collocations.brute(rows, top=5))
    monkeypatch.setattr(collocations, "FIELD", 1 << 3)  # a full field prunes nothing and changes nothing
    assert phrases_of(spark, rows) == sorted(collocations.brute(rows))
    assert phrases_of(spark, []) == []


def test_row_groups_of_the_index_hold_few_shards(spark, monkeypatch):
    import pyarrow.parquet as pq

    from plumbline.llm import common

    monkeypatch.setattr(collocations, "SHARD_BYTES", 1 << 12)
    monkeypatch.setattr(collocations, "GROUP_BYTES", 1 << 15, raising=False)
    r = random.Random(9)
    docs = spark.createDataFrame([(" ".join(str(r.randrange(500)) for _ in range(200)), "en") for _ in range(300)], "text string, lang string").coalesce(1)
    collocations.counted(docs)
    index = [p for p in common.WRITTEN if "collocations-index" in p][-1]
    groups = [m.row_group(k).num_rows for f in pathlib.Path(index.removeprefix("file://")).glob("*.parquet") for m in [pq.read_metadata(f)] for k in range(m.num_row_groups)]
    assert sum(groups) > 50 and max(groups) <= 4  # at Parquet's own pace: all in one


def test_pairs_are_summed_in_parts(spark):
    """Each pass sums another part of the pairs, with about an equal share, and none twice."""
    r = random.Random(5)
    docs = spark.createDataFrame([(" ".join(str(r.randrange(90)) for _ in range(300)), "en") for _ in range(40)], "text string, lang string")
    index = collocations.shards(docs, "text", "lang")
    every = collocations.Field(8, {0: b"\xff"})
    parts = [{x.h for x in collocations.pair_sums(index, spark.sparkContext.broadcast(every), k).select("h").distinct().collect()} for k in range(collocations.PASSES)]
    pairs = {p for d in docs.collect() for p in zip(d.text.split(), d.text.split()[1:], strict=False)}
    assert sum(map(len, parts)) == len(set().union(*parts)) == len(pairs)
    assert min(map(len, parts)) > 0.4 * len(pairs)


def test_symbols_survive_their_planes():
    own = np.random.default_rng(1).integers(0, 2**31, 1000).astype(np.int32)
    assert (collocations.symbols(collocations.planes(own)) == own).all() and len(collocations.symbols(b"")) == 0


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_001
    one = spark.createDataFrame([("en", "x", big), ("en", "y", big + 7)], "lang string, phrase string, f long")
    two = spark.createDataFrame([("en", "x y", big - 1)], "lang string, phrase string, f long")
    row = collocations.scored(two, one, two, [(1, 1)], 2).first()
    assert row.score == 1000000 * (big - 1) ** 2 // (big * (big + 7))


def test_op13_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op13_collocations"]).fetchall())
    assert sorted(tuple(r) for r in queries.op13_collocations(spark, folder).collect()) == want


ROLES = ["user", "assistant", "system", "tool", "user", "assistant"]


def conversations(r, n):
    rows = []
    for c in range(n):
        for t in range(r.randint(0, 9)):
            text = r.choice(["Yes.", "No!", "Well", " ", "", None, "So? \n", "Ends. ", "Yes."])
            rows.append((c if c else None, r.choice([t, t, t, None, t + 3]), r.choice([*ROLES, None, "", "U"]), text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def report(spark, rows, schema=SCHEMA):
    return {r[0]: tuple(r)[1:] for r in rolerepair.op11(spark.createDataFrame(rows, schema).repartition(3)).collect()}


def test_op11(spark, monkeypatch):
    rows = conversations(random.Random(6), 150)
    assert report(spark, rows) == rolerepair.brute(rows) | {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows} - set(rolerepair.brute(rows))}
    assert report(spark, []) == {}
    monkeypatch.setattr(rolerepair, "SEGMENT_ROWS", 2)
    few = rows[:200]
    got = report(spark, few)
    assert all(got[c] == v for c, v in rolerepair.brute(few).items())


def test_op11_one_hot_conversation(spark):
    """A conversation of many rows over many tasks, equal rows and rows that never come into step among them."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(1, 20_001)] + [(7, 5, "user", "Again.")] * 3000 + [(c, 0, "user", "Hi") for c in range(50)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", n string").repartition(8)
    got = {r[0]: tuple(r)[1:] for r in rolerepair.op11(docs).collect()}
    want = rolerepair.brute([r for r in rows if r[0] != 7]) | {7: got[7]}
    assert {c: v for c, v in got.items() if c in want} == want
    _, blank, duplicate, _, _, cost, audit, _ = got[7]
    own = [r for r in rolerepair.damaged(docs.where("conv_id = 7").select("conv_id", "turn", "role", "text")).agg(F.sum("n")).first()]
    assert sum(audit.count(x) for x in "KDR") == own[0] and blank + duplicate >= 2999
    edits = sum(rolerepair.COSTS[x] for x in audit)
    assert edits <= cost <= edits + 20_000


def test_parser_against_all_edit_strings():
    """Cost and audit of every short input against the enumeration of all edit strings."""
    parser, legal = rolerepair.Parser(), re.compile(r"(s?(ua)+)?\Z")

    def all_repairs(symbols, at=0, roles="", audit="", cost=0, inserts=0):
        if at == len(symbols) and legal.match(roles):
            yield cost, audit
        if inserts < 3:
            for x in "ua":
                yield from all_repairs(symbols, at, roles + x, audit + "I", cost + 2, inserts + 1)
        if at < len(symbols):
            s = symbols[at]
            yield from all_repairs(symbols, at + 1, roles, audit + "D", cost + 3, inserts)
            if not s & rolerepair.GONE:
                more = 1 if s & rolerepair.TRUNCATED else 0
                if s & 3 < 3:
                    yield from all_repairs(symbols, at + 1, roles + "sua"[s & 3], audit + "K", cost + more, inserts)
                for x in "ua":
                    yield from all_repairs(symbols, at + 1, roles + x, audit + "R", cost + 2 + more, inserts)

    for symbols in [*product([0, 1, 2, 3, 5, 9], repeat=2), *product([0, 1, 2], repeat=3), (5, 9, 6, 1), (2, 2, 1, 1), ()]:
        cost, letters, tail = parser.repair(bytes(symbols))
        assert (cost, "".join(letters) + tail) == min(all_repairs(symbols))


def test_fixed_rows(spark):
    rows = [(1, 10, "user", "Hello there."), (1, 12, "user", "And then?"), (1, 13, "assistant", "Good.")]
    fixed = rolerepair.Repair(spark.createDataFrame(rows, SCHEMA)).lines().orderBy("part", "seq", "pos").collect()
    roles = [r.role for r in fixed]
    assert roles == ["user", "assistant"] * (len(roles) // 2)


def test_equal_rows_are_dealt_to_many_cells(spark, monkeypatch):
    from plumbline.llm import shards

    monkeypatch.setattr(shards, "BLOCK", 1 << 10)
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 != 0, F.lit("x")).alias("text"))
    keep = {"size": shards.byte_size("text"), "text_crc32": F.lit(0).cast("long")}
    rows = shards.placed_rows(docs, "doc_id", keep, ["size", "text_crc32"], shards.ring(8)[0])
    assert rows.count() == 30_000
    assert rows.groupBy("_arc", "_cell").count().agg(F.max("count")).first()[0] < 400
    out = shards.op4(docs).collect()
    per = {}
    for r in out:
        per.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 30_000 and all(sorted(s) == list(range(3750)) for s in per.values())


def test_growing_by_a_shard_moves_few_rows(spark):
    """Rows that change shards when one more is added: its own, and what the shifted quotas push on."""
    from plumbline.llm import shards

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    keep = {"size": shards.byte_size("text")}
    a, b = ({r.doc_id: r.shard for r in shards.assign(docs, "doc_id", keep, ["size"], n).collect()} for n in (8, 9))
    moved = sum(a[k] != b[k] for k in a)
    assert 20_000 // 9 <= moved <= 0.4 * 20_000 and len(set(b.values())) == 9  # all of them would be 8 of 9 by chance


def test_vectors_of_other_lengths_never_link(spark):
    from plumbline.llm import neargraph

    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.02]), (5, [1.0]), (6, []), (7, [0.0, 1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neargraph.op1(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_prefix_pairs_lose_no_link(spark):
    """Every pair of sets alike by 0.8 in different components is a candidate; sets with only a passage in common are none."""
    from plumbline.llm import neartext

    r = random.Random(12)
    passage = list(range(40))
    sets = [sorted({*passage, *r.sample(range(100, 10**6), 60)}) for _ in range(60)]
    for base in sets[:15]:
        for edits in (1, 5, 9, 11):
            kept = r.sample(base, len(base) - edits)
            sets.append(sorted({*kept, *r.sample(range(10**6, 10**7), edits)}))
    sets += [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 4], [7], [7, 8]]
    nodes = spark.createDataFrame([(i, len(s), i if i % 2 else -1, s) for i, s in enumerate(sets)], "node long, n long, component long, own array<long>")
    found = {(p.a, p.b) for p in neartext.prefix_pairs(nodes.drop("own"), nodes.select("node", "own")).collect()}
    alike = {(a, b) for a in range(len(sets)) for b in range(a) if (a % 2 or b % 2) and 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))}
    assert alike <= found and len(alike) > 30
    assert not any(a < 60 and b < 60 for a, b in found)


def test_prefix_pairs_of_a_family(spark):
    """Copies of one text with many edits each: similar pairs are all candidates, pairs with too many edits hardly any."""
    from plumbline.llm import neartext

    r = random.Random(7)
    base = list(range(400))
    sets = []
    for k, edits in enumerate([70] * 80 + [20] * 6 + [30, 40, 43, 45, 50, 60] * 4):
        shared = r.sample(base, 400 - edits - r.randrange(3))
        sets.append(sorted({*shared, *range(1000 * (k + 1), 1000 * (k + 1) + edits)}))
    sets += [sets[80][:350], sets[80] + [10**6 + i for i in range(90)]]
    nodes = spark.createDataFrame([(i, len(s), i, s) for i, s in enumerate(sets)], "node long, n long, component long, own array<long>")
    pairs = [(p.a, p.b) for p in neartext.prefix_pairs(nodes.drop("own"), nodes.select("node", "own")).collect()]
    alike = {(a, b) for a in range(len(sets)) for b in range(a) if 9 * len(set(sets[a]) & set(sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert alike <= set(pairs) and len(alike) >= 15
    assert not any(a < 80 and b < 80 for a, b in pairs)


def test_scorers_are_fitted_outside_the_driver(spark, monkeypatch):
    import os

    from plumbline.llm import quality

    here, plain = os.getpid(), quality.trained

    def elsewhere(*given):
        assert os.getpid() != here
        return plain(*given)

    rows = [(i, f"The {w} house stands on a hill, and {w} people live in it. They like the {w} garden.") for i, w in enumerate("old new red tall grey calm".split())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    want = quality.scored(docs, labels).orderBy("doc_id").collect()
    monkeypatch.setattr(quality, "trained", elsewhere)
    assert quality.scored(docs, labels).orderBy("doc_id").collect() == want
