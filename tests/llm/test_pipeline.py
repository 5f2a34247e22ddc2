"""The pipeline's stages against brute force, with odd rows and clashing columns, and the pipeline as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, quality
from plumbline.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASHES = ["ids", "decoded", "n_words", "item_names", "word_spans", "junk_score", "toxic_score", "keep", "spans", "base", "fp", "node", "_own 1", "_row", "id", "lang"]
COLUMNS = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards box with daft zebras near a quiet river bank today"


def text(r, n=60):
    return " ".join("".join(r.choice(list("aeioulnrst"), 6)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(21)
    out = [(i, text(r)) for i in range(60)]
    out += [(100 + i, out[i][1]) for i in range(10)]  # copies
    out += [(200 + i, out[i][1].rsplit(" ", 1)[0] + " other") for i in range(10, 20)]  # near copies
    out += [(300 + i, PASSAGE + " " + text(r, 20)) for i in range(3)]  # benchmark passages
    out += [(400, "write to a.b@c.de or 10.0.0.255 " + text(r)), (401, "x " * 40_000 + text(r)), (402, "1 " + "word" * 30_000)]
    out += [(None, None), (None, ""), (None, out[0][1]), (5, text(r)), (5, out[5][1]), (None, text(r)), (None, text(r))]
    return [(*x, *(f"{c} {k}" for c in CLASHES)) for k, x in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("b", PASSAGE), (None, None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def shingles(t):
    own = (t or "").lower().split()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def one_of_each(rows):
    """Rows by comparing all pairs: the first by id (nulls last) of each component."""
    sets = [shingles(x[1]) for x in rows]
    low = list(range(len(rows)))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b)]
    for _ in range(6):
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    groups = {}
    for k, x in zip(low, rows, strict=True):
        groups.setdefault(k, []).append(x)
    return [min(g, key=lambda x: (x[0] is None, x[0])) for g in groups.values()]


def test_stages_keep_all_columns(spark, docs, folder, rows):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        own = {tuple(x[2:]) for x in rows}
        assert all(tuple(x)[2:] in own for x in out.collect()), name
    out = corpus_pipeline.encoded(spark, docs, folder)
    assert set(out.columns) == (set(docs.columns) - {"decoded"}) | {"ids", "n_tokens"}


def test_near_duplicates_against_all_pairs(spark, docs, folder, rows):
    got = corpus_pipeline.deduped(spark, docs, folder).collect()
    assert sorted((str(x.doc_id), x.text or "") for x in got) == sorted((str(x[0]), x[1] or "") for x in one_of_each(rows))


def test_benchmark_against_plain_search(spark, docs, folder, rows):
    found = decontaminate.brute([x[1] for x in rows], [("b", PASSAGE)])
    want = [x[1] for x, (n, hit, *_) in zip(rows, found, strict=True) if not (hit and 20 * hit >= n)]
    assert sorted(x.text or "" for x in corpus_pipeline.benchmark(spark, docs, folder).collect()) == sorted(t or "" for t in want)


def test_personal_data_and_encoding(spark, docs, folder, rows):
    from tokenizers import Tokenizer

    got = {x.lang: x.text for x in corpus_pipeline.private(spark, docs, folder).collect()}
    for x in rows:
        assert got[x[-1]] == (x[1] if x[0] != 400 else x[1].replace("a.b@c.de", "[EMAIL]").replace("10.0.0.255", "[IP]"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for x in corpus_pipeline.encoded(spark, docs, folder).collect():
        assert x.ids == library.encode(x.text or "", add_special_tokens=False).ids and x.n_tokens == len(x.ids)


def test_whole_pipeline(spark, folder, rows):
    kept = {(x.doc_id, x.text): x.keep for x in quality.op6(table(spark, folder, "documents"), table(spark, folder, "labels")).join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    good = quality.clean(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()
    first = one_of_each([tuple(x) for x in good])
    found = decontaminate.brute([x[1] for x in first], [("b", PASSAGE)])
    want = [x for x, (n, hit, *_) in zip(first, found, strict=True) if not (hit and 20 * hit >= n)]
    assert sorted(str(x.doc_id) for x in got) == sorted(str(x[0]) for x in want) and kept and len(want) > 40
    assert not any("a.b@c.de" in (x.text or "") for x in got)


def test_empty_tables(spark, docs, folder, tmp_path):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
    at = str(tmp_path / "empty")
    for name, df in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id string, text string"))):
        df.write.parquet(f"{at}/{name}.parquet")
    some = docs.where(F.col("doc_id") < 20)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, some, at).count() > 0, name
