"""The registered queries of the corpus operators: thin calls over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, htmltext, mergereplay, mixing, neargraph, pii, quality, rolerepair, shards, simhash, substrings
from .common import table


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op7(table(spark, sf_dir, "documents"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op9(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_near_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neargraph.op1(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.op2(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.op3(table(spark, sf_dir, "pages"))


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.op4(table(spark, sf_dir, "documents"))


def op10_suffix_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op10(table(spark, sf_dir, "documents"))


def op11_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolerepair.op11(table(spark, sf_dir, "conversations"))


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return mergereplay.op12(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_graph": op1_near_graph,
    "op2_bpe": op2_bpe,
    "op3_blocks": op3_blocks,
    "op4_ring_shards": op4_ring_shards,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_context_mixing": op8_context_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_suffix_ranks": op10_suffix_ranks,
    "op11_role_repair": op11_role_repair,
    "op12_merge_replay": op12_merge_replay,
    "op13_collocations": op13_collocations,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_near_graph": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
        FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op9_decontaminate": f"""
        WITH b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
        b2 AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM b2)),
        d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
        hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, g)),
        words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        s AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
        g AS (SELECT lang, d, array_to_string(ws[i:i + d - 1], ' ') AS phrase FROM (SELECT lang, ws, d, unnest(range(1, len(ws) - d + 2)) AS i FROM s, range(1, 4) AS depth(d) WHERE len(ws) >= d)),
        f AS (SELECT lang, d, phrase, count(*) AS f FROM g GROUP BY lang, d, phrase),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE d = 1 GROUP BY lang),
        c AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE d > 1 AND f >= 10),
        cut AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:d], ' ') AS y FROM c, range(1, 3) AS cuts(k) WHERE k < d),
        v AS (SELECT cut.lang, cut.d, cut.phrase, a, k, fx.f AS l, fy.f AS r, (1000000::HUGEINT * a * a // (fx.f::HUGEINT * fy.f))::BIGINT AS score
            FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x AND fx.d = k JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y AND fy.d = cut.d - k),
        low AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        h AS (SELECT lang, q, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS q FROM c WHERE d = 3) GROUP BY lang, q),
        kept AS (SELECT low.* FROM low LEFT JOIN h ON h.lang = low.lang AND h.q = low.phrase AND low.d = 2 WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}
