"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import chat, epsilon, lines, minhash, mixing, pieces, pii, suffixes, topk, toxicity
from quillon.llm.common import Scratch, table

#: Vocabulary file of the public tokenizers; a parameter, never part of the repository.
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chain of op10: the labels' categories in the order they are predicted.
CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1"}


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0", Scratch(spark, "op2"), 10)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), pieces.read_model(PIECES_MODEL), Scratch(spark, "op4"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_digests(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon.near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op9"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs, chain, "toxic").drop("text")


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_top_k, op3_mix_sources, op4_sentencepiece, op5_line_dedup, op6_pii, op7_chat_format, op8_suffix_dedup, op9_embedding_near_dedup, op10_toxicity)}

#: Components of a table ``links`` (x, y) over nodes of ``nodes`` (id): smallest id reachable.
_COMPONENTS = """
        ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (SELECT id AS node, id AS root FROM nodes UNION SELECT ways.y, reach.root FROM reach JOIN ways ON reach.node = ways.x AND reach.root < ways.y),
        comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""

ORACLES = {
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.c + b.c - k)),
        nodes AS (SELECT doc_id AS id FROM documents),"""
    + _COMPONENTS
    + """
        SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN comp ON comp.node = d.doc_id""",
    "op9_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        nodes AS (SELECT vec_id AS id FROM embeddings),"""
    + _COMPONENTS
    + """
        SELECT d.vec_id, (SELECT count(*) FROM ways b WHERE b.x = d.vec_id) AS n_links, component_id, d.vec_id = component_id AS kept
        FROM embeddings d JOIN comp ON comp.node = d.vec_id""",
    "op2_top_k": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_chat_format": chat.CHAT_SQL,
    "op5_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
        d AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT l.doc_id, i, line, d.owner IS NOT NULL AND d.owner <> l.doc_id AS gone FROM l LEFT JOIN d ON l.k = d.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
