"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from graphloom.llm import bpe, html_text, jaccard, langid, line_crf, line_dedup, mixing, quality_cnn, suffix_dedup, topk
from graphloom.llm.common import held_out, table
from graphloom.llm.fitting import labelled_sample

#: The rank file of op3; another one of the same format can stand here.
RANKS = "byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed_lines")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    c = mixing.copies(docs, keep=["doc_id"])
    return c.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_shards")).alias("taken"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), line_crf.FIT_DOCS, line_crf.FIT_CHARS)
    return line_crf.apply_rules(docs, line_crf.fit(sample))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), quality_cnn.FIT_DOCS, quality_cnn.FIT_CHARS)
    found = quality_cnn.classify(docs, quality_cnn.fit(sample))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_bpe": op3_bpe,
    "op4_html_text": op4_html_text,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_top_k": op6_top_k,
    "op7_source_mixing": op7_source_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        k AS (SELECT doc_id, s, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS content FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS turn FROM k WHERE content IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, s + t.o AS s FROM r, (VALUES (0), (1), (2)) t(o) WHERE turn > 1),
        g AS (SELECT w.doc_id, w.i FROM w JOIN gone USING (doc_id, s)),
        o AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(g.i) AS n_removed_lines FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id),
        n AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text, coalesce(n.n_lines, 0) AS n_lines, coalesce(o.n_removed_lines, 0) AS n_removed_lines
        FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op6_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score
              FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND len(e.v) = len(q.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
