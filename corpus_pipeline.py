"""The corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and gives the columns of ``documents``; the last gives token
ids. ``run`` writes each stage's rows as Parquet in the shared folder and hands the written table on,
so a lost executor costs at most the stage at work.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard, langid, line_dedup, mixing
from graphloom.llm.common import held_out, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_50k.tiktoken"
#: Repeated runs of lines go from as many words on, however few the lines.
PASSAGE_WORDS = 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language identifier rejects; a missing lang takes the identified one."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs.select(*COLUMNS), model).where("not lang_rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of three lines or of PASSAGE_WORDS words; a document of which nothing is left goes."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS), words=PASSAGE_WORDS).where("n_removed_lines < n_lines or n_lines = 0")
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of linked documents; one without an id has no links and stays."""
    groups = jaccard.similar_groups(docs)
    firsts = groups.where("doc_id = component_id").select("doc_id")
    rows = docs.select(*COLUMNS)
    kept = rows.where("doc_id is not null").join(firsts, "doc_id", "left_semi").select(*COLUMNS)
    return kept.unionByName(rows.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, as often as the mix does, to the sources' target weights."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every row, checked against the text by decoding them."""
    found = bpe.encode(docs.select(*COLUMNS), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return found.select("doc_id", "lang", "source", "n_tokens", "token_ids", whole.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("source_mixing", mixed),
    ("bpe", token_ids),
]

#: Language identification compresses texts, which SQL cannot express; tests hold every stage to the effect it must have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
