"""The corpus pipeline: quality rules, language ID, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from tarnstone.llm import common, line_templates, minhash_forest, packing, quality_forest, rank_profiles

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents less like every profile than this are in no known language. On sf0.1 the least score of any document is 0.384,
#: samples of Italian, Polish and random letters have 0.24 to 0.34.
LEAST_SCORE = 0.35
#: A document that loses lines stays if so much of its characters is left: what is left of a copy is no document.
LEAST_LEFT = 0.2


def quality(spark, docs, sf_dir):
    """Documents that the base rules or the forest reject go.

    Null and empty texts fail the base rules; repeated rows fare alike; an empty table stays empty; further columns are left out.
    """
    return quality_forest.quality_filter(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark, docs, sf_dir):
    """Documents without letters, or like no language's profile, go.

    Null and empty texts have no letters. Profiles are learnt from the rows with a language; without any, all rows go. Repeated
    rows fare alike; an empty table stays empty.
    """
    found = rank_profiles.identify(docs, rank_profiles.fit(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark, docs, sf_dir):
    """Lines of recurring templates go but from the first document; so do documents left without a word or with under `LEAST_LEFT`.

    A document that loses no line stays as it is, null and empty texts too. Of a document's repeated rows all fare alike; null
    ids come last; an empty table stays empty. n_chars becomes the length of what is left (null for a null text).
    """
    # pairs of copies are left whole for the next stage: two documents make a passage recur only where copies are gone already
    found = line_templates.drop_lines(docs, keep=("lang", "source"), long_docs=line_templates.MIN_DOCS)
    size = F.length("text")
    left = found.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]") & (size >= LEAST_LEFT * (size + F.col("chars_dropped"))))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked ones stays: that of least id (nulls last), of repeated rows one.

    Null texts and texts without words are no copies of others; an empty table stays empty.
    """
    return minhash_forest.one_of_each(docs.select(*COLUMNS))


def pack(spark, docs, sf_dir):
    """Token sequences of all documents; a null or empty text is its end id alone, repeated rows are packed one by one, an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Isolation forest, greedy templates and byte-pair merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; what a stage keeps is written to the shared checkpoint folder and read again.

    Columns of `documents` beyond `COLUMNS` are left out by the first stage. The edge cases are those of the stages.
    """
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
