"""A corpus from raw documents: identified, deduplicated, mixed to target weights, encoded.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last return the columns of documents.

Defined results: documents whose text is null, empty or without letters are rejected by the first stage, as are all if no labelled row is there to learn from; an empty table gives
empty ones throughout. Ids may be null or repeat: of texts equal but for the case of A-Z the row with the largest id stays (null is the smallest), of near copies that with
the smallest id (null ids last), of ties one row; the mix takes rows by a hash of id and text, so that rows equal in both go together, and may hold a row up to three times. Long texts are
read whole; columns beyond those of documents are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.bpe import encode_documents
from docloom.llm.exact_dedup import drop_exact_copies
from docloom.llm.jaccard import keep_one_of_each_group
from docloom.llm.language_id import keep_identified
from docloom.llm.mixing import mixed_documents
from docloom.llm.queries import VOCABULARY
from docloom.llm.shared import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, VOCABULARY, ids=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language models, components and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
