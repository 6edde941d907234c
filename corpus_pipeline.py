"""From raw documents to packed training sequences; each stage reads what its predecessor wrote.

A stage first gives back what Python workers still hold of the one before it, whoever calls it.

Nulls: a document without text or letters has no language and goes in the first stage; given to a later one, a null text counts
as empty, has no shingle and no benchmark word, stays, and packs to the single id 0. A null doc_id is a document like others.
An empty table stays empty, and columns beyond those of documents are kept up to the last stage.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontaminate, exact_dedup, jaccard_tiles, language_id, memory, packing
from kindred.session import scratch_folder

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; it learns from the labelled rows of docs that are not held out."""
    memory.give_back(spark)
    return language_id.accepted(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    memory.give_back(spark)
    return exact_dedup.survivors(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of five-word shingles of at least 0.8."""
    memory.give_back(spark)
    return jaccard_tiles.survivors(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    memory.give_back(spark)
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequences."""
    memory.give_back(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("jaccard_join", distinct_shingles),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
# The language model and the tokenizer have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read back as the next one's input."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
