"""The registered queries of this package: one for each operator over its whole table, and the pipeline."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import (
    decontaminate, exact_dedup, html_extract, jaccard_tiles, language_id, packing, periodic_runs, piece_encoding, prefix_trie, sharding, substring_dedup,
    suffix_dedup, url_reputation,
)

QUERIES: dict = {}
ORACLES: dict = {}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, folder))


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A page's labelled outcome is the toxic flag of the document with its id."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    return url_reputation.filter_urls(pages(spark, folder), labels)


ORACLES["op2_url_filter"] = url_reputation.ORACLE


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_tiles.digest(documents(spark, folder))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, folder))


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(documents(spark, folder))


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(documents(spark, folder))


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, folder))


ORACLES["op9_exact_dedup"] = r"""WITH texts AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
  length(coalesce(text, '')) AS points FROM documents),
best AS (SELECT text_sha256, count(*) AS group_size, min_by(doc_id, {'p': -points, 'd': doc_id}) AS keep_id FROM texts GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN best USING (text_sha256)"""


@query
def op10_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(pages(spark, folder))


@query
def op11_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return piece_encoding.digest(documents(spark, folder))


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{folder}/conversations.parquet"))


ORACLES["op12_prefix_trie"] = prefix_trie.ORACLE


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digest(documents(spark, folder))
