"""From raw documents to token ids: quality, exact copies, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents. A stage whose work is done by Python first lets the
executors give back what the stages before it left in their heaps."""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import exact_dup, mixing, near_dup, pieces, quality
from claimlens.session import materialize, settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    settle(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of equal texts."""
    return exact_dup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group that near-duplicate links connect."""
    settle(spark)
    return near_dup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes the sources to their target weights: by file, and within a file by row."""
    return mixing.mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and position of every document; position counts from 0 in the order of the mix. Spark
    reads the mixing stage's files in any order, so the position is that of the row in its file, after all rows of
    the files before."""
    settle(spark)
    return pieces.encode(_in_order(docs), position="__position")


def _in_order(docs: DataFrame) -> DataFrame:
    """docs with their number, __position, by file name and row within the file; rows that come from no file are
    numbered by partition (with gaps)."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("__name"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__position"))
    # parts are numbered in five digits or more
    files = sorted(rows.groupBy(F.col("__name").alias("name")).count().collect(), key=lambda r: (len(r["name"]), r["name"]))
    starts = [(r["name"], n - r["count"]) for r, n in zip(files, accumulate(r["count"] for r in files), strict=True)]
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "__name string, __start long"))
    return rows.join(starts, "__name").select("doc_id", "text", (F.col("__start") + F.col("__row")).alias("__position"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mix_stage), ("encode", encode_stage)]

#: SentencePiece can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
