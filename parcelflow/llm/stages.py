"""A corpus pipeline: language ID, exact and near deduplication, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps with their columns; the last gives
packed pieces. ``run`` writes every stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import drop_contaminated
from .exact_progressive import drop_exact_duplicates
from .langid_ecoc import keep_identified
from .packing import packed
from .shared import kept_batches, new_folder, removed, scratch, small_batches, table
from .simhash_bk import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null or letterless text, ambiguous ones. An empty table stays empty."""
    small_batches(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty), the row with the smallest id stays; of rows that repeat it, one."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8), the smallest id stays; rows with a null id always stay."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and wordless ones stay, and all where there are no items."""
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 2048 tokens; a null text is its end token, an empty table has no pieces."""
    small_batches(spark)
    return packed(docs, memory=24 << 20)  # the workers still hold what earlier stages left them


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what is between them is deleted, and so are the tables that a stage makes for itself."""
    docs, last = table(spark, sf_dir, "documents"), None
    with kept_batches(spark):
        for name, stage in STAGES:
            path = new_folder(spark, name)
            with scratch(spark):
                out = stage(spark, docs, sf_dir)
                out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if last:
                removed(spark, last)
            last = path
    return docs
