"""From raw documents to a training mixture: quality, lines, near duplicates, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontamination, line_dedup, mixing, ngram_jaccard, quality_rules
from lamella.llm.common import drop_scratch, scratch_made, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs of their language."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), joint=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or place has; ``n_chars`` follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 80 %), the document with the least id."""
    groups = ngram_jaccard.join_components(docs, shingle_words=5, percent=80)
    dropped = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which of the documents to read, how often and in which order."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_passages),
    ("mixing", mixture),
]

#: The candidates of line dedup and the edit-distance search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = scratch_made()
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        # The stage's own tables aren't needed any more.
        drop_scratch(spark, since=made, keep=path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
