"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmix.llm import line_dedup, minhash_dedup, packing, suffix_dedup, toxicity
from salesmix.llm.common import prepare, stored, table, unused_name
from salesmix.llm.queries import TOXIC_FROM, toxicity_model


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    now = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(now))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    prepare(spark)
    return toxicity.without_toxic(docs, toxicity_model(spark, sf_dir), TOXIC_FROM)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines taken out; a document of which nothing is left goes."""
    prepare(spark)
    before = unused_name(docs, "before")
    size = F.coalesce(F.length(F.trim("text")), F.lit(0))
    out = line_dedup.without_repeated_lines(docs.withColumn(before, size))
    return _counted(out.filter((F.col(before) == 0) | (size > 0)).drop(before))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    kept = minhash_dedup.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(stored(kept, "kept"), "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that occur twice or more taken out."""
    prepare(spark)
    return _counted(suffix_dedup.without_repeats(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of each document or piece of one."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", clean), ("line_dedup", line_dedup_stage), ("minhash_dedup", minhash_stage),
          ("suffix_dedup", suffix_stage), ("best_fit_packing", packing_stage)]

# Toxicity is a fitted model and packing a search, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
