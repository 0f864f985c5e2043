"""The corpus pipeline: ``documents`` to a deduplicated, decontaminated corpus
without secrets, with a rate per document.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns the documents that stay. ``run`` applies them in order, each result
written as Parquet in the shared scratch folder and read again. The first four
return the columns of ``documents``; the last adds the mixing rate. Nulls,
repeated rows and empty texts are handled as the operators' docstrings say:
texts without words fail the quality rules, of repeated rows one stays.

SQL can express neither the robust estimates of the first stage nor the fit of
the last, so there is no ORACLE_SQL; the tests compare every stage with a
brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravel.llm.common import prepare, saved
from ravel.llm.decontamination import drop_contaminated
from ravel.llm.mixing import mix
from ravel.llm.near_dups import drop_near_duplicates
from ravel.llm.quality import keep_good
from ravel.llm.secrets import redact
from ravel.session import scratch_path
from ravel.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's and
    source's statistics go."""
    prepare(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies stays;
    five-word shingles, similarity 0.8 or more."""
    prepare(spark)
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced; n_chars follows."""
    from pyspark.sql import functions as F
    prepare(spark)
    clean = redact(docs, scratch_path(spark, "ledger"))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the rate at which they are drawn, so that expected tokens
    per domain meet the target weights; those that are never drawn go."""
    prepare(spark)
    return mix(docs, table(spark, sf_dir, "labels"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret scan", secret_scan), ("mixing", mixing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
