"""Driver tables: one Parquet file (or folder) per table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


SPLITS = 4      # splits a core from which on a scan is taken to keep every core at work


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a unique key where its scan gives fewer than
    ``SPLITS`` partitions a core: costly work on texts would leave cores idle.
    The number of splits alone does not tell, for a Parquet file's rows lie in
    the splits where its row groups begin, and one group may span all of them.
    What is moved is bounded by so many splits; an input with more is not
    moved. Results are the same either way."""
    try:
        parts = df.sparkSession.sparkContext.defaultParallelism * SPLITS
    except Exception:  # Spark Connect tells neither cores nor partitions
        return df
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table. Column pruning and filters reach the Parquet scan."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)

