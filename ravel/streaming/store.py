"""K2 and K3 as writes: the stored reviews and their comments.

Reviews lie in plain Parquet folders, one per bucket of the key (repo, PR, sha).
A batch reads and rewrites the buckets it touches; the files of the others stay
as they are. The new content is written beside the table first and moved in by
a second write from there, and a small table names the batch that was moved in
last. A batch that was ended halfway is thus moved in before the next one, and
the same batch can be applied again.

Comments are appended under their batch id, so a batch run again replaces its
own rows. Their ids follow the order (review, position) behind the largest id
stored: rows are dealt by range, numbered inside their partition, and a table
of one row a partition gives the offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import stored
from ..operators.reviews import REVIEW_KEY, review_comment_rows, upsert_reviews
from ..session import scratch_path
from .streams import exists, merged_reviews, stored_batches, write_batch

BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*REVIEW_KEY), F.lit(buckets)).cast("int")


def _move_in(spark: SparkSession, path: str) -> None:
    staged = spark.read.parquet(f"{path}_staged")
    batch_id = staged.agg(F.max("batch_id")).first()[0]
    (staged.drop("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("bucket").parquet(path))
    spark.range(1).select(F.lit(batch_id).alias("batch_id")).write.mode("overwrite").parquet(f"{path}_applied")


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a batch that was written beside the table and not moved in. True
    if there was one."""
    if not exists(spark, f"{path}_staged/_SUCCESS"):
        return False
    staged = spark.read.parquet(f"{path}_staged").agg(F.max("batch_id")).first()[0]
    done = spark.read.parquet(f"{path}_applied").first()[0] if exists(spark, f"{path}_applied/_SUCCESS") else None
    if staged is None or staged == done:
        return False
    _move_in(spark, path)
    return True


def apply_reviews(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, buckets: int = BUCKETS,
                  seq: str = "id") -> list[int]:
    """K2: apply a batch to the table at ``path`` and give the buckets that it
    touched (at most ``buckets``). Rows of one key: the first in ``seq`` order
    supplies all columns, the last the score; the table's row comes first."""
    recover(spark, path)
    new = batch.withColumn("bucket", _bucket(buckets))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())   # at most ``buckets`` numbers
    if not touched:
        return []
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)) if exists(spark, path) else None
    merged = upsert_reviews(old, new, seq).withColumn("batch_id", F.lit(batch_id).cast("long"))
    merged.repartition(len(touched), "bucket").write.mode("overwrite").parquet(f"{path}_staged")
    _move_in(spark, path)
    return touched


def stored_reviews(spark: SparkSession, path: str) -> DataFrame:
    recover(spark, path)
    return spark.read.parquet(path).drop("bucket")


def reviews_batch_writer(path: str, buckets: int = BUCKETS):
    """T2 write side without a log: each micro-batch is applied to the table.
    One stream a table (its batch ids tell batches apart)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        apply_reviews(batch.sparkSession, path, batch, batch_id, buckets)
    return write


def compact(spark: SparkSession, log_path: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Fold the log of T2 into a table of its own, so that readers need not
    merge the history of every review again; the log stays the source."""
    folded = merged_reviews(spark, log_path).withColumn("bucket", _bucket(buckets))
    folded.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).drop("bucket")


def numbered(rows: DataFrame, keys: list[str], base: int, id_col: str = "id") -> DataFrame:
    """``rows`` with ids base + 1, base + 2, … in the order of ``keys`` (a
    total order): dealt by range, numbered inside each partition."""
    rows = stored(rows, "unnumbered")           # read twice: the ranges are drawn from it first
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "numbered")
    mark = F.monotonically_increasing_id()      # partition number and row number, in the order the rows lie in
    (rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", mark).write.parquet(path))
    at = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    size = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))          # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = size.select("_part", before.alias("_before"))
    here = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = at.join(F.broadcast(offset), "_part").withColumn(id_col, F.lit(base) + F.col("_before") + here + 1)
    return out.select(id_col, *rows.columns)


def append_comments(spark: SparkSession, path: str, parsed: DataFrame, batch_id: int, stream: str = "reviews",
                    review_id: str = "review_id", created_at: Column | None = None) -> None:
    """K3: store the comments of a batch of parsed answers. A comment that an
    earlier batch stored, known by (review, position), is not stored again."""
    rows = review_comment_rows(parsed, review_id, created_at)
    before = stored_batches(spark, path, but=(stream, batch_id))
    base = 0
    if before is not None:
        rows = rows.join(before.select("review_id", "pos"), ["review_id", "pos"], "left_anti")
        base = before.agg(F.max("id")).first()[0] or 0
    write_batch(numbered(rows, ["review_id", "pos"], base), batch_id, stream, path)


def stored_comments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("stream_id", "batch_id")
