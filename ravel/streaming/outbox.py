"""T6/T7 as streams: finished reviews in, messages in an outbox out.

A micro-batch of reviews meets the stored comments of just these reviews inside
``foreachBatch``. Its messages go to the outbox under (stream, batch id), but
for those whose (review, kind) another batch has stored already. So a batch run
again stores the same rows once more in the same place, and a review delivered
twice, by one stream or by two, is announced once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators.reports import comment_counts
from ..operators.reviews import review_decision
from .streams import stored_batches, write_batch

COLUMNS = ["review_id", "kind", "repo_full_name", "pr_number", "headline", "details", "issue_list", "url", "created_at"]


def review_messages(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """T6 and T7 messages of some reviews, one row per (review, kind)."""
    mine = comments.join(reviews.select(F.col("id").alias("review_id")), "review_id", "left_semi")
    counts = comment_counts(mine)
    decided = reviews.join(counts, reviews.id == counts.review_id, "left").drop("review_id").withColumn(
        "event", review_decision(F.coalesce("n_critical", F.lit(0)) > 0, F.col("overall_score"), F.coalesce("n_comments", F.lit(0))))
    critical = A.alert_critical(reviews, mine)
    approval = A.alert_approval(decided).withColumn("issue_list", F.lit(None).cast("string"))
    when = reviews.select(F.col("id").alias("review_id"), F.col("created_at").cast("timestamp").alias("created_at"))
    both = critical.select(*[c for c in COLUMNS if c != "created_at"]).unionByName(
        approval.select(*[c for c in COLUMNS if c != "created_at"]))
    return both.join(when, "review_id").select(*COLUMNS)


def outbox_batch_writer(comments: Callable[[SparkSession], DataFrame], path: str, stream: str):
    """``foreachBatch`` function of a stream of reviews. ``comments`` reads the
    stored comments as of now."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a review redelivered inside the batch: its first values, its last score (K2 on one id). A micro-batch may come
        # as one split, so its rows are dealt out before anything is made of them
        when = F.col("created_at").cast("timestamp")
        once = batch.repartition("id").groupBy("id").agg(
            F.min_by(F.struct(*[c for c in batch.columns if c not in ("id", "overall_score")]), F.col("created_at")).alias("r"),
            F.max("overall_score").alias("overall_score"), F.min(when).alias("_lo"), F.max(when).alias("_hi")).persist()
        try:
            messages = review_messages(once.select("id", "r.*", "overall_score"), comments(spark))
            sent = stored_batches(spark, path, but=(stream, batch_id))
            if sent is not None:
                # a message carries its review's date, so only these days of the outbox are read
                days = once.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).first()
                if days.lo is not None:
                    sent = sent.where(F.col("created_at").between(F.lit(days.lo), F.lit(days.hi)))
                messages = messages.join(sent.select("review_id", "kind"), ["review_id", "kind"], "left_anti")
            write_batch(messages, batch_id, stream, path)
        finally:
            once.unpersist()
    return write


def messages(spark: SparkSession, path: str) -> DataFrame:
    """The outbox; a sender drains it by (stream, batch id)."""
    return spark.read.parquet(path).drop("stream_id", "batch_id")
