"""T5: the daily quality trend as a stream, in update mode.

A review (repo, PR, sha) counts once: on the day of its first row (the lowest
id) with the score of its last row (the highest id), as the stored table does
(K2). A stateful operator keeps just these two rows per key, the keys dealt by
hash over a fixed number of buckets: a call of Python costs more than a row, so
there is one a bucket and not one a key. When a delivery changes a key's rows it
takes back what the key gave before and gives the new value, so
what leaves it are differences: (day, reviews, scored, score). They depend on
minima and maxima of ids alone, so any order of files gives the same trend.

A micro-batch's differences are added up per day and stored under (stream,
batch id); a batch run again replaces its own rows. The trend is their sum, a
table of days and not of reviews.

A key's state is dropped once the watermark is ``keep`` past its last row. Rows
older than the watermark are not counted by Spark; how many there were is in
the side table of :func:`ravel.streaming.streams.run_available`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.reviews import REVIEW_KEY
from .streams import write_batch

_STATE = ("review array<string>, first_id array<bigint>, first_us array<bigint>, last_id array<bigint>, last_score array<bigint>, "
          "until_ms array<bigint>")
_CHANGE = "day_us bigint, reviews bigint, scored bigint, score bigint"
DAY_US = 86_400_000_000
BUCKETS = 2048      # groups that the keys' states are held in
NONE = -1 << 63     # stands for null in columns that go to Python, where nulls would make them floats


def _changes(keep_ms: int):
    """State function of a bucket of keys. A key's state is (first id, its time,
    last id, its score, the time until which the key is known)."""
    def gives(us, score, sign):
        day = None if us == NONE else us - us % DAY_US
        return (day, sign, 0, 0) if score is None else (day, sign, sign, sign * score)

    def rank(score):
        return -1 if score is None else score

    def fn(bucket, frames, state):
        held = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        now, old = state.getCurrentWatermarkMs(), {}
        for f in () if state.hasTimedOut else frames:   # one bounded piece of the bucket's rows at a time
            for key, id, us, score in zip(*(f[c].tolist() for c in ("review", "id", "us", "score"))):
                score, until = None if score == NONE else score, max(max(us // 1000, 0) + keep_ms, now + 1)
                known = held.get(key)
                if known is None:
                    old[key], held[key] = None, (id, us, id, score, until)
                    continue
                # rows of one id: the earliest day, the highest score; a row without a day says nothing of it
                first = min(known[:2], (id, us), key=lambda x: (x[1] == NONE, x))
                last = (id, score) if (id, rank(score)) > (known[2], rank(known[3])) else known[2:4]
                held[key] = (*first, *last, max(known[4], until) if key in old else until)
                old.setdefault(key, known)
        rows = []
        for key, before in old.items():
            after = held[key]
            if before is None or before[:4] != after[:4]:
                rows += ([gives(before[1], before[3], -1)] if before else []) + [gives(after[1], after[3], 1)]
        held = {k: v for k, v in held.items() if v[4] >= now}
        if held:
            state.update((list(held), *map(list, zip(*held.values()))))
            state.setTimeoutTimestamp(min(v[4] for v in held.values()))
        elif state.exists:
            state.remove()
        if rows:   # added up per day: a bucket's differences are as many as its days
            yield (pd.DataFrame(rows, columns=["day_us", "reviews", "scored", "score"]).astype({"day_us": "Int64"})
                     .groupby("day_us", dropna=False, as_index=False).sum())
    return fn


def trend_changes(reviews: DataFrame, delay: str = "1 day", keep_days: int = 30) -> DataFrame:
    """The stream of differences of a stream of reviews. ``delay``: how late a
    row may come; ``keep_days``: how long after its last row a key is known (a
    redelivery after that would be counted as a new review)."""
    no = F.lit(NONE)
    r = (reviews.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
                .select(F.pmod(F.xxhash64(*REVIEW_KEY), F.lit(BUCKETS)).cast("int").alias("bucket"), F.to_json(F.struct(*REVIEW_KEY)).alias("review"),
                        F.coalesce(F.col("id").cast("bigint"), no).alias("id"), "created_at",
                        F.coalesce(F.unix_micros("created_at"), no).alias("us"),
                        F.coalesce(F.col("overall_score").cast("bigint"), no).alias("score")))
    return r.groupBy("bucket").applyInPandasWithState(
        _changes(int(keep_days) * 86_400_000), _CHANGE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def trend_batch_writer(path: str, stream: str):
    """``foreachBatch`` function that stores a micro-batch's differences, added up per day."""
    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("day_us").agg(*[F.sum(c).alias(c) for c in ("reviews", "scored", "score")])
        write_batch(sums, batch_id, stream, path)
    return write


def live_trend(spark: SparkSession, path: str) -> DataFrame:
    """(day, avg_score, pr_count): the trend as of the batches stored."""
    t = spark.read.parquet(path).groupBy("day_us").agg(*[F.sum(c).alias(c) for c in ("reviews", "scored", "score")])
    return t.where("reviews > 0").select(
        F.timestamp_micros("day_us").alias("day"), F.round(F.try_divide("score", "scored")).cast("long").alias("avg_score"),
        F.col("reviews").alias("pr_count"))
