"""Structured Streaming jobs (T1, T2) and runners; T5 is in :mod:`.trend`,
T6/T7 in :mod:`.outbox`, tables that streams keep in :mod:`.store`.

Sources are file streams with explicit schemas (a Kafka source plugs in the
same way: parse ``value`` with ``from_json`` and the same schema). Each job
has a checkpoint location under the shared checkpoint folder, so a restarted
query resumes where it stopped; sinks are idempotent per micro-batch id.
"""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.ingest import normalize_by_provider
from ..operators.reviews import upsert_reviews

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("provider", T.StringType()), T.StructField("event_name", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("repo_full_name", T.StringType()),
    T.StructField("pr_number", T.IntegerType()), T.StructField("body", T.StringType()),
    T.StructField("author_login", T.StringType()), T.StructField("pr_title", T.StringType()),
    T.StructField("head_sha", T.StringType()), T.StructField("base_sha", T.StringType()),
    T.StructField("installation_id", T.LongType()), T.StructField("project_id", T.LongType())])


def read_event_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Webhook events of both providers as a JSON-lines file stream."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(folder)


def stream_pr_events(events: DataFrame) -> DataFrame:
    """Filter + normalise per provider + union into one job stream. The
    events of unknown providers are :func:`normalize_by_provider`'s second
    output; :func:`routed_batch_writer` stores both."""
    jobs, _quarantine = normalize_by_provider(events)
    return jobs


def exists(spark: SparkSession, path: str) -> bool:
    """Is there something at ``path``, in whichever store it lies?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_batch(batch: DataFrame, batch_id: int, stream: str, path: str) -> None:
    """Store a micro-batch under its stream and batch id with dynamic
    partition overwrite: a batch run again replaces its own rows only."""
    (batch.withColumn("stream_id", F.lit(stream)).withColumn("batch_id", F.lit(batch_id).cast("long"))
          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("stream_id", "batch_id").parquet(path))


def stored_batches(spark: SparkSession, path: str, but: tuple[str, int]) -> DataFrame | None:
    """What :func:`write_batch` has stored, without one batch's rows; None
    before the first rows."""
    if not exists(spark, path):
        return None
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:     # batches without rows leave no file to take a schema from
        return None
    stream, batch_id = but
    return stored.where((F.col("stream_id") != stream) | (F.col("batch_id") != batch_id))


def routed_batch_writer(jobs_path: str, quarantine_path: str, stream: str = "events"):
    """T1 write side: ``foreachBatch`` function that stores the jobs of a
    batch, and in a second folder the events no provider is known for."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        jobs, quarantine = normalize_by_provider(batch)
        write_batch(jobs, batch_id, stream, jobs_path)
        write_batch(quarantine, batch_id, stream, quarantine_path)
        batch.unpersist()
    return write


def merged_reviews(spark: SparkSession, log_path: str) -> DataFrame:
    """T2 read side: the reviews table = K2 over the applied-batch log
    (merge on read); arrival order = (time applied, stream, batch id, id)."""
    log = spark.read.parquet(log_path)
    order = F.struct("applied_at", "stream_id", "batch_id", "id")
    return upsert_reviews(None, log.withColumn("_seq", order), seq="_seq").drop("stream_id", "batch_id", "applied_at", "_seq")


def upsert_batch_writer(log_path: str, stream: str):
    """T2 write side: ``foreachBatch`` function that stores each micro-batch
    under (``stream``, batch id). ``stream`` names the checkpoint the query
    runs on: another stream, or a new checkpoint, has batch ids of its own
    and must not replace this one's rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        import time
        write_batch(batch.withColumn("applied_at", F.lit(time.time_ns())), batch_id, stream, log_path)
    return write


class _Dropped(StreamingQueryListener):
    """Rows that stateful operators of one query left out as too late, by batch id."""

    def __init__(self):
        self.run, self.rows, self.over = None, {}, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if self.run in (None, str(p.runId)):
            n = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            self.rows[p.batchId] = max(n, self.rows.get(p.batchId, 0))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.run in (None, str(event.runId)):
            self.over.set()


def run_available(df: DataFrame, checkpoint: str, path: str | None = None, foreach_batch=None, mode: str = "append",
                  late_path: str | None = None, stream: str = "stream"):
    """Run a streaming query over all currently available input and stop
    (``availableNow``). Rows go to ``foreach_batch``, or are appended to the
    Parquet folder ``path`` by the file sink, which commits each micro-batch
    once. ``late_path``: a side table (stream_id, batch_id, late_rows) of the
    rows that came after the watermark and were not counted."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(foreach_batch) if foreach_batch is not None else w.format("parquet").option("path", path)
    dropped = _Dropped() if late_path else None
    if dropped:
        spark.streams.addListener(dropped)
    try:
        q = w.start()
        if dropped:
            dropped.run = str(q.runId)
        q.awaitTermination()
        if dropped:
            dropped.over.wait(60)
            late = {b: n for b, n in dropped.rows.items() if n}
            for b, n in late.items():
                write_batch(spark.range(1).select(F.lit(n).cast("long").alias("late_rows")), b, stream, late_path)
    finally:
        if dropped:
            spark.streams.removeListener(dropped)
    return q


# Webhook payload layouts (only the fields the jobs use).
GITHUB_PAYLOAD = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("pull_request", T.StructType([
        T.StructField("number", T.IntegerType()), T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("head", T.StructType([T.StructField("sha", T.StringType())])),
        T.StructField("base", T.StructType([T.StructField("sha", T.StringType())])),
        T.StructField("user", T.StructType([T.StructField("login", T.StringType())]))])),
    T.StructField("repository", T.StructType([
        T.StructField("full_name", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("owner", T.StructType([T.StructField("login", T.StringType())]))])),
    T.StructField("installation", T.StructType([T.StructField("id", T.LongType())]))])

GITLAB_PAYLOAD = T.StructType([
    T.StructField("object_attributes", T.StructType([
        T.StructField("iid", T.IntegerType()), T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()), T.StructField("action", T.StringType()),
        T.StructField("last_commit", T.StructType([T.StructField("id", T.StringType())])),
        T.StructField("diff_refs", T.StructType([T.StructField("base_sha", T.StringType())]))])),
    T.StructField("project", T.StructType([
        T.StructField("id", T.LongType()), T.StructField("path_with_namespace", T.StringType())])),
    T.StructField("user", T.StructType([T.StructField("username", T.StringType())]))])


def webhook_schema(payload: T.StructType) -> T.StructType:
    """One delivery: id, receive time, event header, payload."""
    return T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                         T.StructField("event_name", T.StringType()), T.StructField("payload", payload)])


def read_github_webhooks(spark: SparkSession, folder: str) -> DataFrame:
    """First provider's deliveries → flat event columns (null-safe
    nested access; a missing object gives nulls, not an error)."""
    raw = spark.readStream.schema(webhook_schema(GITHUB_PAYLOAD)).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder)
    p = F.col("payload")
    return raw.select(
        "event_id", "ts", F.lit("github").alias("provider"), "event_name", p["action"].alias("action"),
        p["repository"]["full_name"].alias("repo_full_name"), p["pull_request"]["number"].alias("pr_number"),
        p["pull_request"]["title"].alias("pr_title"), p["pull_request"]["body"].alias("body"),
        p["pull_request"]["head"]["sha"].alias("head_sha"), p["pull_request"]["base"]["sha"].alias("base_sha"),
        p["pull_request"]["user"]["login"].alias("author_login"), p["installation"]["id"].alias("installation_id"))


def read_gitlab_webhooks(spark: SparkSession, folder: str) -> DataFrame:
    """Second provider's deliveries → flat event columns."""
    raw = spark.readStream.schema(webhook_schema(GITLAB_PAYLOAD)).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder)
    a, p = F.col("payload")["object_attributes"], F.col("payload")
    return raw.select(
        "event_id", "ts", F.lit("gitlab").alias("provider"), "event_name", a["action"].alias("action"),
        p["project"]["path_with_namespace"].alias("repo_full_name"), a["iid"].alias("pr_number"),
        a["title"].alias("pr_title"), a["description"].alias("body"), a["last_commit"]["id"].alias("head_sha"),
        a["diff_refs"]["base_sha"].alias("base_sha"), p["user"]["username"].alias("author_login"),
        p["project"]["id"].alias("project_id"))
