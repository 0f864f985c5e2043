"""Scans, event normalisation and file records (S1–S4, S7, P1–P3, U1, U2,
X15, X33, X34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_, falsy_to, is_strict_json, js_trim

# ------------------------------------------------------------------ scans

def scan_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines; blank lines skipped, lines that ``JSON.parse`` would
    reject (or that are not objects) counted and dropped.

    Returns (rows, report) where report has total (non-blank) and bad line
    counts. Strictness follows D7, so single quotes, trailing text or NaN
    count as bad lines."""
    lines = spark.read.text(path).where(js_trim("value") != "")
    ok = is_strict_json("value") & F.try_parse_json("value").isNotNull() & \
        F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")
    flagged = lines.withColumn("_ok", ok)
    rows = flagged.where("_ok").select(F.from_json("value", schema).alias("r")).select("r.*")
    report = flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("_ok")).alias("bad"))
    return rows, report


def scan_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; any malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_pr_dump(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """S3: the three collections of a PR dump (pulls, pr_files, pr_comments)."""
    return {name: spark.read.format(fmt).load(f"{folder}/{name}") for name in ("pulls", "pr_files", "pr_comments")}


REVIEWS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("repo_full_name", T.StringType(), False),
    T.StructField("pr_number", T.IntegerType(), False), T.StructField("pr_title", T.StringType()),
    T.StructField("author_login", T.StringType()), T.StructField("head_sha", T.StringType(), False),
    T.StructField("overall_score", T.LongType(), False), T.StructField("review_event", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("provider", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False)])


def scan_reviews(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """Stored reviews from Parquet, or from a database with a partitioned
    JDBC read (``jdbc`` = options incl. partitionColumn/lowerBound/...)."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.parquet(path)


RESPONSES_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType(), False), T.StructField("model", T.StringType()),
    T.StructField("expected_category", T.StringType()), T.StructField("raw_text", T.StringType()),
    T.StructField("error", T.StringType())])


def scan_model_responses(spark: SparkSession, path: str) -> DataFrame:
    """The answers of the models that are compared, one folder per model
    (``model=<name>``); a filter on the model reads its folder only."""
    return spark.read.schema(RESPONSES_SCHEMA).parquet(path).select(*RESPONSES_SCHEMA.names)


# --------------------------------------------------------- normalisation

GITHUB_ACTIONS = ["opened", "synchronize"]
GITLAB_ACTIONS = ["open", "update", "reopen"]
JOB_COLUMNS = ["provider", "repo_full_name", "pr_number", "pr_title", "pr_body", "head_sha", "base_sha",
               "author_login", "installation_id", "project_id", "event_id", "ts"]


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def normalize_github_events(events: DataFrame) -> DataFrame:
    """``pull_request`` events with action opened/synchronize → review
    jobs; body defaults to ''."""
    e = events.where((F.col("event_name") == "pull_request") & F.col("action").isin(*GITHUB_ACTIONS))
    return e.select(
        F.lit("github").alias("provider"), "repo_full_name", "pr_number",
        _opt(e, "pr_title").alias("pr_title"), falsy_to(_opt(e, "body"), F.lit("")).alias("pr_body"),
        _opt(e, "head_sha").alias("head_sha"), _opt(e, "base_sha").alias("base_sha"), "author_login",
        _opt(e, "installation_id", "bigint").alias("installation_id"), F.lit(None).cast("bigint").alias("project_id"),
        _opt(e, "event_id", "bigint").alias("event_id"), _opt(e, "ts", "timestamp_ntz").alias("ts"))


def normalize_gitlab_events(events: DataFrame) -> DataFrame:
    """``Merge Request Hook`` events with action open/update/reopen →
    review jobs; description and base sha default to ''."""
    e = events.where((F.col("event_name") == "Merge Request Hook") & F.col("action").isin(*GITLAB_ACTIONS))
    return e.select(
        F.lit("gitlab").alias("provider"), "repo_full_name", "pr_number",
        _opt(e, "pr_title").alias("pr_title"), falsy_to(_opt(e, "body"), F.lit("")).alias("pr_body"),
        _opt(e, "head_sha").alias("head_sha"), falsy_to(_opt(e, "base_sha"), F.lit("")).alias("base_sha"),
        "author_login", F.lit(None).cast("bigint").alias("installation_id"),
        _opt(e, "project_id", "bigint").alias("project_id"),
        _opt(e, "event_id", "bigint").alias("event_id"), _opt(e, "ts", "timestamp_ntz").alias("ts"))


# Provider registry (the reference's provider interface, as DataFrame → DataFrame).
NORMALIZERS = {"github": normalize_github_events, "gitlab": normalize_gitlab_events}


def normalize_by_provider(events: DataFrame, registry: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """P3 + U1: route each event to its provider's normaliser and union the
    jobs; events of an unknown or missing provider go to quarantine."""
    reg = registry or NORMALIZERS
    jobs = None
    for name, fn in reg.items():
        part = fn(events.where(F.col("provider") == name))
        jobs = part if jobs is None else jobs.unionByName(part, allowMissingColumns=True)
    known = F.col("provider").isin(*reg.keys())
    quarantine = events.where(~F.coalesce(known, F.lit(False))).withColumn(
        "reason", F.concat(F.lit("Unknown VCS provider: "), F.coalesce(F.col("provider"), F.lit("undefined"))))
    return jobs, quarantine


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Append tables of several providers or repos by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ files

def diff_stats(diff) -> tuple[Column, Column, Column]:
    """Additions ('+' at a line start), deletions ('-' at a line start)
    and number of lines of a unified diff."""
    d = col_(diff)
    return (F.regexp_count(d, F.lit(r"(?m)^\+")), F.regexp_count(d, F.lit(r"(?m)^-")), F.size(F.split(d, "\n")))


def file_normalize(files: DataFrame, provider: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Provider file record → (filename, additions, deletions, changes,
    patch); a missing/empty patch becomes null. GitLab counts come from the
    diff text (Q15). ``keep`` columns (e.g. the PR key) pass through."""
    k = [F.col(c) for c in keep]
    if provider == "gitlab":
        a, dl, ch = diff_stats("diff")
        return files.select(*k, F.col("new_path").alias("filename"), a.alias("additions"), dl.alias("deletions"),
                            ch.alias("changes"), F.nullif(F.col("diff"), F.lit("")).alias("patch"))
    return files.select(*k, "filename", "additions", "deletions", "changes",
                        F.nullif(F.col("patch"), F.lit("")).alias("patch"))


def language_bytes(langs: DataFrame, total: int = 1_000_000) -> DataFrame:
    """A language percent table → shares of ``total`` bytes, rounded
    half up (``Math.round``). Percent = bytes / repo bytes · 100 here."""
    from pyspark.sql import Window
    w = Window.partitionBy("repo")
    pct = F.col("bytes") * 100.0 / F.sum("bytes").over(w)
    return langs.select("repo", "lang", "pos", F.floor(pct / 100.0 * total + 0.5).cast("long").alias("bytes_est"))
