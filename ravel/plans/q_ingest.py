"""Registered scan / normalisation / file-record queries (S1–S4, S7, P1–P3,
U1, U2, X15, X33, X34). Scans read data that Spark first derives from the
driver's tables and writes under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest as I
from ..session import scratch_path
from ..sources import views as V
from .registry import register

RAW_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType()), T.StructField("repo", T.StringType()),
    T.StructField("pr_number", T.IntegerType()), T.StructField("file_path", T.StringType()),
    T.StructField("review_comment", T.StringType()), T.StructField("patch", T.StringType()),
    T.StructField("author_ack", T.BooleanType()), T.StructField("reactions", T.IntegerType()),
    T.StructField("association", T.StringType()), T.StructField("comment_line", T.IntegerType())])


def _write_lines(spark, d, with_bad: bool) -> str:
    """raw examples as JSON lines; with_bad adds a malformed line (single
    quotes, as JSON.parse rejects) for every 13th example and blank lines."""
    ex = V.raw_examples(spark, d)
    good = F.to_json(F.struct(*[F.col(c) for c in ex.columns]))
    line = good
    if with_bad:
        bad = F.concat(F.lit("{'example_id': "), F.col("example_id").cast("string"), F.lit("}"))
        line = F.when(F.col("example_id") % 13 == 0, bad).otherwise(F.concat(good, F.lit("\n")))
    out = scratch_path(spark, "jsonl")
    ex.select(line.alias("value")).write.text(out)
    return out


@register("scan_jsonl_lenient", "SELECT example_id, repo, reactions FROM raw_examples WHERE example_id % 13 <> 0")
def q_scan_lenient(spark, d):
    rows, _report = I.scan_jsonl_lenient(spark, _write_lines(spark, d, True), RAW_SCHEMA)
    return rows.select("example_id", "repo", "reactions")


@register("scan_jsonl_report", "SELECT count(*) AS total, count(*) FILTER (WHERE example_id % 13 = 0) AS bad FROM raw_examples")
def q_scan_report(spark, d):
    _rows, report = I.scan_jsonl_lenient(spark, _write_lines(spark, d, True), RAW_SCHEMA)
    return report


@register("scan_jsonl_strict", "SELECT example_id, repo, author_ack FROM raw_examples")
def q_scan_strict(spark, d):
    return I.scan_jsonl_strict(spark, _write_lines(spark, d, False), RAW_SCHEMA).select("example_id", "repo", "author_ack")


_DUMP = {"pulls": "coalesce(pr_title, '') || '/' || coalesce(pr_body, '')", "pr_files": "path || '/' || coalesce(patch, '')",
         "pr_comments": "path || '/' || body"}


@register("scan_pr_dump", " UNION ALL ".join(
    f"SELECT '{k}' AS name, repo, pr_number, count(*) AS n, CAST(sum(length({t})) AS BIGINT) AS chars, min(md5({t})) AS least FROM {k} GROUP BY repo, pr_number"
    for k, t in _DUMP.items()))
def q_scan_dump(spark, d):
    folder = scratch_path(spark, "dump")
    for name, fn in (("pulls", V.pulls), ("pr_files", V.pr_files), ("pr_comments", V.pr_comments)):
        fn(spark, d).write.parquet(f"{folder}/{name}")
    dump = I.scan_pr_dump(spark, folder)
    out = None
    for name, df in dump.items():
        text = F.expr(_DUMP[name])
        part = df.groupBy("repo", "pr_number").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"), F.min(F.md5(text)).alias("least")).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register("scan_reviews", "SELECT id, repo_full_name, overall_score FROM reviews")
def q_scan_reviews(spark, d):
    path = scratch_path(spark, "reviews")
    V.reviews(spark, d).write.partitionBy("provider").parquet(path)
    return I.scan_reviews(spark, path).select("id", "repo_full_name", "overall_score")


@register("scan_model_responses", "SELECT example_id, model, expected_category, raw_text, error FROM responses")
def q_scan_responses(spark, d):
    path = scratch_path(spark, "responses")
    V.responses(spark, d).write.partitionBy("model").parquet(path)
    return I.scan_model_responses(spark, path)


_GH = """SELECT 'github' AS provider, repo_full_name, pr_number, pr_title, coalesce(nullif(body, ''), '') AS pr_body, head_sha, base_sha,
 author_login, installation_id, CAST(NULL AS BIGINT) AS project_id, event_id, ts
FROM pr_events WHERE event_name = 'pull_request' AND action IN ('opened', 'synchronize')"""
_GL = """SELECT 'gitlab' AS provider, repo_full_name, pr_number, pr_title, coalesce(nullif(body, ''), '') AS pr_body, head_sha,
 coalesce(base_sha, '') AS base_sha, author_login, CAST(NULL AS BIGINT) AS installation_id, project_id, event_id, ts
FROM pr_events WHERE event_name = 'Merge Request Hook' AND action IN ('open', 'update', 'reopen')"""


def job_columns(jobs):
    """All columns of the review jobs; times without a zone, as the tables have them."""
    return jobs.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "ts" else c for c in I.JOB_COLUMNS])


@register("normalize_github_events", _GH)
def q_norm_gh(spark, d):
    return job_columns(I.normalize_github_events(V.pr_events(spark, d)))


@register("normalize_gitlab_events", _GL)
def q_norm_gl(spark, d):
    return job_columns(I.normalize_gitlab_events(V.pr_events(spark, d)))


@register("normalize_by_provider", f"{_GH} UNION ALL {_GL}")
def q_norm_any(spark, d):
    jobs, _quarantine = I.normalize_by_provider(V.pr_events(spark, d))
    return job_columns(jobs)


@register("unknown_provider_quarantine", """SELECT event_id, 'Unknown VCS provider: ' || coalesce(provider, 'undefined') AS reason
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'bitbucket' WHEN event_type = 'signup' THEN NULL ELSE provider END AS provider
 FROM pr_events JOIN events USING (event_id)) WHERE provider IS NULL OR provider NOT IN ('github', 'gitlab')""")
def q_quarantine(spark, d):
    # the provider field of error/signup events is replaced by an unknown / missing one
    ev = V.pr_events(spark, d).join(V.table(spark, d, "events").select("event_id", "event_type"), "event_id")
    ev = ev.withColumn("provider", F.when(F.col("event_type") == "error", F.lit("bitbucket"))
                       .when(F.col("event_type") == "signup", F.lit(None).cast("string")).otherwise(F.col("provider")))
    _jobs, quarantine = I.normalize_by_provider(ev)
    return quarantine.select("event_id", "reason")


@register("union_providers", f"SELECT provider, count(*) AS n FROM ({_GH} UNION ALL {_GL}) GROUP BY provider")
def q_union_providers(spark, d):
    e = V.pr_events(spark, d)
    return I.union_sources(I.normalize_github_events(e), I.normalize_gitlab_events(e)).groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"))


@register("union_repos", """SELECT 'threads' AS source, repo, count(*) AS n FROM pr_comments GROUP BY repo
UNION ALL SELECT 'documents', repo, count(*) FROM raw_examples GROUP BY repo""")
def q_union_repos(spark, d):
    a = V.pr_comments(spark, d).select("repo").withColumn("source", F.lit("threads"))
    b = V.raw_examples(spark, d).select("repo").withColumn("source", F.lit("documents"))
    return I.union_sources(a, b).groupBy("source", "repo").agg(F.count(F.lit(1)).alias("n"))


@register("language_bytes", """SELECT repo, lang, pos, CAST(floor(bytes * 100.0 / sum(bytes) OVER (PARTITION BY repo) / 100.0 * 1000000 + 0.5) AS BIGINT) AS bytes_est
FROM repo_languages""")
def q_language_bytes(spark, d):
    return I.language_bytes(V.repo_languages(spark, d))


@register("diff_stats", r"""SELECT repo, pr_number, path, len(regexp_extract_all(patch, '(?m)^\+')) AS additions,
 len(regexp_extract_all(patch, '(?m)^-')) AS deletions, len(string_split(patch, chr(10))) AS changes FROM pr_files WHERE patch IS NOT NULL""")
def q_diff_stats(spark, d):
    f = V.pr_files(spark, d).where(F.col("patch").isNotNull())
    a, dl, ch = I.diff_stats("patch")
    return f.select("repo", "pr_number", "path", a.cast("long").alias("additions"), dl.cast("long").alias("deletions"),
                    ch.cast("long").alias("changes"))


@register("file_normalize", """SELECT pr_id, filename, additions, deletions, changes, nullif(patch, '') AS patch FROM changed_files""")
def q_file_normalize(spark, d):
    return I.file_normalize(V.changed_files(spark, d), "github", keep=("pr_id",))


@register("file_normalize_gitlab", r"""SELECT repo, pr_number, path AS filename, len(regexp_extract_all(patch, '(?m)^\+')) AS additions,
 len(regexp_extract_all(patch, '(?m)^-')) AS deletions, len(string_split(patch, chr(10))) AS changes, nullif(patch, '') AS patch
FROM pr_files WHERE patch IS NOT NULL""")
def q_file_normalize_gitlab(spark, d):
    f = (V.pr_files(spark, d).where(F.col("patch").isNotNull())
         .select("repo", "pr_number", F.col("path").alias("new_path"), F.col("patch").alias("diff")))
    g = I.file_normalize(f, "gitlab", keep=("repo", "pr_number"))
    return g.select("repo", "pr_number", "filename", *[F.col(c).cast("long").alias(c) for c in
                                                      ("additions", "deletions", "changes")], "patch")
