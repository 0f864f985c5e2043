"""Registered alert and outbox queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import reports as R
from ..operators import reviews as RV
from ..sources import views as V
from . import q_reviews as QR
from .registry import register


DASHBOARD = "https://dashboard.example"


def _decided(spark, d):
    r = V.reviews(spark, d)
    cc = R.comment_counts(V.review_comments(spark, d))
    j = r.join(cc, r.id == cc.review_id, "left").drop("review_id")
    j = j.withColumn("n_comments", F.coalesce("n_comments", F.lit(0))).withColumn(
        "n_critical", F.coalesce("n_critical", F.lit(0)))
    return j.withColumn("event", RV.review_decision(F.col("n_critical") > 0, F.col("overall_score"), F.col("n_comments")))


_TOP3 = """t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY id) AS rn FROM review_comments
 WHERE severity = 'critical') WHERE rn <= 3)"""


def _url(t: str) -> str:
    return f"'https://github.com/' || {t}.repo_full_name || '/pull/' || CAST({t}.pr_number AS VARCHAR)"


def _link(t: str) -> str:
    return f"'*<' || {_url(t)} || '|' || {t}.repo_full_name || '#' || CAST({t}.pr_number AS VARCHAR) || ': ' || {t}.pr_title || '>*'"


def _detail(name: str, value: str) -> str:
    return f"'*{name}*' || chr(10) || {value}"


@register("top3_critical_per_review", f"WITH {_TOP3} SELECT review_id, id, rn FROM t3")
def q_top3(spark, d):
    return A.top3_critical_per_review(V.review_comments(spark, d)).select("review_id", "id", F.col("rn").cast("long").alias("rn"))


@register("alert_critical", f"""WITH {_TOP3},
cnt AS (SELECT review_id, count(*) AS critical_count FROM review_comments WHERE severity = 'critical' GROUP BY review_id),
lst AS (SELECT review_id, string_agg('• *' || title || '* in `' || file_path || '`' || CASE WHEN line_number IS NOT NULL AND line_number <> 0
  THEN ':' || CAST(line_number AS VARCHAR) ELSE '' END || chr(10) || '  ' || substr(suggestion, 1, 120)
  || CASE WHEN length(suggestion) > 120 THEN '…' ELSE '' END, chr(10) || chr(10) ORDER BY rn) AS issue_list FROM t3 GROUP BY review_id)
SELECT r.id AS review_id, r.repo_full_name, r.pr_number, r.overall_score, cnt.critical_count, lst.issue_list, {_url('r')} AS url,
 '🔴 *Critical issues found in PR*' || chr(10) || {_link('r')} AS headline,
 {_detail('Author', 'r.author_login')} || chr(10) || {_detail('Quality Score', "r.overall_score || '/100'")} || chr(10)
 || {_detail('Critical Issues', 'cnt.critical_count')} || chr(10) || {_detail('Action', "'Changes requested'")} AS details
FROM reviews r JOIN cnt ON cnt.review_id = r.id JOIN lst ON lst.review_id = r.id""")
def q_alert_critical(spark, d):
    return A.alert_critical(V.reviews(spark, d), V.review_comments(spark, d)).select(
        "review_id", "repo_full_name", "pr_number", "overall_score", "critical_count", "issue_list", "url", "headline", "details")


_COUNTS = """rc AS (SELECT review_id, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS crit FROM review_comments GROUP BY review_id),
dec AS (SELECT r.*, coalesce(rc.n, 0) AS n_comments, CASE WHEN coalesce(rc.crit, 0) > 0 THEN 'REQUEST_CHANGES'
  WHEN r.overall_score >= 85 AND coalesce(rc.n, 0) <= 2 THEN 'APPROVE' ELSE 'COMMENT' END AS event
 FROM reviews r LEFT JOIN rc ON rc.review_id = r.id)"""


_APPROVAL = f"""'✅ *PR auto-approved by Code Review Bot*' || chr(10) || {_link('dec')} AS headline,
 {_detail('Author', 'author_login')} || chr(10) || {_detail('Quality Score', "overall_score || '/100 🏆'")} AS details"""


@register("alert_approval", f"""WITH {_COUNTS} SELECT id AS review_id, repo_full_name, pr_number, overall_score, {_url('dec')} AS url, {_APPROVAL}
FROM dec WHERE event = 'APPROVE'""")
def q_alert_approval(spark, d):
    return A.alert_approval(_decided(spark, d)).select("review_id", "repo_full_name", "pr_number", "overall_score", "url", "headline", "details")


def _drop_sql(unit: str) -> str:
    return f"""WITH p AS (SELECT repo_full_name, CAST(date_trunc('{unit}', created_at) AS DATE) AS period,
 CAST(round(avg(overall_score)) AS BIGINT) AS cur FROM reviews GROUP BY 1, 2),
l AS (SELECT *, lag(cur) OVER (PARTITION BY repo_full_name ORDER BY period) AS prev FROM p)
SELECT repo_full_name, period, cur AS current_score, prev AS previous_score, cur - prev AS change,
 '⚠️ *Quality score drop detected*' || chr(10) || '*' || repo_full_name || '* quality score has fallen below the threshold.' AS headline,
 {_detail('Current Score', "cur || '/100'")} || chr(10) || {_detail('Previous Score', "prev || '/100'")} || chr(10)
 || {_detail('Threshold', "'70/100'")} || chr(10) || {_detail('Change', "(cur - prev) || ' pts'")} AS details FROM l WHERE cur < 70 AND cur < prev"""


def _drop(spark, d, unit):
    return A.score_drop(V.reviews(spark, d), unit).select(
        "repo_full_name", F.to_date("period").alias("period"), "current_score", "previous_score", "change", "headline", "details")


@register("score_drop", _drop_sql("month"))
def q_score_drop(spark, d):
    return _drop(spark, d, "month")


@register("alert_score_drop", _drop_sql("week"))
def q_alert_score_drop(spark, d):
    return _drop(spark, d, "week")


@register("inline_predicate", "SELECT id FROM review_comments WHERE line_number IS NOT NULL AND line_number <> 0 AND file_path IS NOT NULL AND file_path <> ''")
def q_inline_predicate(spark, d):
    return V.review_comments(spark, d).where(A.inline_predicate()).select("id")


@register("commit_status_records", f"""WITH {_COUNTS}
SELECT id AS review_id, head_sha, CASE WHEN event = 'REQUEST_CHANGES' THEN 'failed' ELSE 'success' END AS state, 'Code Review Bot' AS name,
 'Score: ' || CAST(overall_score AS VARCHAR) || '/100 · ' || CAST(n_comments AS VARCHAR) || ' issues' AS description,
 'https://dashboard.example/pr/' || CAST(pr_number AS VARCHAR) AS target_url FROM dec
UNION ALL SELECT id, head_sha, 'running', 'Code Review Bot', 'AI review in progress...', 'https://dashboard.example/pr/' || CAST(pr_number AS VARCHAR) FROM reviews""")
def q_commit_status(spark, d):
    return A.commit_status_records(_decided(spark, d), DASHBOARD).unionByName(
        A.pending_status_records(V.reviews(spark, d), DASHBOARD))


@register("inline_comment_records", f"""SELECT rc.review_id, rc.id AS comment_id, r.head_sha, rc.file_path AS new_path, rc.line_number AS new_line,
 '**' || rc.file_path || ':' || CAST(rc.line_number AS VARCHAR) || '**' || chr(10) || chr(10) || {QR._ICON.replace('severity', 'rc.severity')} || ' **[' || rc.category || '] '
 || rc.title || '**' || chr(10) || chr(10) || rc.suggestion || chr(10) || chr(10) || '<sub>Code Review Bot</sub>' AS fallback_body
FROM review_comments rc JOIN reviews r ON r.id = rc.review_id WHERE rc.line_number IS NOT NULL AND rc.line_number <> 0 AND rc.file_path <> ''""")
def q_inline_records(spark, d):
    k = A.inline_comment_records(V.review_comments(spark, d), V.reviews(spark, d))
    return k.select("review_id", "comment_id", F.col("position.head_sha").alias("head_sha"),
                    F.col("position.new_path").alias("new_path"), F.col("position.new_line").alias("new_line"), "fallback_body")


@register("review_summary_records", QR.ORACLE_FORMAT_SUMMARY.replace(
    "SELECT example_id, event, '## Code Review Bot", "SELECT example_id AS review_id, 'summary' AS kind, '## Code Review Bot").replace(
    "AS summary_md FROM e", "AS body FROM e"))
def q_summary_records(spark, d):
    s = QR.q_format_summary(spark, d).withColumnRenamed("example_id", "id")
    return A.review_summary_records(s)
