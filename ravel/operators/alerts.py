"""Alerts and outgoing records.

Outgoing HTTP calls are not made here: each message becomes a row of an
outbox/alert table that a sender can drain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import render
from .common import top_n_per_group
from .reviews import format_comment

# ---------------------------------------------------------------- fixed values
SCORE_DROP_THRESHOLD = 70
TOP_CRITICAL = 3
SUGGESTION_CUT = 120
ELLIPSIS = "…"
STATUS_NAME = "Code Review Bot"
STATUS_TEXT = "Score: {{score}}/100 · {{n}} issues"
STATUS_STATES = {"pending": "running", "REQUEST_CHANGES": "failed"}   # any other decision: success
PENDING_TEXT = "AI review in progress..."
ISSUE_LINE = "• *{{title}}* in `{{path}}`{{line}}\n  {{text}}"
PULL_URL = "https://github.com/{{repo}}/pull/{{number}}"
CRITICAL_HEADLINE = "🔴 *Critical issues found in PR*\n*<{{url}}|{{repo}}#{{number}}: {{title}}>*"
APPROVAL_HEADLINE = "✅ *PR auto-approved by Code Review Bot*\n*<{{url}}|{{repo}}#{{number}}: {{title}}>*"
DROP_HEADLINE = "⚠️ *Quality score drop detected*\n*{{repo}}* quality score has fallen below the threshold."
CRITICAL_DETAILS = "*Author*\n{{author}}\n*Quality Score*\n{{score}}/100\n*Critical Issues*\n{{n}}\n*Action*\nChanges requested"
APPROVAL_DETAILS = "*Author*\n{{author}}\n*Quality Score*\n{{score}}/100 🏆"
DROP_DETAILS = "*Current Score*\n{{cur}}/100\n*Previous Score*\n{{prev}}/100\n*Threshold*\n{{least}}/100\n*Change*\n{{change}} pts"
# ------------------------------------------------------------ end fixed values


def top3_critical_per_review(comments: DataFrame, n: int = TOP_CRITICAL) -> DataFrame:
    """The first ``n`` critical comments of each review, in comment (id)
    order."""
    crit = comments.where(F.col("severity") == "critical")
    return top_n_per_group(crit, ["review_id"], [F.col("id")], n)


def _issue_line() -> Column:
    s = F.col("suggestion")
    line = F.when(F.col("line_number").isNotNull() & (F.col("line_number") != 0),
                  F.concat(F.lit(":"), F.col("line_number").cast("string"))).otherwise(F.lit(""))
    text = F.concat(F.substring(s, 1, SUGGESTION_CUT),
                    F.when(F.length(s) > SUGGESTION_CUT, F.lit(ELLIPSIS)).otherwise(F.lit("")))
    return render(ISSUE_LINE, title=F.col("title"), path=F.col("file_path"), line=line, text=text)


def _pull_message(df: DataFrame, headline: str, details: str, **more: Column) -> DataFrame:
    """Add url, headline and details of a message about a pull request."""
    pull = {"repo": F.col("repo_full_name"), "number": F.col("pr_number")}
    url = render(PULL_URL, **pull)
    return (df.withColumn("url", url).withColumn("headline", render(headline, url=url, title=F.col("pr_title"), **pull))
              .withColumn("details", render(details, author=F.col("author_login"), score=F.col("overall_score"), **more)))


def alert_critical(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """One alert per review with critical comments: their number and the
    first three as a text list (suggestions cut to 120 + '…'), with the
    message's headline, details and link."""
    counts = (comments.where(F.col("severity") == "critical").groupBy("review_id")
              .agg(F.count(F.lit(1)).alias("critical_count")))
    first = top3_critical_per_review(comments).withColumn("_line", _issue_line())
    lists = first.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("rn", "_line"))).alias("_l"))
    lists = lists.select("review_id", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n\n").alias("issue_list"))
    r = reviews.select(F.col("id").alias("review_id"), "repo_full_name", "pr_number", "pr_title", "author_login",
                       "overall_score")
    out = r.join(counts, "review_id").join(lists, "review_id").withColumn("kind", F.lit("critical"))
    return _pull_message(out, CRITICAL_HEADLINE, CRITICAL_DETAILS, n=F.col("critical_count"))


def alert_approval(decided_reviews: DataFrame) -> DataFrame:
    """Approved reviews (``event`` = APPROVE), as messages."""
    out = (decided_reviews.where(F.col("event") == "APPROVE")
           .select(F.col("id").alias("review_id"), "repo_full_name", "pr_number", "pr_title", "author_login",
                   "overall_score", F.lit("approval").alias("kind")))
    return _pull_message(out, APPROVAL_HEADLINE, APPROVAL_DETAILS)


def score_drop(reviews: DataFrame, period: str = "month", threshold: int = SCORE_DROP_THRESHOLD) -> DataFrame:
    """W6 + T8: per repo and period the rounded mean score; alert when it is
    below ``threshold`` and below the previous period's (equal is no drop).
    The window runs over the small per-(repo, period) table only."""
    per = (reviews.groupBy("repo_full_name", F.date_trunc(period, "created_at").alias("period"))
           .agg(F.round(F.avg("overall_score")).cast("long").alias("current_score")))
    w = Window.partitionBy("repo_full_name").orderBy("period")
    per = per.withColumn("previous_score", F.lag("current_score").over(w))
    return (per.where((F.col("current_score") < threshold) & (F.col("current_score") < F.col("previous_score")))
               .withColumn("change", F.col("current_score") - F.col("previous_score"))
               .withColumn("threshold", F.lit(threshold))
               .withColumn("kind", F.lit("score_drop"))
               .withColumn("headline", render(DROP_HEADLINE, repo=F.col("repo_full_name")))
               .withColumn("details", render(DROP_DETAILS, cur=F.col("current_score"), prev=F.col("previous_score"),
                                             least=F.col("threshold"), change=F.col("change"))))


def inline_predicate(line: str = "line_number", path: str = "file_path") -> Column:
    """Comments that can be posted inline: line not 0/null, path not
    empty (D13)."""
    return (F.col(line).isNotNull() & (F.col(line) != 0) & F.col(path).isNotNull() & (F.col(path) != ""))


def commit_status_records(decided: DataFrame, dashboard_url: str = "") -> DataFrame:
    """K4: commit status per finished review: failed for REQUEST_CHANGES, else
    success. ``target_url`` is the review's page under ``dashboard_url``."""
    state = F.coalesce(*[F.when(F.col("event") == e, s) for e, s in STATUS_STATES.items()], F.lit("success"))
    return _statuses(decided.withColumn("state", state).withColumn(
        "description", render(STATUS_TEXT, score=F.col("overall_score"), n=F.col("n_comments"))), dashboard_url)


def pending_status_records(jobs: DataFrame, dashboard_url: str = "") -> DataFrame:
    """K4: the status of a review that has begun."""
    return _statuses(jobs.withColumn("state", F.lit(STATUS_STATES["pending"])).withColumn(
        "description", F.lit(PENDING_TEXT)), dashboard_url)


def _statuses(df: DataFrame, dashboard_url: str) -> DataFrame:
    return df.select(F.col("id").alias("review_id"), "head_sha", "state", F.lit(STATUS_NAME).alias("name"), "description",
                     F.concat(F.lit(f"{dashboard_url}/pr/"), F.col("pr_number").cast("string")).alias("target_url"))


def inline_comment_records(comments: DataFrame, reviews: DataFrame) -> DataFrame:
    """K5: inline comments (P11) with their diff position, and the note text
    used when the inline post fails."""
    c = comments.where(inline_predicate())
    if "code_example" not in c.columns:
        c = c.withColumn("code_example", F.lit(None).cast("string"))
    if "language" not in c.columns:
        c = c.withColumn("language", F.lit(None).cast("string"))
    c = c.withColumn("body", format_comment())
    r = reviews.select(F.col("id").alias("review_id"), "head_sha",
                       (F.col("base_sha") if "base_sha" in reviews.columns else F.lit(None).cast("string")).alias("base_sha"))
    c = c.join(r, "review_id")
    pos = F.struct(F.lit("text").alias("position_type"), F.col("base_sha").alias("base_sha"),
                   F.col("base_sha").alias("start_sha"), F.col("head_sha").alias("head_sha"),
                   F.col("file_path").alias("new_path"), F.col("line_number").alias("new_line"))
    fallback = F.concat(F.lit("**"), F.col("file_path"), F.lit(":"), F.col("line_number").cast("string"),
                        F.lit("**\n\n"), F.col("body"))
    return c.select("review_id", F.col("id").alias("comment_id"), "body", pos.alias("position"),
                    fallback.alias("fallback_body"), F.lit("inline").alias("kind"))


def review_summary_records(decided: DataFrame, summary_col: str = "summary_md") -> DataFrame:
    """K6: the summary note of each review."""
    return decided.select(F.col("id").alias("review_id"), F.col(summary_col).alias("body"),
                          F.lit("summary").alias("kind"))
