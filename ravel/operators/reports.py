"""
trend, top issues and their client-side derivations.

Every report takes a fixed ``as_of`` instead of ``NOW()`` (D14). Comments are
aggregated per review *before* they meet the reviews (the reference joins
first and so counts a review's score once per comment; Q1 is reproduced from
the per-review counts, without the fan-out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES, SEVERITIES
from ..functions.render import render
from .common import optional_eq, trailing_window

# dashboard column names of the category counts (fixed values)
CATEGORY_COLUMNS = [("security", "security_issues"), ("architecture", "arch_issues"),
                    ("performance", "perf_issues"), ("style", "style_issues"),
                    ("correctness", "correctness_issues")]


def comment_counts(comments: DataFrame) -> DataFrame:
    """Per review: comment count, per-category counts, critical count (A6 as
    ``count_if``). One partial+final hash aggregate; a hot review is combined
    map-side."""
    aggs = [F.count("id").alias("n_comments")]
    aggs += [F.count_if(F.col("category") == c).alias(name) for c, name in CATEGORY_COLUMNS]
    aggs.append(F.count_if(F.col("severity") == "critical").alias("n_critical"))
    return comments.groupBy("review_id").agg(*aggs)


def metrics_overview(reviews: DataFrame, comments: DataFrame, as_of: str, days: int = 30,
                     repo: str | None = None) -> DataFrame:
    """A1. One row: reviews, issues, category counts, critical count, mean score.

    ``avg_score`` is the reference's mean over the joined rows (a review
    counts once per comment, at least once; Q1); ``avg_score_per_review`` is
    the plain mean. Counts are 0 and means null on empty input."""
    r = optional_eq(trailing_window(reviews, "created_at", as_of, days), "repo_full_name", repo)
    r = r.select("id", "overall_score")
    # only comments of reviews in the window: a semi join first (AQE can
    # broadcast the windowed ids; runtime filters can prune the scan), then
    # the per-review aggregate on the same key
    c = comments.join(r.select(F.col("id").alias("review_id")), "review_id", "left_semi")
    per = comment_counts(c)
    j = r.join(per, r.id == per.review_id, "left")
    w = F.greatest(F.coalesce(F.col("n_comments"), F.lit(0)), F.lit(1))

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    out = j.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        total("n_comments").alias("total_issues"),
        *[total(name).alias(name) for _, name in CATEGORY_COLUMNS],
        F.round(F.try_divide(F.sum(F.col("overall_score") * w), F.sum(w))).cast("long").alias("avg_score"),
        F.round(F.avg("overall_score")).cast("long").alias("avg_score_per_review"),
        total("n_critical").alias("critical_count"),
    )
    return out.withColumn("meets_target", F.col("avg_score") >= 85)  # X35 flag


def distinct_categories(comments: DataFrame) -> DataFrame:
    """A3: per review, ``ARRAY_AGG(DISTINCT category)`` sorted; reviews with
    no comments get null through the outer join (D12)."""
    return comments.groupBy("review_id").agg(
        F.array_sort(F.collect_set("category")).alias("categories"))


def _rollup_for(r: DataFrame, comments: DataFrame) -> DataFrame:
    c = comments.select("review_id", "category", "severity", "id")
    ids = r.select(F.col("id").alias("review_id"))
    c = c.join(ids, "review_id", "left_semi")
    per = c.groupBy("review_id").agg(
        F.count("id").alias("issue_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.array_sort(F.collect_set("category")).alias("categories"))
    out = r.join(per, r.id == per.review_id, "left").drop("review_id")
    return (out.withColumn("issue_count", F.coalesce("issue_count", F.lit(0)).cast("long"))
               .withColumn("critical_count", F.coalesce("critical_count", F.lit(0)).cast("long")))


def pr_rollup(reviews: DataFrame, comments: DataFrame, limit: int = 20, offset: int = 0,
              repo: str | None = None) -> DataFrame:
    """A2 + O1: newest reviews first (tie-break id), one page, with issue and
    critical counts and distinct categories. The page is cut *before* the
    comments are touched, and a semi-join prunes them; how it is joined is left
    to the sizes met at run time."""
    r = optional_eq(reviews, "repo_full_name", repo).select(
        "id", "repo_full_name", "pr_number", "pr_title", "author_login", "overall_score",
        "review_event", "summary", "created_at")
    page = recent_prs_page(r, limit, offset)
    out = _rollup_for(page, comments).withColumn("decision", decision_label("review_event"))
    return with_score_band(out).orderBy(F.col("created_at").desc(), F.col("id"))


def recent_prs_page(reviews: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """O1: ``ORDER BY created_at DESC, id LIMIT l OFFSET o`` (TakeOrderedAndProject)."""
    return reviews.orderBy(F.col("created_at").desc(), F.col("id")).offset(offset).limit(limit)


def quality_trend(reviews: DataFrame, as_of: str, days: int = 30,
                  repo: str | None = None) -> DataFrame:
    """A4 + O5: per UTC day, rounded mean score and PR count, day ascending;
    ``label`` is the chart's ``MMM d``."""
    r = optional_eq(trailing_window(reviews, "created_at", as_of, days), "repo_full_name", repo)
    return (r.groupBy(F.date_trunc("day", "created_at").alias("day"))
             .agg(F.round(F.avg("overall_score")).cast("long").alias("avg_score"),
                  F.count(F.lit(1)).alias("pr_count"))
             .withColumn("label", F.date_format("day", "MMM d"))
             .orderBy("day"))


def top_issues(reviews: DataFrame, comments: DataFrame, as_of: str | None = None,
               days: int | None = 30, repo: str | None = None, k: int = 10) -> DataFrame:
    """A5 + O4: count per (title, category, severity) over comments of reviews
    in the window, top ``k`` by count. Ties are broken by title, category,
    severity (D16). Reviews only filter, so the join is a left semi join; the
    grouping combines map-side before the shuffle."""
    r = reviews
    if as_of is not None and days is not None:
        r = trailing_window(r, "created_at", as_of, days)
    r = optional_eq(r, "repo_full_name", repo).select(F.col("id").alias("review_id"))
    c = comments.select("review_id", "title", "category", "severity").join(r, "review_id", "left_semi")
    counts = c.groupBy("title", "category", "severity").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.orderBy(F.col("occurrences").desc(), "title", "category", "severity").limit(k)


def issue_share_of_max(top: DataFrame) -> DataFrame:
    """Occurrences as percent of the largest (at least 1), not rounded.
    ``top`` is already bounded (k rows), so the max is a window over k rows."""
    from pyspark.sql import Window
    m = F.greatest(F.max("occurrences").over(Window.partitionBy()), F.lit(1))
    return top.withColumn("pct_of_max", F.col("occurrences") * 100.0 / m)


def issue_breakdown(metrics: DataFrame) -> DataFrame:
    """The four dashboard category counts of A1 as rows, with the percent
    of the largest (at least 1), rounded."""
    labels = [("security_issues", "Security"), ("arch_issues", "Architecture"),
              ("perf_issues", "Performance"), ("style_issues", "Style / clarity")]
    m = metrics.withColumn("_max", F.greatest(*[F.col(k) for k, _ in labels], F.lit(1)))
    stack = ("stack(4, " + ", ".join(
        f"'{k}', '{lab}', {k}, CAST(round({k} * 100.0 / _max) AS BIGINT)" for k, lab in labels)
        + ") AS (key, label, count, pct)")
    return m.selectExpr(stack)


def with_score_band(df: DataFrame, score_col: str = "overall_score") -> DataFrame:
    """≥ 85 green, ≥ 65 amber, else red."""
    s = F.col(score_col)
    return df.withColumn("score_band", F.when(s >= 85, "green").when(s >= 65, "amber").otherwise("red"))


def decision_label(event_col: str = "event"):
    """Label of a review decision; unknown → 'Reviewed'."""
    e = F.col(event_col)
    return (F.when(e == "REQUEST_CHANGES", "Changes requested")
             .when(e == "APPROVE", "Approved").otherwise("Reviewed"))


def reviews_left_comments(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """Every review with its comments; reviews without comments kept."""
    c = comments.select(F.col("review_id"), F.col("id").alias("comment_id"), "category", "severity")
    return reviews.join(c, reviews.id == c.review_id, "left").drop("review_id")


def comments_with_review(comments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Comment rows plus four review columns (inner join)."""
    r = reviews.select(F.col("id").alias("_rid"), "pr_title", "repo_full_name", "author_login",
                       "overall_score")
    return comments.join(r, comments.review_id == r._rid).drop("_rid")


def review_lookup(reviews: DataFrame, comments: DataFrame, review_id) -> DataFrame:
    """P12 + J4 + O2: comments of one review with its columns, ordered by
    severity DESC (alphabetical, Q3) then category, then id."""
    c = comments.where(F.col("review_id") == F.lit(review_id))
    return comments_by_severity_text(comments_with_review(c, reviews))


def comments_by_severity_text(df: DataFrame) -> DataFrame:
    """O2: ``ORDER BY severity DESC, category`` (+ id for a total order)."""
    return df.orderBy(F.col("severity").desc(), "category", "id")


def severity_rank(col: str = "severity"):
    """Rank 1..4 of critical, warning, info, suggestion (unknown → 5)."""
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(col)), F.lit(0)),
        F.lit(len(SEVERITIES) + 1)).cast("int")


def comments_by_severity_rank(df: DataFrame) -> DataFrame:
    """O3: critical, warning, info, suggestion order (UI order), then id."""
    return df.withColumn("severity_rank", severity_rank()).orderBy("severity_rank", "id")


def log_level(status: str = "status"):
    """≥ 500 ERROR, ≥ 400 WARN, else INFO."""
    s = F.col(status)
    return F.when(s >= 500, "ERROR").when(s >= 400, "WARN").otherwise("INFO")


def log_lines(request_log: DataFrame) -> DataFrame:
    """The line logged when a request is done, with its duration."""
    line = render("[{{level}}] {{method}} {{url}} {{status}} {{duration}}ms ip={{ip}}", level=log_level(), method=F.col("method"),
                  url=F.col("url"), status=F.col("status"), duration=F.col("duration_ms"), ip=F.col("client_key"))
    return request_log.select("event_id", log_level().alias("level"), "duration_ms", line.alias("line"))


def log_levels(request_log: DataFrame) -> DataFrame:
    """Requests per level, with their mean and longest duration."""
    return request_log.withColumn("level", log_level()).groupBy("level").agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg("duration_ms"), 3).alias("avg_ms"), F.max("duration_ms").alias("max_ms"))

