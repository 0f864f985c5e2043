"""Registered text-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import views as V
from . import sqlfrag as S
from .registry import register


def _scored(spark, d):
    return Q.score_examples(V.raw_examples(spark, d))


@register("ack_flag", f"SELECT comment_id, {S.rx('body', S.ACK)} AS ack FROM pr_comments")
def q_ack_flag(spark, d):
    return V.pr_comments(spark, d).select("comment_id", Q.ack_flag("body").alias("ack"))


@register("actionable_flag", f"SELECT example_id, {S.rx('review_comment', S.ACTIONABLE)} AS actionable FROM raw_examples")
def q_actionable(spark, d):
    return V.raw_examples(spark, d).select("example_id", Q.actionable_flag("review_comment").alias("actionable"))


@register("specific_pattern_count", "SELECT example_id, CAST(" + " + ".join(
    f"CAST({S.rx('review_comment', p)} AS INT)" for p in S.SPECIFIC) + " AS INT) AS specific FROM raw_examples")
def q_specific(spark, d):
    return V.raw_examples(spark, d).select(
        "example_id", Q.specific_pattern_count("review_comment").cast("int").alias("specific"))


@register("high_value_flag", f"SELECT example_id, {S.rx('review_comment', S.HIGH)} AS high_value FROM raw_examples")
def q_high(spark, d):
    return V.raw_examples(spark, d).select("example_id", Q.high_value_flag("review_comment").alias("high_value"))


@register("low_value_flag", "SELECT example_id, (" + " OR ".join(S.rx("review_comment", p) for p in S.LOW)
          + ") AS low_value FROM raw_examples")
def q_low(spark, d):
    return V.raw_examples(spark, d).select("example_id", Q.low_value_flag("review_comment").alias("low_value"))


@register("length_points", f"""
WITH f AS (SELECT example_id, {S.flags_select()} FROM raw_examples)
SELECT example_id, CAST(_len AS INT) AS trimmed_length, {S.length_points()} AS points FROM f""")
def q_length_points(spark, d):
    from ..functions.text import js_trim
    n = F.length(js_trim("review_comment"))
    return V.raw_examples(spark, d).select(
        "example_id", n.cast("int").alias("trimmed_length"), Q.length_points(n).alias("points"))


@register("quality_score", f"WITH {S.scored_cte()} SELECT example_id, round(quality_score, 6) AS quality_score FROM scored")
def q_quality_score(spark, d):
    return _scored(spark, d).select("example_id", F.round("quality_score", 6).alias("quality_score"))


@register("quality_reasons", f"WITH {S.scored_cte()} SELECT example_id, quality_reasons FROM scored")
def q_quality_reasons(spark, d):
    return _scored(spark, d).select("example_id", F.array_join("quality_reasons", ",").alias("quality_reasons"))


@register("infer_category", f"SELECT example_id, {S.category_expr()} AS category FROM raw_examples")
def q_infer_category(spark, d):
    return V.raw_examples(spark, d).select("example_id", Q.infer_category("review_comment").alias("category"))


@register("threshold_filter", f"""WITH {S.scored_cte()}
SELECT example_id, round(quality_score, 6) AS quality_score, category FROM scored WHERE quality_score >= CAST(0.65 AS DOUBLE)""")
def q_threshold(spark, d):
    return Q.threshold_filter(_scored(spark, d), 0.65).select(
        "example_id", F.round("quality_score", 6).alias("quality_score"), "category")


_BUCKET_SQL = ("CASE WHEN quality_score < 0.3 THEN 0 WHEN quality_score < 0.5 THEN 1 WHEN quality_score < 0.65 THEN 2 "
               "WHEN quality_score < 0.8 THEN 3 ELSE 4 END")


@register("score_histogram", f"""WITH {S.scored_cte()},
b AS (SELECT * FROM (VALUES (0, '0.0-0.3'), (1, '0.3-0.5'), (2, '0.5-0.65'), (3, '0.65-0.8'), (4, '0.8-1.0')) t(bucket_pos, bucket))
SELECT b.bucket_pos, b.bucket, count(s.example_id) AS n FROM b LEFT JOIN (SELECT example_id, {_BUCKET_SQL} AS pos FROM scored) s
 ON s.pos = b.bucket_pos GROUP BY b.bucket_pos, b.bucket""")
def q_score_histogram(spark, d):
    return Q.score_histogram(_scored(spark, d))


@register("category_counts", f"""WITH {S.scored_cte()}
SELECT category, count(*) AS n FROM scored WHERE quality_score >= CAST(0.65 AS DOUBLE) GROUP BY category ORDER BY n DESC, category""")
def q_category_counts(spark, d):
    return Q.category_counts(Q.threshold_filter(_scored(spark, d), 0.65))


@register("filter_report", f"""WITH {S.scored_cte()}
SELECT count(*) AS total, count(*) FILTER (WHERE quality_score >= CAST(0.65 AS DOUBLE)) AS kept,
 round(count(*) FILTER (WHERE quality_score >= CAST(0.65 AS DOUBLE)) * 100.0 / count(*), 1) AS kept_pct FROM scored""")
def q_filter_report(spark, d):
    return Q.filter_report(_scored(spark, d), 0.65)
