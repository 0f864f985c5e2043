"""Registered extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import JS_SPACE, sql_js_trim
from ..operators import extras as X
from ..sources import views as V
from .registry import AS_OF, register

_NORM = f"lower({sql_js_trim(f'regexp_replace(review_comment, {chr(39)}{JS_SPACE}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})"


@register("dedupe_comments", f"""SELECT example_id FROM (SELECT example_id, row_number() OVER (PARTITION BY md5({_NORM}) ORDER BY example_id) AS rn
FROM raw_examples) WHERE rn = 1""")
def q_dedupe(spark, d):
    return X.dedupe_comments(V.raw_examples(spark, d)).select("example_id")


@register("min_reactions_filter", "SELECT example_id, reactions FROM raw_examples WHERE reactions >= 1")
def q_min_reactions(spark, d):
    return X.min_reactions_filter(V.raw_examples(spark, d), 1).select("example_id", "reactions")


@register("period_over_period", f"""WITH b AS (SELECT *, created_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS cur,
 created_at > TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS prev
 FROM reviews WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND created_at <= TIMESTAMP '{AS_OF}')
SELECT count(*) FILTER (WHERE cur) AS reviews_current, count(*) FILTER (WHERE prev) AS reviews_previous,
 round(avg(overall_score) FILTER (WHERE cur), 6) AS score_current, round(avg(overall_score) FILTER (WHERE prev), 6) AS score_previous,
 round((count(*) FILTER (WHERE cur) - count(*) FILTER (WHERE prev)) * 100.0 / nullif(count(*) FILTER (WHERE prev), 0), 1) AS reviews_change_pct FROM b""")
def q_pop(spark, d):
    out = X.period_over_period(V.reviews(spark, d), AS_OF, 30)
    return out.withColumn("score_current", F.round("score_current", 6)).withColumn("score_previous", F.round("score_previous", 6))


@register("module_hotspots", f"""SELECT regexp_extract(rc.file_path, '^(.*)/[^/]*$', 1) AS module, rc.category, count(*) AS n
FROM review_comments rc JOIN reviews r ON r.id = rc.review_id WHERE r.created_at > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY
GROUP BY 1, 2 ORDER BY n DESC, module, category LIMIT 10""")
def q_hotspots(spark, d):
    return X.module_hotspots(V.reviews(spark, d), V.review_comments(spark, d), AS_OF, 14)


@register("pattern_change_rate", f"""WITH r AS (SELECT id, created_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS cur FROM reviews
 WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND created_at <= TIMESTAMP '{AS_OF}'),
g AS (SELECT rc.title, rc.category, count(*) FILTER (WHERE r.cur) AS current, count(*) FILTER (WHERE NOT r.cur) AS previous
 FROM review_comments rc JOIN r ON r.id = rc.review_id GROUP BY 1, 2)
SELECT *, round((current - previous) * 100.0 / nullif(previous, 0), 1) AS change_pct FROM g""")
def q_pattern_change(spark, d):
    return X.pattern_change_rate(V.reviews(spark, d), V.review_comments(spark, d), AS_OF, 30)


@register("author_and_size_metrics", """WITH n AS (SELECT review_id, count(*) AS n FROM review_comments GROUP BY review_id),
b AS (SELECT r.*, CASE WHEN coalesce(n.n, 0) <= 2 THEN 'small' WHEN coalesce(n.n, 0) <= 5 THEN 'medium' ELSE 'large' END AS size_bucket
 FROM reviews r LEFT JOIN n ON n.review_id = r.id)
SELECT repo_full_name, author_login, size_bucket, count(*) AS reviews, round(avg(overall_score), 3) AS avg_score
FROM b GROUP BY ROLLUP (repo_full_name, author_login, size_bucket)""")
def q_author_size(spark, d):
    return X.author_and_size_metrics(V.reviews(spark, d), V.review_comments(spark, d))


@register("near_duplicate_clusters", None)
def q_near_dupes(spark, d):
    """E1 near-duplicate part: MinHash/LSH clusters over all raw examples."""
    return X.near_duplicate_clusters(V.raw_examples(spark, d))
