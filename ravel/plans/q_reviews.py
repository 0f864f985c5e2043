"""Registered parser / decision / upsert / constraint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import JS_SPACE, sql_js_trim
from ..operators import reports as R
from ..operators import reviews as RV
from ..operators.common import stored
from ..session import scratch_path
from ..sources import views as V
from ..streaming import store as ST
from .registry import register


def strip_sql(col: str, bare: bool = True) -> str:
    s = f"regexp_replace({col}, '(?i)^```json{JS_SPACE}*', '')"
    if bare:
        s = f"regexp_replace({s}, '(?i)^```{JS_SPACE}*', '')"
    s = f"regexp_replace({s}, '(?i){JS_SPACE}*```$', '')"
    return sql_js_trim(s)


_NUMT = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def _int_sql(x: str, path: str) -> str:
    v = f"TRY_CAST(json_extract_string({x}, '{path}') AS DOUBLE)"
    return f"(json_type({x}, '{path}') IN {_NUMT} AND {v} = floor({v}))"


def _elem_ok(x: str) -> str:
    t = lambda p: f"json_type({x}, '{p}')"
    s = lambda p: f"json_extract_string({x}, '{p}')"
    return (f"(json_type({x}) = 'OBJECT' AND {t('$.filePath')} = 'VARCHAR' "
            f"AND ({t('$.line')} IS NULL OR {t('$.line')} = 'NULL' OR ({_int_sql(x, '$.line')} AND TRY_CAST({s('$.line')} AS DOUBLE) > 0)) "
            f"AND {t('$.category')} = 'VARCHAR' AND {s('$.category')} IN ('security','architecture','performance','style','correctness') "
            f"AND {t('$.severity')} = 'VARCHAR' AND {s('$.severity')} IN ('critical','warning','info','suggestion') "
            f"AND {t('$.title')} = 'VARCHAR' AND length({s('$.title')}) <= 100 AND {t('$.suggestion')} = 'VARCHAR' "
            f"AND ({t('$.codeExample')} IS NULL OR {t('$.codeExample')} = 'VARCHAR') "
            f"AND ({t('$.language')} IS NULL OR {t('$.language')} = 'VARCHAR') "
            f"AND ({t('$.references')} IS NULL OR ({t('$.references')} = 'ARRAY' AND "
            f"list_bool_and(list_transform(json_extract({x}, '$.references[*]'), lambda r: json_type(r) = 'VARCHAR')) IS NOT FALSE)))")


def _lenient_sql(x: str) -> str:
    return (f"(json_type({x}, '$.filePath') = 'VARCHAR' AND json_type({x}, '$.suggestion') = 'VARCHAR' "
            f"AND json_type({x}, '$.title') = 'VARCHAR')")


PARSE_CTE = f"""c0 AS (SELECT example_id, model, expected_category, error, {strip_sql('raw_text')} AS clean FROM responses),
p0 AS (SELECT *, CASE WHEN json_valid(clean) THEN clean END AS j FROM c0),
p1 AS (SELECT *, json_type(j) AS jt, json_type(j, '$.overallScore') AS st, json_type(j, '$.summary') AS smt, json_type(j, '$.comments') AS ct,
 CASE WHEN json_type(j, '$.comments') = 'ARRAY' THEN json_extract(j, '$.comments[*]') END AS arr FROM p0),
p2 AS (SELECT *, j IS NOT NULL AND jt = 'OBJECT' AND {_int_sql('j', '$.overallScore')}
  AND TRY_CAST(json_extract_string(j, '$.overallScore') AS DOUBLE) BETWEEN 0 AND 100 AND smt = 'VARCHAR' AND arr IS NOT NULL
  AND coalesce(list_bool_and(list_transform(arr, lambda x: coalesce({_elem_ok('x')}, false))), true) AS valid,
 j IS NOT NULL AND (jt = 'NULL' OR (jt = 'OBJECT' AND ct IS NOT NULL AND ct <> 'NULL' AND arr IS NULL)
  OR coalesce(list_bool_or(list_transform(arr, lambda x: json_type(x) = 'NULL')), false)) AS quarantine FROM p1),
parsed AS (SELECT example_id, model, expected_category, error, clean,
 CASE WHEN j IS NULL THEN 'unparsable' WHEN valid THEN 'valid' WHEN quarantine THEN 'quarantine' ELSE 'partial' END AS outcome,
 CAST(CASE WHEN j IS NULL THEN 70 WHEN valid THEN TRY_CAST(json_extract_string(j, '$.overallScore') AS DOUBLE)
  WHEN quarantine THEN NULL WHEN jt = 'OBJECT' AND st IS NOT NULL AND st <> 'NULL' THEN TRY_CAST(json_extract_string(j, '$.overallScore') AS DOUBLE)
  ELSE 70 END AS DOUBLE) AS overall_score,
 CASE WHEN j IS NULL THEN 'Code Review Bot encountered an issue parsing the AI response. Manual review recommended.'
  WHEN valid THEN json_extract_string(j, '$.summary') WHEN quarantine THEN NULL
  WHEN jt = 'OBJECT' AND smt IS NOT NULL AND smt <> 'NULL' THEN json_extract_string(j, '$.summary')
  ELSE 'Review completed with validation warnings.' END AS summary,
 CASE WHEN j IS NULL THEN [] WHEN valid THEN arr WHEN quarantine THEN NULL
  ELSE list_filter(coalesce(arr, []), lambda x: {_lenient_sql('x')}) END AS items
 FROM p2)"""


def _parsed(spark, d):
    return RV.parse_review(V.responses(spark, d))


@register("strip_fences", f"SELECT example_id, {strip_sql('raw_text')} AS clean FROM responses")
def q_strip(spark, d):
    return V.responses(spark, d).select("example_id", RV.strip_fences("raw_text").alias("clean"))


@register("parse_review", f"""WITH {PARSE_CTE}
SELECT example_id, outcome, overall_score, summary, CAST(len(items) AS INT) AS n_comments FROM parsed""")
def q_parse_review(spark, d):
    return _parsed(spark, d).select("example_id", "outcome", "overall_score", "summary",
                                    F.size("comments").alias("n_comments")).withColumn(
        "n_comments", F.when(F.col("outcome") == "quarantine", None).otherwise(F.col("n_comments")))


def _elem_codes(x: str) -> str:
    t = lambda p: f"json_type({x}, '{p}')"
    st = lambda p: f"json_extract_string({x}, '{p}')"
    checks = [
        (f"json_type({x}) = 'OBJECT'", "comment.type"),
        (f"{t('$.filePath')} = 'VARCHAR'", "comment.filePath"),
        (f"({t('$.line')} IS NULL OR {t('$.line')} = 'NULL' OR ({_int_sql(x, '$.line')} AND TRY_CAST({st('$.line')} AS DOUBLE) > 0))",
         "comment.line"),
        (f"({t('$.category')} = 'VARCHAR' AND {st('$.category')} IN ('security','architecture','performance','style','correctness'))",
         "comment.category"),
        (f"({t('$.severity')} = 'VARCHAR' AND {st('$.severity')} IN ('critical','warning','info','suggestion'))", "comment.severity"),
        (f"({t('$.title')} = 'VARCHAR' AND length({st('$.title')}) <= 100)", "comment.title"),
        (f"{t('$.suggestion')} = 'VARCHAR'", "comment.suggestion"),
        (f"({t('$.codeExample')} IS NULL OR {t('$.codeExample')} = 'VARCHAR')", "comment.codeExample"),
        (f"({t('$.language')} IS NULL OR {t('$.language')} = 'VARCHAR')", "comment.language"),
        (f"({t('$.references')} IS NULL OR ({t('$.references')} = 'ARRAY' AND coalesce(list_bool_and(list_transform("
         f"json_extract({x}, '$.references[*]'), lambda r: json_type(r) = 'VARCHAR')), true)))", "comment.references"),
    ]
    return "[" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{code}' END" for c, code in checks) + "]"


_VIOL_SQL = f"""WITH {PARSE_CTE},
v AS (SELECT example_id, j, jt, st, smt, arr, outcome FROM p2 JOIN parsed USING (example_id)),
codes AS (SELECT example_id, outcome, CASE WHEN j IS NULL THEN NULL ELSE list_filter(list_concat(
  [CASE WHEN jt <> 'OBJECT' THEN 'review.type' END,
   CASE WHEN jt = 'OBJECT' AND NOT coalesce({_int_sql('j', '$.overallScore')}, false) THEN 'overallScore.type' END,
   CASE WHEN jt = 'OBJECT' AND st IN {_NUMT} AND (TRY_CAST(json_extract_string(j, '$.overallScore') AS DOUBLE) < 0
     OR TRY_CAST(json_extract_string(j, '$.overallScore') AS DOUBLE) > 100) THEN 'overallScore.range' END,
   CASE WHEN jt = 'OBJECT' AND NOT coalesce(smt = 'VARCHAR', false) THEN 'summary.type' END,
   CASE WHEN jt = 'OBJECT' AND arr IS NULL THEN 'comments.type' END],
  flatten(list_transform(coalesce(arr, []), lambda x: {_elem_codes('x')}))), lambda c: c IS NOT NULL) END AS cs FROM v)
SELECT example_id, outcome, array_to_string(list_sort(list_distinct(cs)), ',') AS violations FROM codes"""


@register("validate_review", _VIOL_SQL)
def q_validate(spark, d):
    return _parsed(spark, d).select("example_id", "outcome",
                                    F.array_join(F.array_sort("violations"), ",").alias("violations"))


@register("lenient_comment_filter", f"""WITH {PARSE_CTE}
SELECT example_id, CAST(len(list_filter(coalesce(arr, []), lambda x: {_lenient_sql('x')})) AS INT) AS n_kept
FROM p1 WHERE arr IS NOT NULL""")
def q_lenient(spark, d):
    return RV.lenient_comments(V.responses(spark, d)).select("example_id", F.size("kept").alias("n_kept"))


_COUNTS = """rc AS (SELECT review_id, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS crit FROM review_comments GROUP BY review_id)"""
_DECISION = ("CASE WHEN coalesce(rc.crit, 0) > 0 THEN 'REQUEST_CHANGES' WHEN r.overall_score >= 85 AND coalesce(rc.n, 0) <= 2 "
             "THEN 'APPROVE' ELSE 'COMMENT' END")


def _stored_decisions(spark, d):
    r = V.reviews(spark, d)
    cc = R.comment_counts(V.review_comments(spark, d))
    j = r.join(cc, r.id == cc.review_id, "left")
    return j.withColumn("event", RV.review_decision(F.coalesce(F.col("n_critical"), F.lit(0)) > 0, F.col("overall_score"),
                                                    F.coalesce(F.col("n_comments"), F.lit(0))))


@register("review_decision", f"WITH {_COUNTS} SELECT r.id, {_DECISION} AS event FROM reviews r LEFT JOIN rc ON rc.review_id = r.id")
def q_decision(spark, d):
    return _stored_decisions(spark, d).select("id", "event")


_ICON = ("CASE severity WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟡' WHEN 'info' THEN '🔵' "
         "WHEN 'suggestion' THEN '💡' ELSE '💡' END")


@register("format_comment", f"""SELECT id, {_ICON} || ' **[' || category || '] ' || title || '**' || chr(10) || chr(10) || suggestion
 || chr(10) || chr(10) || '<sub>Code Review Bot</sub>' AS body FROM review_comments""")
def q_format_comment(spark, d):
    c = V.review_comments(spark, d).withColumn("code_example", F.lit(None).cast("string")) \
                                   .withColumn("language", F.lit(None).cast("string"))
    return c.select("id", RV.format_comment().alias("body"))


ORACLE_FORMAT_SUMMARY = f"""WITH {PARSE_CTE}, s AS (SELECT *, CASE WHEN outcome <> 'quarantine' THEN
  CAST(len(list_filter(items, lambda x: json_extract_string(x, '$.severity') = 'critical')) AS BIGINT) END AS crit,
  CAST(len(items) AS BIGINT) AS n FROM parsed WHERE outcome <> 'quarantine'),
e AS (SELECT *, CASE WHEN crit > 0 THEN 'REQUEST_CHANGES' WHEN overall_score >= 85 AND n <= 2 THEN 'APPROVE' ELSE 'COMMENT' END AS event FROM s)
SELECT example_id, event, '## Code Review Bot — ' || CASE event WHEN 'APPROVE' THEN '✅ Approved' WHEN 'REQUEST_CHANGES' THEN '🔴 Changes requested'
 ELSE '💬 Reviewed' END || chr(10) || chr(10) || '**Quality Score: ' || coalesce(CASE WHEN overall_score = floor(overall_score) THEN CAST(CAST(overall_score AS BIGINT) AS VARCHAR) ELSE CAST(overall_score AS VARCHAR) END, 'null') || '/100**' || chr(10) || chr(10)
 || summary || chr(10) || chr(10) || '| Severity | Count |' || chr(10) || '|---|---|' || chr(10) || '| 🔴 Critical | ' || CAST(crit AS VARCHAR)
 || ' |' || chr(10) || '| Other | ' || CAST(n - crit AS VARCHAR) || ' |' AS summary_md FROM e"""


@register("format_summary", ORACLE_FORMAT_SUMMARY)
def q_format_summary(spark, d):
    p = RV.decide(_parsed(spark, d).where(F.col("outcome") != "quarantine"))
    crit = F.size(F.filter("comments", lambda c: c["severity"] == "critical")).cast("long")
    return p.select("example_id", "event", RV.format_summary(F.col("event"), F.col("overall_score"), F.col("summary"),
                                                             crit, F.size("comments").cast("long")).alias("summary_md"))


@register("severity_summary", """SELECT review_id, count(*) FILTER (WHERE severity = 'critical') AS critical,
 count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info,
 count(*) FILTER (WHERE severity = 'suggestion') AS suggestion, count(*) FILTER (WHERE severity <> 'critical') AS other
FROM review_comments GROUP BY review_id""")
def q_severity_summary(spark, d):
    return RV.severity_summary(V.review_comments(spark, d))


@register("rubric_score", """WITH s AS (SELECT review_id, count(*) FILTER (WHERE severity = 'critical') AS c,
 count(*) FILTER (WHERE severity = 'warning') AS w, count(*) FILTER (WHERE severity IN ('info', 'suggestion')) AS o
 FROM review_comments GROUP BY review_id)
SELECT r.id, r.overall_score, greatest(10, 100 - 20 * coalesce(c, 0) - 8 * coalesce(w, 0) - 2 * coalesce(o, 0)) AS rubric_score,
 r.overall_score - greatest(10, 100 - 20 * coalesce(c, 0) - 8 * coalesce(w, 0) - 2 * coalesce(o, 0)) AS score_minus_rubric
FROM reviews r LEFT JOIN s ON s.review_id = r.id""")
def q_rubric(spark, d):
    return RV.rubric_score(V.reviews(spark, d), V.review_comments(spark, d))


@register("upsert_reviews", """SELECT repo_full_name, pr_number, head_sha, arg_min(id, id) AS id, arg_min(pr_title, id) AS pr_title,
 arg_min(author_login, id) AS author_login, arg_min(provider, id) AS provider, arg_min(created_at, id) AS created_at,
 arg_min(review_event, id) AS review_event, first(summary ORDER BY id) AS summary, arg_max(overall_score, id) AS overall_score FROM reviews GROUP BY repo_full_name, pr_number, head_sha""")
def q_upsert(spark, d):
    """K2 as a write: three overlapping batches are applied to the bucketed
    table, one of them twice."""
    r = V.reviews(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    lo, hi = r.agg(F.percentile_approx("id", [0.3, 0.7]).alias("q")).first()["q"]
    path = scratch_path(spark, "reviews")
    parts = [r.where(F.col("id") <= hi), r.where(F.col("id").between(lo, hi)), r.where(F.col("id") > lo)]
    for batch_id, part in ((0, parts[0]), (1, parts[1]), (2, parts[2]), (2, parts[2])):
        ST.apply_reviews(spark, path, part, batch_id, buckets=8)
    return ST.stored_reviews(spark, path).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@register("sink_review_comments", f"""WITH {PARSE_CTE},
c AS (SELECT example_id AS review_id, CAST(i - 1 AS INT) AS pos, items[i] AS x
 FROM parsed, range(1, CAST(coalesce(len(items), 0) + 1 AS BIGINT)) t(i) WHERE outcome IN ('valid', 'partial'))
SELECT row_number() OVER (ORDER BY review_id, pos) AS id, review_id, pos, json_extract_string(x, '$.filePath') AS file_path,
 CAST(json_extract_string(x, '$.line') AS BIGINT) AS line_number, json_extract_string(x, '$.category') AS category,
 json_extract_string(x, '$.severity') AS severity, json_extract_string(x, '$.title') AS title,
 json_extract_string(x, '$.suggestion') AS suggestion, json_extract_string(x, '$.codeExample') AS code_example,
 TIMESTAMP '2024-05-01 12:00:00' AS created_at FROM c""")
def q_sink_comments(spark, d):
    """K3 as a write: two batches in order of the answers, the second one run
    twice. The answers are parsed once for all three."""
    p = stored(_parsed(spark, d).where(F.col("outcome").isin("valid", "partial")).select("example_id", "comments"), "parsed")
    mid = V.responses(spark, d).agg(F.percentile_approx("example_id", 0.5)).first()[0]
    path, now = scratch_path(spark, "comments"), F.expr("TIMESTAMP '2024-05-01 12:00:00'")
    for batch_id, part in ((0, p.where(F.col("example_id") <= mid)), (1, p.where(F.col("example_id") > mid)),
                           (1, p.where(F.col("example_id") > mid))):
        ST.append_comments(spark, path, part, batch_id, review_id="example_id", created_at=now)
    return ST.stored_comments(spark, path).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@register("constraint_not_null", """
SELECT 'reviews' AS table_name, 'repo_full_name' AS column_name, count(*) FILTER (WHERE repo_full_name IS NULL) AS nulls FROM reviews
UNION ALL SELECT 'reviews', 'pr_number', count(*) FILTER (WHERE pr_number IS NULL) FROM reviews
UNION ALL SELECT 'reviews', 'head_sha', count(*) FILTER (WHERE head_sha IS NULL) FROM reviews
UNION ALL SELECT 'reviews', 'overall_score', count(*) FILTER (WHERE overall_score IS NULL) FROM reviews
UNION ALL SELECT 'reviews', 'created_at', count(*) FILTER (WHERE created_at IS NULL) FROM reviews
UNION ALL SELECT 'review_comments', 'review_id', count(*) FILTER (WHERE review_id IS NULL) FROM review_comments
UNION ALL SELECT 'review_comments', 'file_path', count(*) FILTER (WHERE file_path IS NULL) FROM review_comments
UNION ALL SELECT 'review_comments', 'category', count(*) FILTER (WHERE category IS NULL) FROM review_comments
UNION ALL SELECT 'review_comments', 'severity', count(*) FILTER (WHERE severity IS NULL) FROM review_comments
UNION ALL SELECT 'review_comments', 'title', count(*) FILTER (WHERE title IS NULL) FROM review_comments
UNION ALL SELECT 'review_comments', 'suggestion', count(*) FILTER (WHERE suggestion IS NULL) FROM review_comments""")
def q_not_null(spark, d):
    return RV.null_audit(V.reviews(spark, d), "reviews", RV.REVIEWS_NOT_NULL).unionByName(
        RV.null_audit(V.review_comments(spark, d), "review_comments", RV.COMMENTS_NOT_NULL))


@register("constraint_unique_key", """SELECT repo_full_name, pr_number, head_sha, count(*) AS n FROM reviews
GROUP BY repo_full_name, pr_number, head_sha HAVING count(*) > 1""")
def q_unique(spark, d):
    return RV.unique_key_violations(V.reviews(spark, d))


@register("orphan_comments", "SELECT rc.id, rc.review_id FROM review_comments rc WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.id = rc.review_id)")
def q_orphans(spark, d):
    return RV.orphan_comments(V.review_comments(spark, d), V.reviews(spark, d)).select("id", "review_id")


@register("cascade_delete", """SELECT rc.id, rc.review_id FROM review_comments rc
WHERE rc.review_id IN (SELECT id FROM reviews WHERE overall_score >= 10)""")
def q_cascade(spark, d):
    surviving = V.reviews(spark, d).where(F.col("overall_score") >= 10)  # reviews below 10 deleted
    return RV.cascade_delete(V.review_comments(spark, d), surviving).select("id", "review_id")
