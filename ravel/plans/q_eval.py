"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import words_re2
from ..operators import evaluation as E
from ..operators import quality as Q
from ..operators import training as TR
from ..sources import views as V
from . import sqlfrag as S
from .q_reviews import strip_sql
from .registry import register

_SPEC_RE2 = [P.SPECIFIC_BACKTICK, r"\b" + P.SPECIFIC_CALL, P.SPECIFIC_QUOTED, words_re2(P.EVAL_SPECIFIC_PLACE)]
_ACT_RE2 = [words_re2(P.EVAL_ACTIONABLE_1), words_re2(P.EVAL_ACTIONABLE_2), words_re2(P.EVAL_ACTIONABLE_3)]
_SPEC_SQL = "least(CAST(1 AS DOUBLE), (" + " + ".join(S.rx_count("raw_text", p) for p in _SPEC_RE2) + ") / CAST(3 AS DOUBLE))"
_ACT_SQL = "(" + " + ".join(f"CAST({S.rx('raw_text', p)} AS INT)" for p in _ACT_RE2) + ") / CAST(3 AS DOUBLE)"
_CLEAN = strip_sql("raw_text", bare=False)
_VALID_SQL = f"CAST(coalesce(json_valid({_CLEAN}), false) AS INT)"


def _first(field: str, expected: str) -> str:
    return (f"CASE WHEN json_valid({_CLEAN}) AND json_type({_CLEAN}, '$.comments[0].{field}') = 'VARCHAR' "
            f"AND json_extract_string({_CLEAN}, '$.comments[0].{field}') = {expected} THEN 1 ELSE 0 END")


_CAT_SQL = _first("category", "coalesce(expected_category, 'style')")
_SCORES = f"""sc AS (SELECT example_id, model,
 CASE WHEN error IS NOT NULL THEN 0 ELSE {_VALID_SQL} END AS json_validity,
 CASE WHEN error IS NOT NULL THEN CAST(0 AS DOUBLE) ELSE {_SPEC_SQL} END AS specificity,
 CASE WHEN error IS NOT NULL THEN CAST(0 AS DOUBLE) ELSE {_ACT_SQL} END AS actionability,
 CASE WHEN error IS NOT NULL THEN 0 ELSE {_CAT_SQL} END AS category_match,
 CAST(CASE WHEN error IS NOT NULL THEN 0 ELSE length(raw_text) END AS INT) AS comment_length
 FROM responses WHERE error IS NULL OR model = 'tuned')"""


def _resp(spark, d):
    return V.responses(spark, d).withColumn("expected", F.coalesce("expected_category", F.lit("style")))


def _scores(spark, d):
    return E.row_scores(_resp(spark, d))


@register("specificity", f"SELECT example_id, round({_SPEC_SQL}, 6) AS specificity FROM responses")
def q_specificity(spark, d):
    return V.responses(spark, d).select("example_id", F.round(E.specificity("raw_text"), 6).alias("specificity"))


@register("actionability", f"SELECT example_id, round({_ACT_SQL}, 6) AS actionability FROM responses")
def q_actionability(spark, d):
    return V.responses(spark, d).select("example_id", F.round(E.actionability("raw_text"), 6).alias("actionability"))


@register("json_validity", f"SELECT example_id, {_VALID_SQL} AS json_validity FROM responses")
def q_json_validity(spark, d):
    return V.responses(spark, d).select("example_id", E.json_validity("raw_text").alias("json_validity"))


@register("category_match", f"SELECT example_id, {_CAT_SQL} AS category_match FROM responses")
def q_category_match(spark, d):
    return _resp(spark, d).select("example_id", E.category_match("raw_text", "expected").alias("category_match"))


@register("eval_row_scores", f"WITH {_SCORES} SELECT example_id, model, json_validity, round(specificity, 6) AS specificity, "
          "round(actionability, 6) AS actionability, category_match, comment_length FROM sc")
def q_row_scores(spark, d):
    return _scores(spark, d).withColumn("specificity", F.round("specificity", 6)) \
                            .withColumn("actionability", F.round("actionability", 6))


_METRICS_SQL = f"""{_SCORES}, m AS (SELECT model, count(*) AS n, avg(json_validity) AS j, avg(specificity) AS s, avg(actionability) AS a,
 avg(category_match) AS c, avg(comment_length) AS l FROM sc GROUP BY model),
mm AS (SELECT model, n, round(j, 3) AS json_validity, round(s, 3) AS specificity, round(a, 3) AS actionability,
 round(c, 3) AS category_accuracy, CAST(floor(l + 0.5) AS BIGINT) AS avg_comment_length,
 round(j * CAST(0.3 AS DOUBLE) + s * CAST(0.25 AS DOUBLE) + a * CAST(0.25 AS DOUBLE) + c * CAST(0.2 AS DOUBLE), 3) AS combined_score FROM m)"""


@register("eval_metrics", f"WITH {_METRICS_SQL} SELECT * FROM mm")
def q_eval_metrics(spark, d):
    return E.eval_metrics(_scores(spark, d))


@register("eval_comparison", f"""WITH {_METRICS_SQL},
l AS (UNPIVOT (SELECT model, CAST(n AS DOUBLE) AS n, CAST(json_validity AS DOUBLE) AS json_validity, CAST(specificity AS DOUBLE) AS specificity,
 CAST(actionability AS DOUBLE) AS actionability, CAST(category_accuracy AS DOUBLE) AS category_accuracy,
 CAST(avg_comment_length AS DOUBLE) AS avg_comment_length, CAST(combined_score AS DOUBLE) AS combined_score FROM mm)
 ON n, json_validity, specificity, actionability, category_accuracy, avg_comment_length, combined_score INTO NAME metric VALUE value)
SELECT metric, max(value) FILTER (WHERE model = 'tuned') AS tuned, max(value) FILTER (WHERE model = 'base') AS base FROM l GROUP BY metric""")
def q_eval_comparison(spark, d):
    return E.eval_comparison(E.eval_metrics(_scores(spark, d)))


def _kept(spark, d):
    return Q.threshold_filter(Q.score_examples(V.raw_examples(spark, d)), 0.65)


_KEPT = f"{S.scored_cte()}, kept AS (SELECT * FROM scored WHERE quality_score >= CAST(0.65 AS DOUBLE))"


@register("response_expected_join", f"""WITH {_KEPT}
SELECT r.example_id, r.model, coalesce(k.category, 'style') AS expected FROM responses r LEFT JOIN kept k ON k.example_id = r.example_id""")
def q_response_join(spark, d):
    return E.response_expected_join(V.responses(spark, d), _kept(spark, d)).select("example_id", "model", "expected")


_EVAL_ORDER = f"""{_KEPT}, sp AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(example_id AS VARCHAR)), example_id) AS pos,
 count(*) OVER () AS n FROM kept), ev AS (SELECT *, row_number() OVER (ORDER BY pos) AS epos FROM sp WHERE pos > floor(n * CAST(0.9 AS DOUBLE)))"""


def _eval_set(spark, d):
    sp = TR.exact_split(_kept(spark, d), "example_id").where(F.col("split") == "eval")
    return sp.drop("pos")


@register("head_n", f"WITH {_EVAL_ORDER} SELECT example_id, epos AS pos FROM ev WHERE epos <= 30")
def q_head_n(spark, d):
    ev = _eval_set(spark, d)
    return E.head_n(ev, TR.seeded_order_key("example_id"), [F.col("example_id")], 30).select("example_id", "pos")


@register("every_kth_sample", f"WITH {_EVAL_ORDER} SELECT example_id, epos AS pos FROM ev WHERE epos <= 30 AND (epos - 1) % 5 = 0")
def q_every_kth(spark, d):
    ev = _eval_set(spark, d)
    head = E.head_n(ev, TR.seeded_order_key("example_id"), [F.col("example_id")], 30)
    return E.every_kth(head, 5).select("example_id", "pos")


@register("union_models", f"WITH {_SCORES} SELECT model, count(*) AS n FROM sc GROUP BY model")
def q_union_models(spark, d):
    s = _scores(spark, d)
    tuned, base = s.where(F.col("model") == "tuned"), s.where(F.col("model") == "base")
    return E.union_models(tuned, base).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


_SEV_SQL = ("CASE WHEN category = 'security' THEN 'critical' WHEN category = 'performance' AND quality_score > 0.8 THEN 'warning' "
            "WHEN category = 'architecture' THEN 'warning' WHEN quality_score > 0.8 THEN 'warning' ELSE 'info' END")


@register("severity_match", f"""WITH {_KEPT}
SELECT r.example_id, {_first('severity', 'k.sev')} AS severity_match FROM responses r
JOIN (SELECT example_id, {_SEV_SQL} AS sev FROM kept) k ON k.example_id = r.example_id""")
def q_severity_match(spark, d):
    k = _kept(spark, d).select("example_id", TR.infer_severity().alias("sev"))
    r = V.responses(spark, d).join(k, "example_id")
    return r.select("example_id", E.severity_match("raw_text", "sev").alias("severity_match"))


_RUN_SQL = f"""{_EVAL_ORDER}, sample AS (SELECT example_id, epos, category AS expected_category FROM ev WHERE epos <= 30),
run AS (SELECT s.example_id, 'tuned' AS model, expected_category, raw_text, coalesce(error, CASE WHEN raw_text IS NULL THEN 'no answer' END) AS error
  FROM sample s LEFT JOIN (SELECT example_id, raw_text, error FROM responses WHERE example_id % 3 <> 0) r ON r.example_id = s.example_id
 UNION ALL SELECT s.example_id, 'base', expected_category, raw_text, error FROM sample s
  JOIN (SELECT example_id, raw_text, error FROM responses) r ON r.example_id = s.example_id WHERE (epos - 1) % 5 = 0),
{_METRICS_SQL.replace("FROM responses WHERE", "FROM run WHERE")}"""


@register("evaluation_run", f"WITH {_RUN_SQL} SELECT * FROM mm")
def q_evaluation_run(spark, d):
    """Split, first examples, every fifth for the baseline, metrics; a third
    of the examples has no answer of the main model."""
    r = V.responses(spark, d)
    return E.evaluation_run(_eval_set(spark, d), r.where("example_id % 3 <> 0"), r, 30, 5, TR.seeded_order_key("example_id"))
