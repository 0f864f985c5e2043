"""Evaluation of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import col_, has_words, is_strict_json, parse_json_strict, variant_type, words_java
from .common import compute_once, global_position, stored
from .reviews import strip_fences

_W = "[0-9A-Za-z_]"
SPECIFICITY_RES = [P.SPECIFIC_BACKTICK, f"(?<!{_W}){P.SPECIFIC_CALL}", P.SPECIFIC_QUOTED,
                   words_java(P.EVAL_SPECIFIC_PLACE)]
ACTIONABILITY = [P.EVAL_ACTIONABLE_1, P.EVAL_ACTIONABLE_2, P.EVAL_ACTIONABLE_3]
# weights of the combined score (fixed values)
WEIGHTS = {"json_validity": 0.3, "specificity": 0.25, "actionability": 0.25, "category_match": 0.2}
METRICS = ["json_validity", "specificity", "actionability", "category_accuracy", "avg_comment_length",
           "combined_score"]


def specificity(c) -> Column:
    """min(1, all matches of four patterns / 3)."""
    c = col_(c)
    tick, call, quoted, place = (F.regexp_count(c, F.lit(p)) for p in SPECIFICITY_RES)
    # counted only where the text has what every match has
    call = F.when(~c.contains("()"), 0).otherwise(call)
    place = F.when(~has_words(c, P.EVAL_SPECIFIC_PLACE), 0).otherwise(place)
    total = tick + call + quoted + place
    return F.least(F.lit(1.0), total / F.lit(3.0))


def actionability(c) -> Column:
    """Share of three patterns that match."""
    c = col_(c)
    n = sum((has_words(c, w).cast("int") for w in ACTIONABILITY[1:]), has_words(c, ACTIONABILITY[0]).cast("int"))
    return n / F.lit(3.0)


def json_validity(c) -> Column:
    """1 when the answer (```json fence removed) is strict JSON."""
    return is_strict_json(strip_fences(c, bare_fence=False)).cast("int")


def first_comment_field(c, field: str) -> Column:
    """String value of ``comments[0].<field>`` of the answer, else null."""
    return _first_comment(parse_json_strict(strip_fences(c, bare_fence=False)), field)


def _first_comment(v: Column, field: str) -> Column:
    path = f"$.comments[0].{field}"
    return F.when(variant_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def category_match(c, expected) -> Column:
    """First comment's category equals the expected one; else 0."""
    return F.coalesce((first_comment_field(c, "category") == col_(expected)).cast("int"), F.lit(0))


def severity_match(c, expected) -> Column:
    """The same test for the severity."""
    return F.coalesce((first_comment_field(c, "severity") == col_(expected)).cast("int"), F.lit(0))


def row_scores(responses: DataFrame, main_model: str = "tuned", text: str = "raw_text",
               expected: str = "expected") -> DataFrame:
    """The five scores per answer. A failed call (``error`` set) scores
    zeros for the main model and is skipped for the baseline."""
    failed = F.col("error").isNotNull()
    r = responses.where(~failed | (F.col("model") == main_model))
    # parsed once for both scores that need it
    r = compute_once(r, _answer=F.when(~failed, parse_json_strict(strip_fences(text, bare_fence=False))))
    z = lambda e: F.when(failed, F.lit(0)).otherwise(e)
    return r.select(
        "example_id", "model",
        F.col("_answer").isNotNull().cast("int").alias("json_validity"),
        z(specificity(text)).cast("double").alias("specificity"),
        z(actionability(text)).cast("double").alias("actionability"),
        F.coalesce((_first_comment(F.col("_answer"), "category") == F.col(expected)).cast("int"), F.lit(0)).alias("category_match"),
        z(F.length(text)).cast("int").alias("comment_length"))


def eval_metrics(scores: DataFrame) -> DataFrame:
    """Per model n, rounded means (3 digits), rounded mean length and the
    weighted combined score (weights on the unrounded means). No rows → no
    row for that model."""
    m = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce("json_validity", F.lit(0))).alias("_j"),
        F.avg(F.coalesce("specificity", F.lit(0.0))).alias("_s"),
        F.avg(F.coalesce("actionability", F.lit(0.0))).alias("_a"),
        F.avg(F.coalesce("category_match", F.lit(0))).alias("_c"),
        F.avg(F.coalesce("comment_length", F.lit(0))).alias("_l"))
    combined = (F.col("_j") * WEIGHTS["json_validity"] + F.col("_s") * WEIGHTS["specificity"]
                + F.col("_a") * WEIGHTS["actionability"] + F.col("_c") * WEIGHTS["category_match"])
    return m.select("model", "n",
                    F.round("_j", 3).alias("json_validity"), F.round("_s", 3).alias("specificity"),
                    F.round("_a", 3).alias("actionability"), F.round("_c", 3).alias("category_accuracy"),
                    F.floor(F.col("_l") + 0.5).cast("long").alias("avg_comment_length"),
                    F.round(combined, 3).alias("combined_score"))


def eval_comparison(metrics: DataFrame, models=("tuned", "base")) -> DataFrame:
    """Metrics side by side, one row per metric, one column per model
    (fixed pivot values)."""
    long = metrics.select("model", F.col("n").cast("double").alias("n"),
                          *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(
        "model", ["n"] + METRICS, "metric", "value")
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def response_expected_join(responses: DataFrame, examples: DataFrame) -> DataFrame:
    """Answers joined to their example; a missing category is 'style'."""
    ex = examples.select("example_id", F.col("category").alias("_cat"))
    return (responses.join(ex, "example_id", "left")
                     .withColumn("expected", F.coalesce("_cat", F.lit("style"))).drop("_cat"))


def head_n(df: DataFrame, order_key: Column, tie: list[Column], n: int = 100) -> DataFrame:
    """The first ``n`` rows of an order (positions computed distributed)."""
    return global_position(df, order_key, tie).where(F.col("pos") <= n)


def every_kth(df: DataFrame, k: int = 5, pos_col: str = "pos") -> DataFrame:
    """Every k-th row (0-based index divisible by k) of a positioned set."""
    return df.where(F.pmod(F.col(pos_col) - 1, F.lit(k)) == 0)


def union_models(*results: DataFrame) -> DataFrame:
    """Results of several models in one table (``model`` column)."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def evaluation_run(examples: DataFrame, answers: DataFrame, baseline: DataFrame, n: int = 100, k: int = 5,
                   order_key: Column | None = None, main_model: str = "tuned", base_model: str = "base") -> DataFrame:
    """The whole evaluation: the first ``n`` examples of the order are put to
    the main model, every ``k``-th of them to the baseline; metrics per model
    (A11). ``answers`` and ``baseline`` hold (example_id, raw_text, error). A
    missing or failed answer scores zeros for the main model and is left out
    for the baseline."""
    key = F.md5(F.col("example_id").cast("string")) if order_key is None else order_key
    sample = stored(head_n(examples.select("example_id", F.coalesce("category", F.lit("style")).alias("expected")),
                           key, [F.col("example_id")], n), "sample")
    missing = F.when(F.col("raw_text").isNull() & F.col("error").isNull(), F.lit("no answer")).otherwise(F.col("error"))
    main = (sample.join(answers.select("example_id", "raw_text", "error"), "example_id", "left")
                  .withColumn("error", missing).withColumn("model", F.lit(main_model)))
    base = (every_kth(sample, k).join(baseline.select("example_id", "raw_text", "error"), "example_id")
                                .withColumn("model", F.lit(base_model)))
    return eval_metrics(row_scores(union_models(main, base), main_model))
