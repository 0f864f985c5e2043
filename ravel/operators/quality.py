"""Text quality scoring of raw training examples.

All flags are Java regexes evaluated by ``rlike`` inside whole-stage codegen;
each alternation group is one pattern and each flag is computed once, in one
projection, then reused by the score, the reasons and the category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import JS_SPACE, col_, has_words, js_trim, words_java
from .common import compute_once

_W = "[0-9A-Za-z_]"

# ---- Java patterns (built once from the fixed word lists) -------------------
ACK = P.ACK_1 + P.ACK_2
ACTIONABLE = P.ACTIONABLE_1 + P.ACTIONABLE_2 + P.ACTIONABLE_3
HIGH_VALUE = [w for g in P.HIGH_VALUE for w in g]
ACK_RE, ACTIONABLE_RE, HIGH_VALUE_RE = words_java(ACK), words_java(ACTIONABLE), words_java(HIGH_VALUE)
SPECIFIC_RES = [
    P.SPECIFIC_BACKTICK,
    f"(?<!{_W}){P.SPECIFIC_CALL}",
    words_java(P.SPECIFIC_PLACE),
    P.SPECIFIC_QUOTED,
]
LOW_VALUE_RES = [
    r"(?i)\A(?:" + "|".join(P.LOW_VALUE_PREFIX) + r")[:" + JS_SPACE[1:],
    r"(?i)\A(?:" + "|".join(P.LOW_VALUE_WHOLE) + r")\.?\z",
    words_java(P.LOW_VALUE_WORDS),
]

BUCKETS = ["0.0-0.3", "0.3-0.5", "0.5-0.65", "0.65-0.8", "0.8-1.0"]


def ack_flag(c) -> Column:
    """The text acknowledges a comment (fixed, done, good catch, ...)."""
    return has_words(c, ACK)


def actionable_flag(c) -> Column:
    """X2."""
    return has_words(c, ACTIONABLE)


def specific_pattern_count(c) -> Column:
    """How many of the four specificity patterns match at least once."""
    c = col_(c)
    tick, call, _, quoted = SPECIFIC_RES
    return (c.rlike(tick).cast("int") + (c.contains("()") & c.rlike(call)).cast("int")
            + has_words(c, P.SPECIFIC_PLACE).cast("int") + c.rlike(quoted).cast("int"))


def high_value_flag(c) -> Column:
    """X4."""
    return has_words(c, HIGH_VALUE)


def low_value_flag(c) -> Column:
    """X5."""
    c = col_(c)
    prefix, whole, _ = LOW_VALUE_RES
    # the first two hold at the text's begin alone
    head = F.substring(c, 1, 2 + max(map(len, P.LOW_VALUE_PREFIX + P.LOW_VALUE_WHOLE)))
    return head.rlike(prefix) | head.rlike(whole) | has_words(c, P.LOW_VALUE_WORDS)


def length_points(trimmed_len: Column) -> Column:
    """Points for the trimmed length."""
    n = trimmed_len
    return (F.when(n < 30, F.lit(-0.5)).when(n < 80, F.lit(0.1)).when(n <= 400, F.lit(0.25))
             .when(n <= 700, F.lit(0.15)).otherwise(F.lit(-0.1)))


def infer_category(c) -> Column:
    """First matching category word list, else 'style'."""
    c = col_(c)
    expr = None
    for cat, words in P.CATEGORY_RULES:
        found = has_words(c, words)
        expr = F.when(found, cat) if expr is None else expr.when(found, cat)
    return expr.otherwise("style")


def score_examples(df: DataFrame, text: str = "review_comment") -> DataFrame:
    """Adds ``quality_score`` (double in [0, 1]), ``quality_reasons``
    (array of tags in the reference's order) and ``category``.

    The score adds doubles in the reference's order (D6) so that sums such as
    0.25+0.2+0.1+0.3-0.1-0.1 = 0.6500000000000001 land on the same side of
    the thresholds."""
    t = F.col(text)
    flags = compute_once(df, _len=F.length(js_trim(t)), _act=actionable_flag(t),
                         _spec=specific_pattern_count(t), _high=high_value_flag(t), _low=low_value_flag(t),
                         category=infer_category(t))
    z = F.lit(0.0)
    s = z + length_points(F.col("_len"))
    s = s + F.when(F.col("_act"), F.lit(0.2)).otherwise(z)
    s = s + F.least(F.col("_spec") * F.lit(0.1), F.lit(0.25))
    s = s + F.when(F.col("_high"), F.lit(0.3)).otherwise(z)
    s = s - F.when(F.col("_low"), F.lit(0.4)).otherwise(z)
    s = s + F.when(F.col("author_ack"), F.lit(0.2)).otherwise(z)
    s = s + (F.when(F.col("reactions") >= 3, F.lit(0.15))
              .when(F.col("reactions") >= 1, F.lit(0.05)).otherwise(z))
    s = s + F.when(F.col("association").isin(*P.TRUSTED_ASSOCIATIONS), F.lit(0.1)).otherwise(z)
    has_patch = F.col("patch").isNotNull() & (F.col("patch") != "")
    s = s - F.when(has_patch & (F.col("_spec") == 0), F.lit(0.1)).otherwise(z)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))

    n = F.col("_len")
    reasons = F.array(
        F.when(n < 30, "too_short").when(n < 80, None).when(n <= 400, "good_length")
         .when(n <= 700, None).otherwise("too_long"),
        F.when(F.col("_act"), "actionable"),
        F.when(F.col("_spec") > 0, "specific"),
        F.when(F.col("_high"), "high_value"),
        F.when(F.col("_low"), "low_value"),
        F.when(F.col("author_ack"), "author_ack"),
        F.when(F.col("reactions") >= 3, "reactions"),
        F.when(F.col("association").isin(*P.TRUSTED_ASSOCIATIONS), "trusted_author"),
    )
    return (flags.withColumn("quality_score", score)
                 .withColumn("quality_reasons", F.filter(reasons, lambda x: x.isNotNull()))
                 .drop("_len", "_act", "_spec", "_high", "_low"))


def threshold_filter(scored: DataFrame, min_score: float = 0.65) -> DataFrame:
    """Keep ``quality_score >= min_score``."""
    return scored.where(F.col("quality_score") >= F.lit(float(min_score)))


def score_bucket(c="quality_score") -> Column:
    s = col_(c)
    return (F.when(s < 0.3, BUCKETS[0]).when(s < 0.5, BUCKETS[1]).when(s < 0.65, BUCKETS[2])
             .when(s < 0.8, BUCKETS[3]).otherwise(BUCKETS[4]))


def score_histogram(scored: DataFrame) -> DataFrame:
    """Rows per fixed score bucket over all scored rows (kept or not);
    empty buckets are 0. One aggregate pass, then unpivot to five rows."""
    s = F.col("quality_score")
    conds = [s < 0.3, (s >= 0.3) & (s < 0.5), (s >= 0.5) & (s < 0.65), (s >= 0.65) & (s < 0.8), s >= 0.8]
    one = scored.agg(*[F.count_if(c).alias(f"b{i}") for i, c in enumerate(conds)])
    stack = "stack(5, " + ", ".join(f"{i}, '{b}', b{i}" for i, b in enumerate(BUCKETS)) + ") AS (bucket_pos, bucket, n)"
    return one.selectExpr(stack)


def category_counts(kept: DataFrame) -> DataFrame:
    """Kept rows per inferred category, largest first."""
    return (kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.col("n").desc(), "category"))


def filter_report(scored: DataFrame, min_score: float = 0.65, total_col: str | None = None) -> DataFrame:
    """A10: total rows, kept rows and kept percent (one decimal, as text in
    the reference; a double here). Empty input gives a null percent."""
    kept = F.count_if(F.col("quality_score") >= F.lit(float(min_score)))
    return scored.agg(F.count(F.lit(1)).alias("total"), kept.alias("kept")).withColumn(
        "kept_pct", F.round(F.try_divide(F.col("kept") * 100.0, F.col("total")), 1))
