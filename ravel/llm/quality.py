"""Quality rules with robust multivariate outliers, in DataFrame functions.

Counts over the whole text give base rules (too short, too repetitive) and a
vector of transformed statistics. Per language and source a minimum covariance
determinant estimate of that vector is fitted: start from medians and absolute
deviations, then concentration steps, each keeping the share ``coverage`` of
rows with the smallest distances and re-estimating mean and covariance from
them. Documents whose squared Mahalanobis distance exceeds a chi-square
quantile are rejected.

Fits are aggregates over all rows; what is joined back to the documents is one
row per (language, source)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import compute_once
from .common import NONSPACE_CLASS, SPACE_CLASS, fresh, saved

SYMBOLS = r"[#*$%&|<>]"
RUN = 5                      # words of a repeated window
MIN_WORDS, REPEAT_PCT = 10, 20

COVERAGE = 0.75              # share of rows a concentration step keeps
STEPS = 4                    # concentration steps
MIN_GROUP = 50               # fewer rows: the estimate of the whole language
TAIL = 1e-7                  # share of a normal population beyond the limit

# The statistics and the smallest standard deviation each is given: most
# documents have no symbol, repeated line or repeated window at all, so the
# spread of the closest documents alone can be 0.
VECTOR = (
    ("_v0", "ln(1 + word_chars / n_words)", 0.08),
    ("_v1", "ln(1 + 100 * n_symbols / n_words)", 0.60),
    ("_v2", "sqrt(n_dup_lines / n_lines)", 0.15),
    ("_v3", "sqrt(n_repeat_words / n_words)", 0.12),
)


def _long(c: Column) -> Column:
    return c.cast("bigint")


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words of the whole text (null: no words).

    A window of five words is known by a 64-bit hash chained from its words'
    hashes (pairs, then pairs of pairs, then the fifth word). Only where two
    windows of a text are equal are they sorted with their places, and the
    words that repeated windows cover counted."""
    t, w, h, p, q, g = (fresh(df, c) for c in ("_qt", "_qw", "_qh", "_qp", "_qq", "_qg"))

    def chained(x: str, y: str, ahead: int) -> Column:
        """Hashes of x[i] with y[i + ahead], as far as both go."""
        shorter = F.slice(y, ahead + 1, F.size(y))
        return F.zip_with(F.slice(x, 1, F.size(shorter)), shorter, lambda a, b: F.xxhash64(a, b))

    df = compute_once(
        df.withColumn(t, F.coalesce(F.col(text), F.lit(""))),
        **{w: F.array_remove(F.split(t, SPACE_CLASS + "+"), "")}, _ql=F.filter(
            F.split(t, "\n"), lambda x: x.rlike(NONSPACE_CLASS)),
        n_symbols=_long(F.length(t) - F.length(F.regexp_replace(t, SYMBOLS + "+", "")))).drop(t)
    df = compute_once(
        df, n_words=_long(F.size(w)), word_chars=_long(F.length(F.array_join(w, ""))),
        n_lines=_long(F.size("_ql")), n_dup_lines=_long(F.size("_ql") - F.size(F.array_distinct("_ql"))),
        **{h: F.transform(w, lambda x: F.xxhash64(x))}).drop("_ql", w)
    df = compute_once(df, **{p: chained(h, h, 1)})
    df = compute_once(df, **{q: chained(p, p, 2)}).drop(p)
    df = compute_once(df, **{p: chained(q, h, 4)}).drop(q, h)
    placed = F.transform(p, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
    df = compute_once(df, **{g: F.when(F.size(F.array_distinct(p)) < F.size(p), F.sort_array(placed))}).drop(p)

    def at(j: Column) -> Column:   # null beyond the ends
        return F.get(g, j)["g"]

    twice = F.filter(F.transform(g, lambda x, j: F.when(x["g"].eqNullSafe(at(j - 1)) | x["g"].eqNullSafe(at(j + 1)), x["i"])),
                     lambda i: i.isNotNull())
    covered = F.aggregate(
        F.sort_array(twice), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + RUN).alias("end"), (a["n"] + i + RUN - F.greatest(i, a["end"])).alias("n")))["n"]
    return compute_once(df, n_repeat_words=_long(F.coalesce(covered, F.lit(0)))).drop(g)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PCT)


def chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, df // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi2_quantile(q: float, df: int, tail: bool = False) -> float:
    """The point below which the share ``q`` lies (above which, if ``tail``)."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        half, term, total = mid / 2, 1.0, 1.0
        for k in range(1, df // 2):
            term *= half / k
            total += term
        over = math.exp(-half) * total
        if (over > q) if tail else (1 - over < q):
            lo = mid
        else:
            hi = mid
    return lo


def _moments(rows: DataFrame, key: str) -> DataFrame:
    """Per group: mean, and the lower triangle of the covariance."""
    vs = [v for v, _, _ in VECTOR]
    aggs = [F.avg(v).alias(f"m{i}") for i, v in enumerate(vs)]
    aggs += [F.covar_pop(vs[i], vs[j]).alias(f"c{i}_{j}") for i in range(len(vs)) for j in range(i + 1)]
    return rows.groupBy(key).agg(*aggs)


def _cholesky(fit: DataFrame, inflate: float) -> DataFrame:
    """Group parameters m*, and the Cholesky factor l*_* of ``inflate`` times
    the covariance plus the least variances on the diagonal."""
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            a = F.col(f"c{i}_{j}") * inflate + (F.lit(VECTOR[i][2] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                a = a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            # positive by the least variances; the bound guards rounding only
            value = F.sqrt(F.greatest(a, F.lit(VECTOR[i][2] ** 2 / 2))) if i == j else a / F.col(f"l{j}_{j}")
            fit = fit.withColumn(f"l{i}_{j}", value)
    return fit.drop(*[f"c{i}_{j}" for i in range(len(VECTOR)) for j in range(i + 1)])


def _distance(df: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution."""
    for i, (v, _, _) in enumerate(VECTOR):
        z = F.col(v) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}_{k}") * F.col(f"_z{k}")
        df = df.withColumn(f"_z{i}", z / F.col(f"l{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, len(VECTOR))),
                                   F.col("_z0") * F.col("_z0"))).drop(*[f"_z{i}" for i in range(len(VECTOR))])


def mcd_fit(rows: DataFrame, key: str, coverage: float = COVERAGE, steps: int = STEPS, least: int = 1) -> DataFrame:
    """One row per ``key`` of ``rows`` (columns key and the vector) with at
    least ``least`` rows: means and Cholesky factor of the minimum covariance
    determinant estimate. The rows are never dealt by key: the table of the
    groups, stored and so of known size, is joined to them."""
    p, vs = len(VECTOR), [v for v, _, _ in VECTOR]
    inflate = coverage / chi2_cdf(chi2_quantile(coverage, p), p + 2)
    mid = saved(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[
        F.percentile_approx(v, 0.5, 10000).alias(f"m{i}") for i, v in enumerate(vs)]).where(F.col("_n") >= least).drop("_n"), "mcd")
    dev = rows.join(mid, key).groupBy(key).agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5, 10000).alias(f"s{i}") for i, v in enumerate(vs)])
    fit = dev.select(key, *[f"m{i}" for i in range(p)], *[
        (F.greatest(F.col(f"s{i}") * 1.4826, F.lit(VECTOR[i][2])) if i == j else F.lit(0.0)).alias(f"l{i}_{j}")
        for i in range(p) for j in range(i + 1)])
    for _ in range(steps):
        fit = saved(fit, "mcd")
        far = _distance(rows.join(fit, key)).select(key, *vs, "d2")
        limit = saved(far.groupBy(key).agg(F.percentile_approx("d2", coverage, 10000).alias("_limit")), "mcd")
        fit = _cholesky(_moments(far.join(limit, key).where(F.col("d2") <= F.col("_limit")), key), inflate)
    return saved(fit, "mcd")


def judged(docs: DataFrame, counts: DataFrame, lang: str, source: str, tail: float = TAIL) -> DataFrame:
    """``counts`` (a stored table with the counts, lang and source) plus
    base_failed, d2 (null where there is no fit) and kept."""
    null_safe = [F.concat(F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.col(c), F.lit("")))
                 for c in (lang, source)]
    df = counts.withColumn("_lang", null_safe[0]).withColumn("_src", F.concat_ws("\n", *null_safe))
    # one fit over both kinds of groups: a row counts for its language and for its language's source
    vec = df.where(F.col("n_words") >= MIN_WORDS).select(
        F.explode(F.array(F.concat(F.lit("l"), "_lang"), F.concat(F.lit("s"), "_src"))).alias("_key"),
        *[F.expr(e).cast("double").alias(v) for v, e, _ in VECTOR])
    fit = mcd_fit(vec, "_key", least=MIN_GROUP)
    pars = [c for c in fit.columns if c != "_key"]
    for name, kind, group in (("a", "s", "_src"), ("b", "l", "_lang")):
        of = fit.where(F.substring("_key", 1, 1) == kind).select(
            F.expr("substring(_key, 2)").alias(group), *[F.col(c).alias(f"_{name}_{c}") for c in pars])
        df = df.join(of, group, "left")
    df = df.select(*[c for c in df.columns if not c.startswith(("_a_", "_b_"))],
                   *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in pars])
    enough = F.col("n_words") >= MIN_WORDS
    for v, e, _ in VECTOR:
        df = df.withColumn(v, F.when(enough, F.expr(e).cast("double")))
    df = _distance(df).withColumn("base_failed", base_failed())
    over = F.coalesce(F.col("d2") > chi2_quantile(tail, len(VECTOR), tail=True), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~over).drop(
        "_lang", "_src", *pars, *[v for v, _, _ in VECTOR])


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                   source: str = "source", tail: float = TAIL) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, d2.

    Null and empty texts have no words and fail the base rules. Null languages
    and sources are groups of their own. A (language, source) of fewer than
    MIN_GROUP documents takes the estimate of its language; where that has too
    few as well, no document is rejected by distance. Repeated rows are judged
    alike; null ids are kept."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
                    F.col(source).alias("source"))
    counts = saved(text_counts(d, "text").drop("text"), "quality")
    return judged(d, counts, "lang", "source", tail).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
              tail: float = TAIL) -> DataFrame:
    """The documents that pass, with their own columns. The counts are stored
    beside the rows, so the text is measured once and never shuffled."""
    row = fresh(docs, "_row")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(text).alias("text"),
                        F.col(lang).alias("lang"), F.col(source).alias("source"))
    counts = saved(text_counts(inner, "text").drop("text"), "quality")
    kept = judged(docs, counts, "lang", "source", tail).where("kept")
    return kept.select(f"{row}.*")
