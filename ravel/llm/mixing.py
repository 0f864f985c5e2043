"""Mixing to target weights with soft domain membership, in DataFrame
functions.

A naive Bayes classifier over the distinct hashed words of a document (lower-
cased alphanumeric runs; tokens are split at white space), fitted on labelled rows, gives every document posteriors over the domains. Words that
are as frequent in a domain as elsewhere, give or take chance, say nothing;
without that rule the chance of hundreds of words outweighs the few that tell. Nonnegative rates per document are
then fitted by projected-gradient least squares so that the expected tokens of
each domain (rate * tokens * posterior, summed) meet the targets.

A gradient step changes a document's rate by its posteriors times one number
per domain and then cuts it at 0, so a rate follows from the document's own
posteriors and the steps so far, a few numbers each, which the driver keeps.
Each step is one aggregate over the stored posteriors; every few steps the
rates are stored beside them and go on from there."""

from __future__ import annotations

import json
import logging
import math
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import compute_once
from .common import ALNUM_BYTES, LOWER, SPACE_CLASS, UPPER, fresh, sample_bound, saved

# Domains by their condition on a labelled row, and their default weights in
# the mixture.
DOMAINS = (("good", "toxic = 0 AND quality = 1", 0.92),
           ("low", "toxic = 0 AND quality = 0", 0.07),
           ("toxic", "toxic = 1", 0.01))
BUCKETS = 1 << 16            # hashed vocabulary
MAX_LABELLED = 20_000        # labelled rows the classifier is fitted on
PRIOR_COUNT = 5.0            # documents of each domain a bucket is taken to hold beforehand
SIGMAS = 3                   # a bucket counts for a domain if its share lies so many standard errors off
ROUNDS = 100                 # most gradient steps
TOLERANCE = 1e-4             # the fit ends when no domain errs by more of all tokens, or rates move less on average
STORED_STEPS = 3             # steps after which the rates are stored; a plan holds no more of them
# Separators of alphanumeric words in lower-cased text, one by one: a class of single characters is one table
# look-up a character, a class of ranges a test a range.
SEPARATORS = "[" + "".join(f"\\x{c:02X}" for c, b in enumerate(ALNUM_BYTES) if b == 0x20) + "]+"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+"), "")


def _terms(text: str) -> Column:
    """The alphanumeric words, A-Z lower-cased, that the classifier looks at.
    Where a text has no other characters than those of ASCII, ``lower`` does the
    same as ``translate``, which looks every character up."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_classifier(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   domains=DOMAINS, max_labelled: int = MAX_LABELLED) -> DataFrame | None:
    """One row: priors (array by domain), weights (array by domain of an array
    by bucket: log of the bucket's share in the domain over its share in all, 0
    where the two do not differ by more than chance) and masses (array by
    domain: log of what those shares add up to). Fitted on about ``max_labelled`` labelled rows (whose id's hash lies
    under a bound); None where no labelled row has a text. A row that fits
    several domains' conditions belongs to the first; conflicting rows of one
    id count each."""
    which = F.coalesce(*[F.when(F.expr(cond), F.lit(k)) for k, (_, cond, _) in enumerate(domains)])
    known = (labels.select(F.col("doc_id").alias("_lid"), which.alias("_domain")).where("_lid IS NOT NULL AND _domain IS NOT NULL")
                   .join(docs.select(F.col(doc_id).alias("_lid")), "_lid", "left_semi").distinct())
    sample = known.where(F.xxhash64("_lid") < sample_bound(known.count(), max_labelled))
    # about max_labelled rows of two numbers
    rows = docs.select(F.col(doc_id).alias("_lid"), F.col(text).alias("_t")).join(F.broadcast(sample), "_lid")
    counts = saved(rows.select("_domain", F.explode(F.array_distinct(F.transform(_terms("_t"), _bucket))).alias("b"))
                       .groupBy("_domain", "b").agg(F.count(F.lit(1)).cast("double").alias("n")),
                   "counts")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    n = [F.coalesce(F.sum(F.when(F.col("_domain") == k, F.col("n"))), F.lit(0.0)) for k in range(len(domains))]
    share = [float(x or 0) / total for x in counts.agg(*n).first()]
    per = counts.groupBy("b").agg(*[c.alias(f"n{k}") for k, c in enumerate(n)], F.sum("n").alias("n"))
    ids = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    per = ids.join(per, "b", "left").na.fill(0.0)
    # BUCKETS rows in all: a bounded table
    # seen over expected, where the two differ by more than chance
    odds = [F.when(F.abs(F.col(f"n{k}") - F.col("n") * s) > F.sqrt(F.col("n") * (s * (1 - s)) + 1) * SIGMAS,
                   (F.col(f"n{k}") + PRIOR_COUNT) / (F.col("n") * s + PRIOR_COUNT)).otherwise(1.0)
            for k, s in enumerate(share)]
    # each domain's words have probabilities that add up to 1, or long texts would lean to one domain
    mass = per.agg(*[F.sum(F.col("n") / total * x) for x in odds]).first()
    logs = [F.log(x).alias(f"w{k}") for k, x in enumerate(odds)]
    rows = F.sort_array(F.collect_list(F.struct("b", *[f"w{k}" for k in range(len(domains))])))
    model = per.select("b", *logs).agg(rows.alias("r")).select(
        F.array(*[F.lit(max(s, 1e-9)) for s in share]).alias("priors"),
        F.array(*[_pick("r", f"w{k}") for k in range(len(domains))]).alias("weights"),
        F.array(*[F.lit(math.log(z)) for z in mass]).alias("masses"))
    return saved(model, "model")


def _pick(rows: str, field: str) -> Column:
    return F.transform(rows, lambda x: x[field])


def with_posteriors(docs: DataFrame, model: DataFrame | None, text: str, out: str, domains=DOMAINS) -> DataFrame:
    """``docs`` plus the struct column ``out``: tokens (words) and p (array of
    posteriors by domain). Texts without words have the priors; without a
    model, every posterior is the domain's weight. Buckets without weights add
    nothing to a score but their number: only the others are summed."""
    idx = fresh(docs, "_idx")
    df = compute_once(docs, **{idx: F.array_distinct(F.transform(_terms(text), _bucket))})
    tokens = F.size(_words(text)).cast("bigint").alias("tokens")
    if model is None:
        p = F.array(*[F.lit(float(w)) for _, _, w in domains])
        return df.withColumn(out, F.struct(tokens, p.alias("p"))).drop(idx)

    fitted = model.first()   # BUCKETS numbers by domain; a constant of the plan
    weights = [[round(x, 9) for x in w] for w in fitted.weights]
    tells = F.from_json(F.lit(json.dumps([any(w) for w in zip(*weights)])), "array<boolean>")
    df = compute_once(df, **{out + "_d": F.filter(idx, lambda i: F.get(tells, i)), out + "_k": F.size(idx), out + "_n": tokens}).drop(idx)

    def score(k: int) -> Column:
        by_bucket = F.from_json(F.lit(json.dumps(weights[k])), "array<double>")
        return (F.lit(math.log(fitted.priors[k])) - F.col(out + "_k") * F.lit(fitted.masses[k])
                + F.aggregate(out + "_d", F.lit(0.0), lambda a, i: a + F.get(by_bucket, i)))

    s = fresh(docs, "_score")
    df = compute_once(df, **{s: F.array(*[score(k) for k in range(len(domains))])}).drop(out + "_d", out + "_k")
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    df = compute_once(df, **{out + "_e": e}).drop(s)
    z = F.aggregate(out + "_e", F.lit(0.0), lambda a, x: a + x)
    return (df.withColumn(out, F.struct(F.col(out + "_n").alias("tokens"), F.transform(out + "_e", lambda x: x / z).alias("p")))
              .drop(out + "_n", out + "_e"))


class Fit(NamedTuple):
    """Gradient steps (a number per domain, and the momentum behind them), the
    share of all tokens by which each domain then misses its target, and
    whether the fit came to rest."""
    steps: list[list[float]]
    error: list[float]
    rested: bool


def _after(start: Column, p: Column, steps: list[list[float]]) -> Column:
    """r (the rate), y (where the next step starts) and moved (how far the last
    step moved the rate) of a document with posteriors ``p``, from ``start`` on.
    The numbers are the argument of a function and no part of its code, which
    is the same whatever they are."""
    def step(s: Column, h: Column) -> Column:
        back = reduce(add, [p[k] * h[k] for k in range(len(steps[0]) - 1)])
        return F.transform(F.array(F.greatest(F.lit(0.0), s["y"] - back)), lambda n: F.struct(
            n.alias("r"), (n + (n - s["r"]) * F.element_at(h, -1)).alias("y"), F.abs(n - s["y"]).alias("moved")))[0]

    return F.aggregate(F.array(*[F.array(*map(F.lit, h)) for h in steps]), start, step)


def _stepped(df: DataFrame, steps: list[list[float]]) -> DataFrame:
    """``df`` (tokens, p, r, y) after ``steps``, and the column moved."""
    none = F.lit(None).cast("double").alias("moved")
    if not steps:
        return df.withColumn("moved", none)
    return df.select("tokens", "p", _after(F.struct("r", "y", none), F.col("p"), steps).alias("s")).select("tokens", "p", "s.*")


def rate(p: Column, fit: Fit) -> Column:
    """The rate of a document with posteriors ``p``: 1, moved by every step and
    each time cut at 0."""
    if not fit.steps:
        return F.lit(1.0)
    one = F.lit(1.0)
    return _after(F.struct(one.alias("r"), one.alias("y"), F.lit(None).cast("double").alias("moved")), p, fit.steps)["r"]


def fit_rates(rows: DataFrame, domains=DOMAINS, rounds: int = ROUNDS) -> Fit:
    """Projected-gradient least squares over ``rows`` (tokens, p), a stored
    table: nonnegative rates whose expected tokens per domain come closest to
    the targets, errors being weighed by the larger of a domain's share and its
    target. Rates start at 1 and are projected to 0 and more in every step;
    steps are weighted by tokens, have the length that the curvature allows,
    and gain speed (momentum, anew where the error grows).

    Ends when the targets are met or the rates have come to rest; targets that
    no rates can meet (a domain with hardly any tokens) leave an error, which
    is returned and logged, as is a fit that ``rounds`` ended."""
    k = range(len(domains))
    none = Fit([], [0.0 for _ in k], True)
    gram = rows.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]) for i in k for j in k]).first()
    total = float(gram[0] or 0)
    if not total:
        return none
    gram = [[float(gram[1 + i * len(domains) + j]) / total for j in k] for i in k]
    weight = sum(w for _, _, w in domains)
    target = [w / weight for _, _, w in domains]
    scale = [1 / max(sum(gram[i]), target[i], 1e-12) for i in k]
    curvature = max(sum(gram[i][j] * scale[j] for j in k) for i in k)     # no eigenvalue is larger
    cur = rows.select("tokens", "p", F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    steps, pending, speed, last, error, rested = [], [], 0, None, None, False
    for _ in range(rounds + 1):
        now = _stepped(cur, pending)
        sums = now.agg(*[F.sum(F.col("tokens") * F.col("p")[i] * F.col("y")) for i in k],
                       *[F.sum(F.col("tokens") * F.col("p")[i] * F.col("r")) for i in k], F.sum(F.col("tokens") * F.col("moved"))).first()
        ahead = [float(sums[i]) / total - target[i] for i in k]
        error = [float(sums[len(domains) + i]) / total - target[i] for i in k]
        if max(map(abs, error)) < TOLERANCE or (steps and float(sums[-1]) / total < TOLERANCE):
            rested = True
            break
        if len(steps) == rounds:
            break
        size = sum(x * x * s for x, s in zip(ahead, scale))
        speed = 1 if last is not None and size > last else speed + 1
        last = size
        step = [x * s / curvature for x, s in zip(ahead, scale)] + [(speed - 1) / (speed + 2)]
        steps.append(step)
        pending.append(step)
        if len(pending) > STORED_STEPS:
            cur = saved(_stepped(cur, pending[:-1]).select("tokens", "p", "r", "y"), "rates")
            pending = pending[-1:]
    missed = {name: round(e, 6) for (name, _, _), e in zip(domains, error) if abs(e) >= 10 * TOLERANCE}
    if missed or not rested:
        logging.getLogger(__name__).warning("mixing rates after %d steps%s: targets missed by %s of all tokens",
                                            len(steps), "" if rested else " (not at rest)", missed)
    return Fit(steps, error, rested)


def mixing_rates(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 domains=DOMAINS) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain> for each domain, and
    rate, the expected number of copies in the mixture. Null and empty texts
    have no tokens and the priors as posteriors; repeated rows and copies get
    equal rates; null ids are kept; without labelled texts the posteriors are
    the target weights and the rates 1."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # only the numbers are stored
    model = fit_classifier(d, labels, "doc_id", "text", domains)
    rows = saved(with_posteriors(d, model, "text", "_m", domains).select("doc_id", "_m.*"), "posteriors")
    fit = fit_rates(rows, domains)
    return rows.select("doc_id", F.col("tokens").alias("n_tokens"),
                       *[F.col("p")[i].alias(f"p_{name}") for i, (name, _, _) in enumerate(domains)],
                       rate(F.col("p"), fit).alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", domains=DOMAINS) -> DataFrame:
    """The documents that the mixture draws, with the column ``rate`` (named so
    that it does not clash): how often each is to be drawn. Documents of rate 0
    are left out, for they would never be drawn; a reader draws each of the
    others ``rate`` times on average, and then the expected tokens of the
    domains meet the target weights. Rows alike are judged alike; null and
    empty texts have the priors as posteriors and stay."""
    out = "_mix"
    while any(fresh(docs, out + x) != out + x for x in ("", "_n", "_d", "_k", "_e")):
        out = "_" + out
    model = fit_classifier(docs, labels, doc_id, text, domains)
    rows = saved(with_posteriors(docs, model, text, out, domains), "posteriors")
    fit = fit_rates(rows.select(f"{out}.tokens", f"{out}.p"), domains)
    name = fresh(docs, "rate")
    return compute_once(rows, **{name: rate(F.col(out)["p"], fit)}).where((F.col(name) > 0) | (F.col(out)["tokens"] == 0)).drop(out)
