"""Features the reference names but does not compute."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import JS_SPACE, col_, js_trim
from .common import as_of_lit, compute_once, stored, trailing_window
from .components import connected_components, extended_components

BLOCK = 1024    # members of a near-duplicate bucket on one side of a block


def normalized_text(c) -> Column:
    """Lower case, white-space runs → one space, trimmed."""
    return F.lower(js_trim(F.regexp_replace(col_(c), JS_SPACE + "+", " ")))


def dedupe_comments(df: DataFrame, text: str = "review_comment", id_col: str = "example_id") -> DataFrame:
    """E1 (exact part): keep the first example (lowest id) of each normalised
    text. One aggregate per text hash carries the winning row (``min_by`` of
    the row struct), so the input is read once and a very common text is
    reduced map-side instead of forming one hot group."""
    cols = df.columns
    h = df.withColumn("_h", F.md5(normalized_text(text)))
    win = h.groupBy("_h").agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(id_col)).alias("_r"))
    return win.select("_r.*")


def min_reactions_filter(df: DataFrame, n: int = 1) -> DataFrame:
    """The collector's unused --min-reactions option."""
    return df.where(F.col("reactions") >= F.lit(int(n)))


def period_over_period(reviews: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Reviews and mean score in the last ``days`` vs the ``days`` before,
    with percent change (null when the earlier period is empty)."""
    a = as_of_lit(reviews, "created_at", as_of)
    t = F.col("created_at")
    cur = (t > a - F.make_dt_interval(days=F.lit(days))) & (t <= a)
    prev = (t > a - F.make_dt_interval(days=F.lit(2 * days))) & (t <= a - F.make_dt_interval(days=F.lit(days)))
    r = reviews.where(t > a - F.make_dt_interval(days=F.lit(2 * days)))
    out = r.agg(F.count_if(cur).alias("reviews_current"), F.count_if(prev).alias("reviews_previous"),
                F.avg(F.when(cur, F.col("overall_score"))).alias("score_current"),
                F.avg(F.when(prev, F.col("overall_score"))).alias("score_previous"))
    return out.withColumn("reviews_change_pct", F.round(F.try_divide(
        (F.col("reviews_current") - F.col("reviews_previous")) * 100.0, F.col("reviews_previous")), 1))


def module_hotspots(reviews: DataFrame, comments: DataFrame, as_of: str, days: int = 14, k: int = 10) -> DataFrame:
    """E5: comments per directory and category over the last ``days``, top ``k``."""
    r = trailing_window(reviews, "created_at", as_of, days).select(F.col("id").alias("review_id"))
    c = comments.join(r, "review_id", "left_semi")
    mod = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    return (c.groupBy(mod.alias("module"), "category").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("n").desc(), "module", "category").limit(k))


def pattern_change_rate(reviews: DataFrame, comments: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per (title, category) occurrences in the last ``days`` and the
    ``days`` before, and the percent change (null without an earlier count)."""
    a = as_of_lit(reviews, "created_at", as_of)
    t = F.col("created_at")
    r = reviews.where(t > a - F.make_dt_interval(days=F.lit(2 * days))).where(t <= a).select(
        F.col("id").alias("review_id"),
        (t > a - F.make_dt_interval(days=F.lit(days))).alias("_cur"))
    c = comments.select("review_id", "title", "category").join(r, "review_id")
    g = c.groupBy("title", "category").agg(F.count_if("_cur").alias("current"), F.count_if(~F.col("_cur")).alias("previous"))
    return g.withColumn("change_pct", F.round(F.try_divide((F.col("current") - F.col("previous")) * 100.0,
                                                           F.col("previous")), 1))


def size_bucket(n: Column) -> Column:
    return F.when(n <= 2, "small").when(n <= 5, "medium").otherwise("large")


def author_and_size_metrics(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """Review count and mean score rolled up by repo, author and PR size
    bucket (size = number of review comments)."""
    n = comments.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_comments"))
    r = reviews.join(n, reviews.id == n.review_id, "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0)))
    return (r.rollup("repo_full_name", "author_login", size_bucket(F.col("n_comments")).alias("size_bucket"))
             .agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("overall_score"), 3).alias("avg_score")))


def _sample_points(n: int) -> list[int]:
    """``n`` fixed 64-bit numbers, spread by a multiplicative generator."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 0x5851F42D4C957F2D + 0x14057B7EF767814F) % 2**64
        out.append((x ^ x >> 29) - 2**63)
    return out


def minhash_signatures(df: DataFrame, text: str, id_col: str, num_hashes: int = 64,
                       shingle: int = 5) -> DataFrame:
    """(id, sig): ``num_hashes`` MinHash values over the character
    ``shingle``-grams of the normalised text (a text shorter than a shingle is
    one gram, a null text has no signature).

    The text is held as code points of equal width, so a gram is cut out in
    constant time and the work is linear in the length. Each gram is hashed
    once; its place in the order of each sample is its distance (XOR) from a
    fixed point. Values are combined by generated code before any shuffle
    (ids are unique)."""
    base = compute_once(df.select(F.col(id_col).alias("id"), F.col(text).alias("_raw")), _t=normalized_text("_raw"))
    base = compute_once(base.where(F.col("_t").isNotNull()).select("id", "_t"), _b=F.encode("_t", "UTF-32"))
    last = F.greatest(F.length("_t") - int(shingle), F.lit(0))
    grams = base.select("id", "_b", F.explode(F.sequence(F.lit(0), last)).alias("_i")).select(
        "id", F.xxhash64(F.substring("_b", F.col("_i") * 4 + 1, F.lit(4 * int(shingle)))).alias("gram"))
    sig = grams.groupBy("id").agg(*[F.min(F.col("gram").bitwiseXOR(F.lit(c).cast("bigint"))).alias(f"_h{i}")
                                    for i, c in enumerate(_sample_points(num_hashes))])
    return sig.select("id", F.array(*[F.col(f"_h{i}") for i in range(num_hashes)]).alias("sig"))


def _block_links(least: int):
    """Links between members of different components in one block."""
    def compare(rows):
        import numpy as np
        import pyarrow as pa
        side, ids, label = (rows.column(c).to_numpy().copy() for c in ("side", "id", "label"))
        sig = np.array(rows.column("sig").combine_chunks().flatten()).reshape(len(ids), -1)
        out = []
        for x in np.flatnonzero(side != 1):
            far = (label != label[x]) & ((side == 1) | ((side == 2) & (ids > ids[x])))
            y = np.flatnonzero(far)
            for j in y[(sig[y] == sig[x]).sum(axis=1) >= least]:
                if label[j] != label[x]:
                    out.append((ids[x], ids[j]))
                    label[label == label[j]] = label[x]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return compare


def near_duplicate_clusters(df: DataFrame, text: str = "review_comment", id_col: str = "example_id",
                            bands: int = 16, rows_per_band: int = 4, min_similarity: float = 0.8) -> DataFrame:
    """E1 (near-duplicate part): cluster texts whose MinHash similarity is at
    least ``min_similarity``; returns (id, cluster_id) with cluster_id = the
    smallest id of the connected component.

    Texts with equal signatures are collapsed first. LSH banding puts the
    others in buckets; each member is linked to its bucket's smallest id if the
    two signatures agree on at least ``min_similarity`` of their positions. In
    buckets that then hold several components, members of different ones are
    compared in blocks of bounded size, so any two texts that share a bucket
    and agree end in one cluster. Components are found in rounds whose number
    grows with the logarithm of the longest chain; the links of the blocks only
    extend those found before."""
    k = bands * rows_per_band
    least = math.ceil(min_similarity * k)
    full = stored(minhash_signatures(df, text, id_col, k), "signatures")
    sig = stored(full.groupBy("sig").agg(F.min("id").alias("id")), "classes")
    keys = sig.select("id", F.posexplode(F.array(*[
        F.xxhash64(F.lit(b), F.slice("sig", b * rows_per_band + 1, rows_per_band)) for b in range(bands)]))
        .alias("band", "bucket"))
    one, two = sig.select("id", "sig"), sig.select(F.col("id").alias("head"), F.col("sig").alias("hsig"))
    agree = F.aggregate(F.zip_with("sig", "hsig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x)
    heads = keys.groupBy("band", "bucket").agg(F.min("id").alias("head"))      # combined map-side
    pairs = keys.join(heads, ["band", "bucket"]).where(F.col("id") != F.col("head")).select("id", "head").distinct()
    edges = (pairs.join(one, "id").join(two, "head").where(agree >= F.lit(least))
                  .select(F.col("id").alias("a"), F.col("head").alias("b")))
    labels = connected_components(edges)
    mine = stored(keys.join(labels.withColumnRenamed("component", "label"), "id", "left")
                      .withColumn("label", F.coalesce("label", "id")), "buckets")
    mixed = (mine.groupBy("band", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
                 .where("low < high").select("band", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    rows = mine.join(mixed, ["band", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # block (i, j) with i <= j holds part i as its left and part j as its right side; (i, i) holds it once
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(one, "id")
    rows = rows.select("band", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                       F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
                       F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "sig")
    across = rows.groupBy("band", "bucket", "i", "j").applyInArrow(_block_links(least), "a bigint, b bigint")
    labels = extended_components(labels, across)
    member = full.join(sig.select("sig", F.col("id").alias("rep")), "sig").select("id", "rep")
    return member.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        F.col("id").alias(id_col), F.coalesce("component", "rep").alias("cluster_id"))
