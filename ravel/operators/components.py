"""Connected components of a graph given as a table of links.

The number of rounds grows with the logarithm of the diameter. Every round is
one write to the shared scratch folder, which cuts the lineage, survives lost
executors and counts what it writes, so no second job looks for changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import scratch_path


def _stored(links: DataFrame) -> tuple[DataFrame, tuple]:
    """``links`` (u, v) written and read again, and a mark that changes with
    its rows: their number and the sum of their hashes."""
    spark, path, seen = links.sparkSession, scratch_path(links.sparkSession, "components"), Observation()
    links.observe(seen, F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    found = seen.get
    return spark.read.schema(links.schema).parquet(path), (found["n"], found["h"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of ``edges`` that has a link, with
    component = the smallest id reachable. A link of an id with itself, or with
    null, counts for nothing.

    Alternates large-star and small-star steps (each node points its larger,
    then its smaller, neighbours at the smallest one) until the links stop
    changing. Minima are combined map-side, so a node with very many links is
    no burden for one task."""
    cur, mark = _stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                             .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct())
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, (cur, mark) = mark, _stored(small)
        if mark == before:
            break
    comp = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return comp.unionByName(comp.select(F.col("component").alias("id"), "component").distinct())


def extended_components(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``labels`` (id, component) of some links, after more links: only the
    components that the new links join are worked on."""
    of = {c: labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in (a, b)}
    joined = (edges.select(a, b).join(of[a], a, "left").join(of[b], b, "left")
                   .select(F.coalesce(f"_{a}", a).alias(a), F.coalesce(f"_{b}", b).alias(b)))
    more = connected_components(joined, a, b)
    known = (labels.join(more.select(F.col("id").alias("component"), F.col("component").alias("_now")), "component", "left")
                   .select("id", F.coalesce("_now", "component").alias("component")))
    return known.unionByName(more.join(labels.select("id"), "id", "left_anti"))
