"""URL filters by a path-template tree, in DataFrame functions only.

Per host, the tree of path segments is generalised level by level down to its
last: digits become a wildcard within a segment, segments with few pages and
without labels that tell become the wildcard ``*``, and named branches with
like statistics (share of labelled bad pages, share of paths that end there)
are merged. A path's generalised segments are its
template; templates whose labelled pages are bad by a share smoothed towards the nodes above and the same paths on other hosts
are rejected, so a template without labels can be too.

Rules decide first, the template where no rule fits. Unless other labels are
given, the pages that rules decide are the labels."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import compute_once
from .common import LOWER, UPPER, saved

# The rules, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))

LEAST_PAGES = 5             # pages that give a branch a name; a node with less is not split
LEAST_LABELS = 5            # labelled pages for a branch to be judged by its bad share
LIKE = 1.64                 # standard errors (and one page) by which a branch's labels differ from the rest of its node
BAD_EDGES = (0.2, 0.5, 0.8, 0.95)   # branches with bad shares in one band are alike; REJECT is an edge
LEAF_EDGES = (0.05, 0.5, 0.95)      # and those with shares of ending paths in one band
ENOUGH_ELSEWHERE = 0.5      # weight of other hosts (as many as PRIOR_PAGES) that places a branch with few labels
MOST_NAMES = 25             # names written out in a merged branch's label
PRIOR_PAGES = 5.0           # labelled pages a template is taken to have beforehand
REJECT = 0.8
SHAPE = ("host", "segs", "n", "good", "bad", "weight", "alike")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Both
    empty for null and where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """The generalised segments of a path."""
    return F.array_remove(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), "")


def _band(share: Column, edges: tuple) -> Column:
    """The number of ``edges`` reached; null for null."""
    return sum((share >= e).cast("int") for e in edges[1:]) + (share >= edges[0]).cast("int")


def _groups(kids: DataFrame, node: DataFrame) -> DataFrame:
    """``kids`` (host, template, seg, n, good, bad, weight, alike, leaf: one row per branch of
    a node) plus ``grp``, the branches of a node that become one: ``*`` for those
    without a name. A branch is named by its own counts, however small its
    share of the node is: by its pages, or if its labelled pages differ from
    the rest of the node by more than chance. Named branches with like
    statistics go together; one with few labels goes by the bad share of its paths
    on other hosts, or else to the labelled ones that end as often, if those
    agree in their bad share."""
    kids = kids.join(node.select("host", "template", "node_good", "node_bad"), ["host", "template"])
    known = F.col("good") + F.col("bad")
    rest = F.col("node_good") + F.col("node_bad") - known
    share = (F.col("node_bad") - F.col("bad") + 0.5) / (rest + 1)
    differs = (rest > 0) & (F.abs(F.col("bad") - known * share) > F.sqrt(known * share * (1 - share) + 1) * LIKE)
    named = (F.col("n") >= LEAST_PAGES) | differs
    elsewhere = F.when((F.col("n") > 0) & (F.col("weight") >= F.col("n") * ENOUGH_ELSEWHERE), F.col("alike") / F.col("weight"))
    kids = kids.select("host", "template", "seg", "n", "good", "bad", _band(elsewhere, BAD_EDGES).alias("elsewhere"), named.alias("named"), (known >= LEAST_LABELS).alias("tested"),
                       _band(F.col("leaf") / F.col("n"), LEAF_EDGES).alias("ends"),
                       _band(F.col("bad") / F.greatest(known, F.lit(1)), BAD_EDGES).alias("badness"))
    agreed = (kids.where("named AND tested").groupBy("host", "template", "ends")
                  .agg(F.min("badness").alias("agreed"), F.max("badness").alias("most")).where("agreed = most").drop("most"))
    kids = kids.join(agreed, ["host", "template", "ends"], "left")
    badness = F.coalesce(F.when(F.col("tested"), F.col("badness")), F.col("elsewhere"), F.col("agreed"), F.lit(-1))
    return kids.withColumn("grp", F.when(F.col("named"), F.concat_ws(":", "ends", badness)).otherwise("*"))


def _labels(kids: DataFrame) -> DataFrame:
    """(host, template, grp, label, grp_good, grp_bad) of the groups: the names of the branches,
    or the first and last and the number of those between where they are many."""
    keys = ["host", "template", "grp"]
    groups = saved(kids.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("seg").alias("low"), F.max("seg").alias("high"),
                                            F.sum("good").alias("grp_good"), F.sum("bad").alias("grp_bad")), "groups")
    few = groups.where(F.col("grp") != "*").where(F.col("size").between(3, MOST_NAMES)).select(*keys)
    lists = kids.join(few, keys).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("seg")), "|").alias("names"))
    names = F.coalesce("names", F.when(F.col("size") == 2, F.concat_ws("|", "low", "high")).otherwise(
        F.concat("low", F.lit("|+"), F.col("size") - 2, F.lit("|"), "high")))
    label = (F.when(F.col("grp") == "*", "*").when(F.col("size") == 1, F.col("low"))
              .otherwise(F.concat(F.lit("("), names, F.lit(")"))))
    return groups.join(lists, keys, "left").select(*keys, label.alias("label"), "grp_good", "grp_bad")


def _smoothed(bad: Column, known: Column, towards: Column) -> Column:
    return (bad + towards * PRIOR_PAGES) / (known + PRIOR_PAGES)


def with_path_evidence(shapes: DataFrame, prior: float) -> DataFrame:
    """``shapes`` (host, segs, n, good, bad: one row per generalised path of a
    host) plus what other hosts say of the path: ``weight``, n by how far their
    number goes, and ``alike``, weight times the smoothed mean of their bad
    shares. Every host with labels on a path counts once, so that no single
    host decides over the others."""
    known = F.col("good") + F.col("bad")
    share = F.when(known > 0, F.col("bad") / F.greatest(known, F.lit(1)))
    paths = shapes.groupBy("segs").agg(F.count(share).alias("hosts"), F.sum(share).alias("shares"))
    rows = shapes.join(paths, "segs")
    others = F.col("hosts") - F.when(share.isNull(), 0).otherwise(1)
    mean = _smoothed(F.coalesce("shares", F.lit(0.0)) - F.coalesce(share, F.lit(0.0)), others, F.lit(prior))
    weight = F.col("n") * others / (others + PRIOR_PAGES)
    return rows.select(*shapes.columns, weight.alias("weight"), (weight * mean).alias("alike"))


def template_tree(shapes: DataFrame, prior: float = 0.0) -> DataFrame:
    """``shapes`` (one row per generalised path of a host, with its evidence) plus ``template`` and ``above``, the smoothed bad share of the nodes
    over it: each node's, without the labels of the branch the template is in,
    is smoothed towards that of the node above, so no label counts twice. Level
    by level until no node has branches: a node with one path left keeps its
    tail, one with less than LEAST_PAGES pages is not split by names."""
    df, done, k = shapes.withColumn("template", F.lit("")).withColumn("above", F.lit(float(prior))), [], 0
    while True:
        more = F.size("segs") > k
        node = saved(df.groupBy("host", "template").agg(
            F.sum("n").alias("node_n"), F.sum("good").alias("node_good"), F.sum("bad").alias("node_bad"),
            F.count_if(more).alias("paths"), F.max("above").alias("above")), "nodes")
        if node.where("paths > 0").isEmpty():
            return functools.reduce(DataFrame.unionByName, done, df)
        tail = F.slice("segs", F.lit(k + 1), F.greatest(F.size("segs") - k, F.lit(0)))
        tail = F.when(F.col("paths") > 1, F.transform(tail, lambda _: F.lit("*"))).otherwise(tail)
        ended = ~more | (F.col("paths") == 1) | (F.col("node_n") < LEAST_PAGES)
        at = df.join(node.drop("above"), ["host", "template"])
        # a last path has the paths that end at its node over it
        own = F.col("good") + F.col("bad")
        here = _smoothed(F.col("node_bad") - F.col("bad"), F.col("node_good") + F.col("node_bad") - own, F.col("above"))
        above = F.when(more & (F.col("paths") == 1), here).otherwise(F.col("above"))
        at = saved(at.select(*SHAPE, "template", ended.alias("ended"), above.alias("above"),
                             F.concat("template", F.array_join(F.transform(tail, lambda x: F.concat(F.lit("/"), x)), "")).alias("whole")),
                   "tree")
        done.append(at.where("ended").select(*SHAPE, F.col("whole").alias("template"), "above"))
        at = at.where("NOT ended").drop("ended", "whole", "above").withColumn("seg", F.get("segs", F.lit(k)))
        kids = saved(_groups(at.groupBy("host", "template", "seg").agg(
            F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("weight").alias("weight"), F.sum("alike").alias("alike"),
            F.sum(F.when(F.size("segs") == k + 1, F.col("n")).otherwise(0)).alias("leaf")), node), "branches")
        to = kids.select("host", "template", "seg", "grp").join(_labels(kids), ["host", "template", "grp"]).drop("grp")
        to = to.join(node, ["host", "template"])
        rest_bad, rest_good = F.col("node_bad") - F.col("grp_bad"), F.col("node_good") - F.col("grp_good")
        to = to.select("host", "template", "seg", "label", _smoothed(rest_bad, rest_bad + rest_good, F.col("above")).alias("above"))
        df = saved(at.join(to, ["host", "template", "seg"]).select(
            *SHAPE, F.concat("template", F.lit("/"), "label").alias("template"), "above"), "tree")
        k += 1


def purities(tree: DataFrame, prior: float) -> DataFrame:
    """(host, segs, template, purity): the bad share of a template's labelled
    pages, smoothed towards that of the nodes over it and of the same
    generalised paths on other hosts, each by the evidence behind it."""
    known = F.col("good") + F.col("bad")
    hosts = tree.groupBy("host").agg(F.sum(known).alias("host_known"))
    judged = (tree.groupBy("host", "template")
                  .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(known).alias("known"), F.max("above").alias("above"),
                       F.sum("weight").alias("weight"), F.sum("alike").alias("alike")).join(hosts, "host"))
    judged = judged.withColumn("rest", F.col("host_known") - F.col("known")).withColumn(
        "over", F.col("rest") / (F.col("rest") + PRIOR_PAGES))
    evidence = F.col("over") + F.col("weight") / F.col("n")
    towards = F.when(evidence > 0, (F.col("over") * F.col("above") + F.col("alike") / F.col("n"))
                     / F.when(evidence > 0, evidence)).otherwise(prior)
    judged = judged.select("host", "template", _smoothed(F.col("bad"), F.col("known"), towards).alias("purity"))
    return tree.select("host", "segs", "template").join(judged, ["host", "template"])


def url_verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES,
                 labels: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity
    (smoothed share of bad pages among the template's labelled ones, for few or no
    labels that of the nodes over it and of the same paths on other hosts).

    ``labels`` (page_id, bad) takes the place of the rules' verdicts as labels
    where it is given. Null urls, and those without ``://``, have empty host
    and path and share one template. Repeated rows are judged alike and count
    each; null ids are kept. Without any label nothing but rules blocks."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_u"))
    host, path = host_and_path(F.col("_u"))
    p = compute_once(p, host=host, path=path).drop("_u")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("_rv", verdict)
    if labels is None:
        p = p.withColumn("_bad", F.when(F.col("_rv").isNotNull(), F.col("_rv") == "block"))
    else:
        known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("boolean")).alias("_bad"))
        p = p.join(known, "page_id", "left")
    p = p.withColumn("segs", _segments(F.col("path")))
    keys = ["host", "segs"]
    shapes = saved(p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_bad")).alias("good"), F.count_if("_bad").alias("bad")), "shapes")
    seen = shapes.agg(F.sum("bad"), F.sum("good")).first()
    bad, good = (int(x or 0) for x in seen)
    prior = bad / (bad + good) if bad + good else 0.0
    tree = purities(template_tree(saved(with_path_evidence(shapes, prior), "shapes"), prior), prior)
    out = p.join(tree, keys)
    by_template = F.when((F.col("purity") >= REJECT) & F.lit(bad > 0), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_rv", by_template).alias("verdict"), "template", "purity")
