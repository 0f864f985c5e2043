"""Property and brute-force tests of the distributed operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ravel.operators import common as C
from ravel.operators import ingest as I
from ravel.operators import prompts as PR
from ravel.operators import quality as Q
from ravel.operators import reviews as RV
from ravel.operators import training as TR
from ravel.sources import views as V
from ravel.streaming import rate as RT

SF = "/root/testdata/sf0.001"


def test_score_bounds_and_histogram(spark):
    s = Q.score_examples(V.raw_examples(spark, SF))
    lo, hi, n = s.agg(F.min("quality_score"), F.max("quality_score"), F.count(F.lit(1))).first()
    assert 0.0 <= lo <= hi <= 1.0
    assert sum(r.n for r in Q.score_histogram(s).collect()) == n


def test_exact_split_sizes(spark):
    k = Q.threshold_filter(Q.score_examples(V.raw_examples(spark, SF)), 0.0)
    sp = TR.exact_split(k, "example_id", 0.9)
    n = k.count()
    c = {r.split: r.n for r in sp.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert c.get("train", 0) == int(n * 0.9) and c.get("train", 0) + c.get("eval", 0) == n
    pos = sorted(r.pos for r in sp.select("pos").collect())
    assert pos == list(range(1, n + 1))


def test_global_position_matches_sort(spark):
    df = spark.range(0, 3000).withColumn("k", F.md5(F.col("id").cast("string")))
    got = {r.id: r.pos for r in C.global_position(df, F.col("k"), [F.col("id")], prefix_len=2).collect()}
    expect = sorted(range(3000), key=lambda i: (df.where(F.col("id") == i).first().k if False else None, i))
    rows = sorted(df.collect(), key=lambda r: (r.k, r.id))
    assert [got[r.id] for r in rows] == list(range(1, 3001))
    del expect


def test_top_n_per_group_hot_key(spark):
    random.seed(1)
    data = [(0 if i % 3 else i % 7, i, random.randint(0, 50)) for i in range(2000)]  # group 0 is hot
    df = spark.createDataFrame(data, "g long, id long, v long")
    got = C.top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5)
    got = sorted((r.g, r.rn, r.id) for r in got.collect())
    expect = []
    for g in {d[0] for d in data}:
        rs = sorted([d for d in data if d[0] == g], key=lambda d: (-d[2], d[1]))[:5]
        expect += [(g, i + 1, d[1]) for i, d in enumerate(rs)]
    assert got == sorted(expect)


def test_upsert_twice_is_once(spark):
    r = V.reviews(spark, SF)
    once = RV.upsert_reviews(None, r)
    twice = RV.upsert_reviews(once, r)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_upsert_first_values_last_score(spark):
    old = spark.createDataFrame([(1, "a", 1, "s", "t1", 10)], "id long, repo_full_name string, pr_number int, head_sha string, pr_title string, overall_score long")
    new = spark.createDataFrame([(2, "a", 1, "s", "t2", 20), (3, "a", 1, "s", "t3", 30)], old.schema)
    r = RV.upsert_reviews(old, new).first()
    assert (r.id, r.pr_title, r.overall_score) == (1, "t1", 30)


def _brute_recent(jobs, files, reviews, comments, days=30, limit=20):
    out = {}
    rev = {r[0]: r for r in reviews}
    for pr_id, repo, t in jobs:
        paths = {f[1] for f in files if f[0] == pr_id}
        cand = [(rev[c[1]][2], c[0]) for c in comments
                if c[2] in paths and rev[c[1]][1] == repo and t - dt.timedelta(days=days) < rev[c[1]][2] < t]
        out[pr_id] = [cid for _, cid in sorted(cand, key=lambda x: (-x[0].timestamp(), x[1]))[:limit]]
    return out


def test_recent_issue_context_brute_force(spark):
    random.seed(7)
    base = dt.datetime(2024, 1, 1)
    reviews = [(i, "r" + str(i % 2), base + dt.timedelta(days=random.randint(0, 60))) for i in range(60)]
    comments = [(1000 + i, random.randint(0, 59), random.choice(["hot.py", "hot.py", "hot.py", "a.py", "b.py"]))
                for i in range(900)]      # a hot path with many comments at equal times
    jobs = [(j, "r" + str(j % 2), base + dt.timedelta(days=random.randint(0, 70))) for j in range(25)]
    files = [(j, p) for j in range(25) for p in random.sample(["hot.py", "a.py", "b.py", "c.py"], 2)]
    J = spark.createDataFrame(jobs, "pr_id long, repo_full_name string, created_at timestamp_ntz")
    Fi = spark.createDataFrame(files, "pr_id long, filename string")
    R = spark.createDataFrame(reviews, "id long, repo_full_name string, created_at timestamp_ntz")
    Cm = spark.createDataFrame([(c, r, p, "cat", "s") for c, r, p in comments],
                               "id long, review_id long, file_path string, category string, suggestion string")
    got = {}
    for row in PR.recent_issue_context(J, Fi, R, Cm).collect():
        got.setdefault(row.pr_id, []).append((row.rank, row.comment_id))
    got = {k: [c for _, c in sorted(v)] for k, v in got.items()}
    expect = {k: v for k, v in _brute_recent(jobs, files, reviews, comments).items() if v}
    assert got == expect


def _brute_rate(reqs, window_s, limit):
    out = {}
    by = {}
    for eid, key, t in sorted(reqs, key=lambda r: (r[1], r[2], r[0])):
        by.setdefault(key, []).append((eid, t))
    for key, lst in by.items():
        end, count = None, 0
        for eid, t in lst:
            if end is None or t > end:
                end, count = t + dt.timedelta(seconds=window_s), 1
            else:
                count += 1
            out[eid] = (count, count > limit)
    return out


def test_rate_windows_brute_force(spark):
    random.seed(3)
    base = dt.datetime(2024, 1, 1)
    reqs = [(i, "hot" if i % 2 else f"k{i % 5}", base + dt.timedelta(seconds=random.randint(0, 3000)))
            for i in range(1500)]
    df = spark.createDataFrame(reqs, "event_id long, client_key string, ts timestamp_ntz")
    got = {r.event_id: (r.window_count, r.flagged) for r in RT.rate_window_flags(df, 60, 5).collect()}
    assert got == _brute_rate(reqs, 60, 5)
    # a request exactly at the window end stays in the old window
    edge = spark.createDataFrame([(1, "k", base), (2, "k", base + dt.timedelta(seconds=60)),
                                  (3, "k", base + dt.timedelta(seconds=61))], df.schema)
    assert [(r.event_id, r.window_count) for r in RT.rate_window_flags(edge, 60, 1).orderBy("event_id").collect()] == \
        [(1, 1), (2, 2), (3, 1)]


def test_provider_registry(spark):
    ev = spark.createDataFrame(
        [(1, "github", "pull_request", "opened", "o/r", 1, None, "u"), (2, "gitlab", "Merge Request Hook", "open", "g/r", 2, "d", "v"),
         (3, "bitbucket", "x", "y", "b/r", 3, None, "w"), (4, None, "pull_request", "opened", "o/r", 4, None, "u"),
         (5, "github", "pull_request", "closed", "o/r", 5, None, "u")],
        "event_id long, provider string, event_name string, action string, repo_full_name string, pr_number int, body string, author_login string")
    jobs, q = I.normalize_by_provider(ev)
    assert sorted((r.event_id, r.provider, r.pr_body) for r in jobs.collect()) == [(1, "github", ""), (2, "gitlab", "d")]
    assert sorted((r.event_id, r.reason) for r in q.collect()) == [
        (3, "Unknown VCS provider: bitbucket"), (4, "Unknown VCS provider: undefined")]


def test_diff_stats(spark):
    df = spark.createDataFrame([("@@ -1 +1 @@\n-old\n+new\n+more",)], "d string")
    a, d, c = I.diff_stats("d")
    assert tuple(df.select(a, d, c).first()) == (2, 1, 4)


def test_near_duplicate_clusters(spark):
    from ravel.operators import extras as X
    base = "The cache lookup in this function runs a query per item; consider batching the index reads instead."
    rows = [(1, base), (2, base.replace("per item", "per itemx")), (3, base + " Thanks."),
            (4, "Completely different text about naming things well and tests."),
            (5, "Completely different text about naming things well and tests!"), (6, "short"), (7, "x" * 40)]
    df = spark.createDataFrame(rows, "example_id long, review_comment string")
    got = sorted(tuple(r) for r in X.near_duplicate_clusters(df).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]


def test_template_headers_fold_case_beyond_ascii(spark):
    from ravel.operators import templates as TP
    req = TP.template_requirements(spark.createDataFrame([("r", "## écran\n")], "repo string, content string"))
    prs = spark.createDataFrame([(1, "r", "## Écran\nall of it is described here"), (2, "r", "nothing of that kind is described")],
                                "pr_id long, repo string, body string")
    got = {r.pr_id: len(r.violations) for r in TP.template_violations(prs, req).collect()}
    assert got == {1: 0, 2: 1}


def test_window_ends_at_as_of(spark):
    from ravel.operators.common import trailing_window
    df = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2020-01-20')) AS d").selectExpr("CAST(d AS timestamp) AS t")
    got = [r.t.day for r in trailing_window(df, "t", "2020-01-10", 3).orderBy("t").collect()]
    assert got == [8, 9, 10]


def test_chain_of_near_duplicates_is_one_cluster(spark):
    """A chain longer than any fixed number of propagation rounds."""
    from ravel.operators import extras as X
    word = "abcdefghijklmnopqrstuvwxyz"
    base = " ".join(f"{word[i % 26]}{i}" for i in range(120))
    parts = base.split()
    rows = [(k, " ".join(f"{w}z" if i < 2 * k else w for i, w in enumerate(parts))) for k in range(45)]
    df = spark.createDataFrame(rows, "example_id long, review_comment string")
    assert {r.cluster_id for r in X.near_duplicate_clusters(df).collect()} == {0}


def test_star_of_near_duplicates_with_a_large_centre_is_one_cluster(spark, monkeypatch):
    """40 signatures that agree with the centre's in 52 of 64 places and with each other's in at most 48."""
    from itertools import combinations
    from ravel.operators import extras as X
    changed = list(combinations(range(16), 3))[::14]
    rows = [(k, [100 + k if p // 4 in bands else p for p in range(64)]) for k, bands in enumerate(changed)]
    rows += [(1000, list(range(64))), (2000, [-p for p in range(1, 65)])]
    df = spark.createDataFrame(rows, "id long, sig array<long>")
    monkeypatch.setattr(X, "minhash_signatures", lambda *_: df)
    for block in (1024, 5):
        monkeypatch.setattr(X, "BLOCK", block, raising=False)
        got = {r.id: r.cluster_id for r in X.near_duplicate_clusters(df, "sig", "id").collect()}
        assert got == {i: 2000 if i == 2000 else 0 for i, _ in rows}


def test_scratch_folder_must_be_shared_on_a_cluster():
    import pytest
    from ravel.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Session:   # a cluster session without the setting
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
