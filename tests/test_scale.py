"""What grows with the input: how much a step passes on, checked on small rows
of the shape that made it grow faster."""

import datetime as dt
import random
import time
from functools import reduce

from pyspark.sql import functions as F

from ravel.functions import patterns as P
from ravel.functions import text as T
from ravel.operators import evaluation as E
from ravel.operators import prompts as PR
from ravel.operators import quality as Q
from ravel.operators import reviews as RV
from ravel.operators.common import stored
from ravel.streaming import store as ST

BASE = dt.datetime(2024, 3, 1)


def test_issue_context_passes_on_little_more_than_the_answer(spark, monkeypatch):
    paths, each = 40, 20
    jobs = spark.createDataFrame([(1, "r", BASE)], "pr_id bigint, repo_full_name string, created_at timestamp")
    files = spark.createDataFrame([(1, f"f{p}") for p in range(paths)], "pr_id bigint, filename string")
    made = [(i, i, f"f{i % paths}", BASE - dt.timedelta(minutes=i + 1)) for i in range(paths * each)]
    reviews = spark.createDataFrame([(r, "r", t) for r, _, _, t in made], "id bigint, repo_full_name string, created_at timestamp")
    comments = spark.createDataFrame([(c, r, p, "style", f"s{c}") for r, c, p, _ in made],
                                     "id bigint, review_id bigint, file_path string, category string, suggestion string")
    seen, top = [], PR.top_n_per_group

    def counted(df, *args, **kwargs):
        seen.append(df.count())
        return top(df, *args, **kwargs)

    monkeypatch.setattr(PR, "top_n_per_group", counted)
    got = [(r.rank, r.comment_id) for r in PR.recent_issue_context(jobs, files, reviews, comments).collect()]
    assert sorted(got) == [(i + 1, i) for i in range(20)]
    assert seen[-1] <= 2 * 20      # not every file's 20 comments


def _issue_tables(spark, jobs, files, made):
    """jobs (id, repo, t), files (job, path), made (comment, repo, path, t): a review for each comment."""
    J = spark.createDataFrame(jobs, "pr_id bigint, repo_full_name string, created_at timestamp")
    Fi = spark.createDataFrame(files, "pr_id bigint, filename string")
    R = spark.createDataFrame([(i, repo, t) for i, (_, repo, _, t) in enumerate(made)], "id bigint, repo_full_name string, created_at timestamp")
    C = spark.createDataFrame([(c, i, p, "style", f"s{c}") for i, (c, _, p, _) in enumerate(made)],
                              "id bigint, review_id bigint, file_path string, category string, suggestion string")
    return J, Fi, R, C


def test_issue_context_passes_on_little_where_every_file_has_many_comments(spark, monkeypatch):
    """Twenty files with thirty comments each, those of a file at one time: in a job's block, and in the one before."""
    for ago in (dt.timedelta(minutes=1), dt.timedelta(days=25)):
        made = [(100 * p + c, "r", f"f{p}", BASE - ago - dt.timedelta(minutes=p)) for p in range(20) for c in range(30)]
        tables = _issue_tables(spark, [(1, "r", BASE)], [(1, f"f{p}") for p in range(20)], made)
        seen, top = [], PR.top_n_per_group
        with monkeypatch.context() as m:
            m.setattr(PR, "top_n_per_group", lambda df, *a, **k: seen.append(df.count()) or top(df, *a, **k))
            got = [(r.rank, r.comment_id) for r in PR.recent_issue_context(*tables).collect()]
        assert sorted(got) == [(i + 1, i) for i in range(20)]
        assert seen[-1] <= 2 * 20      # not twenty of every file


def test_issue_context_keeps_only_comments_a_job_reaches(spark, monkeypatch):
    made = [(i, "r", "f", BASE - dt.timedelta(days=i)) for i in range(-50, 300)]
    kept, stored = {}, PR.stored
    monkeypatch.setattr(PR, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    got = PR.recent_issue_context(*_issue_tables(spark, [(1, "r", BASE)], [(1, "f")], made)).collect()
    assert sorted((r.rank, r.comment_id) for r in got) == [(i, i) for i in range(1, 21)]
    assert kept["placed"].where("issue").count() == 29


def test_issue_context_is_what_every_pair_gives(spark, monkeypatch):
    """Hot and cold files, many comments of one time, of one id or of none, over three blocks; jobs that come twice."""
    rnd = random.Random(11)
    for per_path, step, few in ((60, 1, PR.FEW_PATHS), (200, 24 * 20, 0)):
        at = lambda: BASE + dt.timedelta(hours=step * rnd.randrange(24 * 75 // step))  # noqa: B023, E731
        jobs = [(j % 30, f"r{j % 2}", at()) for j in range(34)]
        files = [(j, p) for j in range(30) for p in rnd.sample(["hot", *"abcdefghijklmnopqrstuvwxyz"], 12)]
        made = [(rnd.choice([None, 7, 1000 + i]), f"r{i % 2}", rnd.choice(["hot", "hot", "hot", *"abcdefgh"]), at()) for i in range(per_path * 10)]
        monkeypatch.setattr(PR, "FEW_PATHS", few)      # with 0, more paths than are broadcast
        got = {}
        for r in PR.recent_issue_context(*_issue_tables(spark, jobs, files, made)).collect():
            got.setdefault(r.pr_id, []).append((r["rank"], r.comment_at, r.comment_id, r.file_path))
        latest = {}
        for j, repo, t in jobs:
            latest[j, repo] = max(t, latest.get((j, repo), t))
        for j in range(30):
            want = [(t, c) for (k, repo), jt in latest.items() if k == j for c, r, p, t in made
                    if r == repo and (j, p) in files and jt - dt.timedelta(days=30) < t < jt]
            want.sort(key=lambda x: (-x[0].timestamp(), x[1] is not None, x[1] or 0))
            assert [(t, c) for _, t, c, _ in sorted(got.get(j, []), key=lambda x: x[0])] == want[:20]


def test_stored_leaves_no_shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for f in (str(x.getName()) for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folder.getAllFiles()))
                if f.startswith("shuffle_")}

    before = shuffles()
    kept = stored(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 10).alias("k")).count(), "grouped")
    time.sleep(2)      # no longer: the driver's garbage collection would remove them, too, some day
    assert not shuffles() - before
    assert kept.agg(F.sum("count")).first()[0] == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


WORD_TEXTS = ["", None, "FIXED it", "prefixed", "Good Catch!", "good  catch", "O(n)x", "O(n) x", "uses n+1 query", "on 1", "Line 12 here", "line x",
              "this CAN be", "this cannot", "you need to", "İ fix", "ſhould", "shoulD", "Key token", "résumé add", "add_on", "nit: a", "Nit", "nitpick　b",
              "LGTM.", "lgtm..", "looks good.", "looks good. x", "great job", "x lgtm", "typo", "typos", "`a` foo() \"abc\"", "a() Foo()", "say \"ab\""]


def test_word_lists_match_as_their_pattern_does(spark):
    df = spark.createDataFrame([(t,) for t in WORD_TEXTS], "t string")
    lists = [Q.ACK, Q.ACTIONABLE, Q.HIGH_VALUE, P.SPECIFIC_PLACE, P.LOW_VALUE_WORDS, P.EVAL_SPECIFIC_PLACE, *E.ACTIONABILITY, *[w for _, w in P.CATEGORY_RULES]]
    t = F.col("t")
    for words in lists:
        assert df.where(~T.has_words("t", words).eqNullSafe(t.rlike(T.words_java(words)))).count() == 0
    low = reduce(lambda a, b: a | b, [t.rlike(p) for p in Q.LOW_VALUE_RES])
    assert df.where(~Q.low_value_flag("t").eqNullSafe(low)).count() == 0
    specific = reduce(lambda a, b: a + b, [t.rlike(p).cast("int") for p in Q.SPECIFIC_RES])
    assert df.where(~Q.specific_pattern_count("t").eqNullSafe(specific)).count() == 0
    counted = F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(p)) for p in E.SPECIFICITY_RES]) / F.lit(3.0))
    assert df.where(~E.specificity("t").eqNullSafe(counted)).count() == 0


def test_word_lists_look_for_plain_text_first(spark):
    plan = spark.range(1).select(Q.high_value_flag(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower()


def test_fences_and_trim_as_the_patterns_do(spark):
    texts = ["```json {} ```", "```JSON\n1\n```", "```x```", "``````", "```", "a ```", " ```json a```", "````", "a``", "```json", "　a\u0085 ", None, "", "```json```json a ``` ```"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for bare in (True, False):
        s = F.regexp_replace("t", rf"(?i)\A```json{T.JS_SPACE}*", "")
        s = F.regexp_replace(s, rf"(?i)\A```{T.JS_SPACE}*", "") if bare else s
        s = F.regexp_replace(s, rf"(?i){T.JS_SPACE}*```\z", "")
        s = F.regexp_replace(s, rf"\A{T.JS_SPACE}+|{T.JS_SPACE}+\z", "")
        assert df.where(~RV.strip_fences("t", bare).eqNullSafe(s)).count() == 0
    trims = RV.strip_fences(F.col("t"))._jc.toString()
    assert "trim" in trims.lower()


def test_comment_ids_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).selectExpr("id AS review_id", "0 AS pos").mapInArrow(counted, "review_id bigint, pos int")
    got = ST.numbered(rows, ["review_id", "pos"], 7).collect()
    assert sorted((r.id, r.review_id) for r in got) == [(i + 8, i) for i in range(100)] and seen.value == 100


def test_rows_of_one_row_group_are_dealt_over_the_cores(spark):
    """More splits than cores say nothing: a Parquet file's rows lie where its row groups begin."""
    import os
    from ravel.session import scratch_path
    from ravel.sources.tables import spread
    path, old = scratch_path(spark, "one-group"), {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.range(20000).selectExpr("id", "sha2(string(id), 256) AS text").coalesce(1).write.parquet(path)
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    cores = spark.sparkContext.defaultParallelism
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // (cores + cores // 2)))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > cores and sum(1 for p in df.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect() if p) == 1
        sizes = [n for n in spread(df, "id").rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20000 and max(sizes) < 20000 / cores
