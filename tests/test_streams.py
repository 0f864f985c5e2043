"""Streams and stored tables: the trend at several file counts and after a
restart, late rows, replayed batches, the outbox, buckets that stay untouched,
comment ids; and the batch operators rewritten with them."""

import datetime as dt
import os
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ravel.operators import alerts as A
from ravel.operators import components as C
from ravel.operators import extras as X
from ravel.operators import reviews as RV
from ravel.operators import threads as TH
from ravel.session import scratch_path
from ravel.streaming import outbox as OB
from ravel.streaming import rate as RT
from ravel.streaming import store as ST
from ravel.streaming import streams as S
from ravel.streaming import trend as TD

BASE = dt.datetime(2024, 3, 1)
REVIEWS = ("id bigint, repo_full_name string, pr_number int, pr_title string, author_login string, head_sha string, "
           "overall_score bigint, created_at timestamp")


def review_rows(n=120, seed=1):
    rnd = random.Random(seed)
    return [(i, f"r{rnd.randrange(3)}", rnd.randrange(15), f"T{i}", f"u{i % 4}", f"h{rnd.randrange(2)}",
             rnd.choice((None, 10, 55, 90, 100)), BASE + dt.timedelta(hours=rnd.randrange(200))) for i in range(n)]


def brute_trend(rows):
    keys = defaultdict(list)
    for r in rows:
        keys[(r[1], r[2], r[5])].append(r)
    days = defaultdict(list)
    for rs in keys.values():
        first, last = min(rs, key=lambda r: (r[0], r[7])), max(rs, key=lambda r: (r[0], -1 if r[6] is None else r[6]))
        days[first[7].date()].append(last[6])
    out = {}
    for d, scores in days.items():
        some = [s for s in scores if s is not None]
        out[d] = (int(sum(some) / len(some) + 0.5) if some else None, len(scores))
    return out


def run_trend(spark, rows, files, max_files=1, delay="100 days", cut=None):
    """Write the rows as ``files`` files and run the stream, in two runs on one checkpoint if ``cut``."""
    folder, ckpt, out, late = (scratch_path(spark, x) for x in ("in", "ckpt", "trend", "late"))
    order = [rows[i::files] for i in range(files)]
    for k, part in enumerate(order):
        spark.createDataFrame(part, REVIEWS).coalesce(1).write.mode("append").parquet(folder)
        if (cut and k + 1 == cut) or k + 1 == files:
            src = spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", max_files).parquet(folder)
            S.run_available(TD.trend_changes(src, delay, 365), ckpt, mode="update", late_path=late, stream="t",
                            foreach_batch=TD.trend_batch_writer(out, "t"))
    got = {r.day.date(): (r.avg_score, r.pr_count) for r in TD.live_trend(spark, out).collect()}
    return got, late


@pytest.mark.parametrize("files, cut", [(1, None), (4, None), (4, 2), (16, 9)])
def test_trend_stream_does_not_depend_on_files_or_restarts(spark, files, cut):
    rows = review_rows() + review_rows()[:40]          # some rows are delivered twice
    random.Random(files).shuffle(rows)
    got, _ = run_trend(spark, rows, files, max_files=4 if files == 16 else 1, cut=cut)
    assert got == brute_trend(rows)


def test_trend_stream_takes_back_what_a_key_gave(spark):
    day = lambda d: BASE + dt.timedelta(days=d)
    rows = [(5, "r", 1, "t", "u", "h", 40, day(3)), (2, "r", 1, "t", "u", "h", 80, day(1)), (9, "r", 1, "t", "u", "h", 100, day(2))]
    got, _ = run_trend(spark, rows, 3)
    assert got == {day(1).date(): (100, 1)}


def test_late_rows_are_counted_beside_the_stream(spark):
    rows = [(1, "r", 1, "t", "u", "h", 50, BASE + dt.timedelta(days=30)), (2, "r", 2, "t", "u", "h", 60, BASE + dt.timedelta(days=31)),
            (3, "r", 3, "t", "u", "h", 70, BASE), (4, "r", 4, "t", "u", "h", 80, BASE + dt.timedelta(days=31))]
    got, late = run_trend(spark, rows, 4, delay="1 day")
    assert got == {(BASE + dt.timedelta(days=30)).date(): (50, 1), (BASE + dt.timedelta(days=31)).date(): (70, 2)}
    assert spark.read.parquet(late).agg(F.sum("late_rows")).first()[0] == 1


def test_trend_batch_run_again_replaces_itself(spark):
    out = scratch_path(spark, "trend")
    write = TD.trend_batch_writer(out, "t")
    changes = spark.createDataFrame([(0, 1, 1, 80), (0, 1, 1, 60), (TD.DAY_US, 1, 0, 0)], "day_us bigint, reviews bigint, scored bigint, score bigint")
    for _ in range(2):
        write(changes, 7)
    got = sorted((r.avg_score, r.pr_count) for r in TD.live_trend(spark, out).where("avg_score IS NOT NULL").collect())
    assert got == [(70, 2)] and TD.live_trend(spark, out).count() == 2


def brute_rate(reqs, window_s, limit):
    out, by = {}, defaultdict(list)
    for eid, key, t in sorted(reqs, key=lambda r: (r[1], r[2], r[0])):
        by[key].append((eid, t))
    for lst in by.values():
        end, count = None, 0
        for eid, t in lst:
            if end is None or t > end:
                end, count = t + dt.timedelta(seconds=window_s), 0
            count += 1
            wait = -((t - end) // dt.timedelta(seconds=1)) if count > limit else None
            out[eid] = (count, count > limit, wait)
    return out


def requests(n=900, seed=2):
    """A client with a third of all rows, gaps of every length, equal times."""
    rnd, t, rows = random.Random(seed), BASE, []
    for i in range(n):
        t += dt.timedelta(microseconds=rnd.choice((0, 1, 400_000, 7_000_000, 61_000_000, 60_000_000, 4_000_000)))
        rows.append((i, "hot" if i % 3 == 0 else f"c{rnd.randrange(40)}", t))
    return rows


@pytest.mark.parametrize("window, limit", [(60, 5), (7, 1), (100000, 3)])
def test_rate_windows_by_gap_cuts(spark, window, limit):
    rows = requests()
    df = spark.createDataFrame(rows + [(-1, None, BASE), (-2, "x", None)], "event_id bigint, client_key string, ts timestamp_ntz").repartition(5)
    got = {r.event_id: (r.window_count, r.flagged, r.retry_after) for r in RT.rate_window_flags(df, window, limit).collect()}
    assert got == brute_rate(rows, window, limit)
    assert all(r.window_start <= r.ts for r in RT.rate_window_flags(df, window, limit).collect())


def test_rate_windows_write_only_what_spans_windows(spark, monkeypatch):
    """Requests of pieces of one window are answered at once."""
    seen = {}
    stored = RT._stored

    def counted(df, name):
        out, n = stored(df, name)
        seen[name] = max(n, seen.get(name, 0))
        return out, n

    monkeypatch.setattr(RT, "_stored", counted)
    rows = [(i, f"c{i % 50}", BASE + dt.timedelta(seconds=1000 * (i // 200) + i % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id bigint, client_key string, ts timestamp_ntz")
    got = {r.event_id: (r.window_count, r.flagged, r.retry_after) for r in RT.rate_window_flags(df, 60, 2).collect()}
    assert got == brute_rate(rows, 60, 2) and seen["pieces"] == 0 and "jumps" not in seen


def test_rate_stream_bounded_batches_and_late_rows(spark, tmp_path):
    rows = requests(600)
    folder, ckpt, out, late = (scratch_path(spark, x) for x in ("req", "ckpt", "rates", "late"))
    fmt = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    for k in range(6):   # in time order, one file each
        part = spark.createDataFrame(rows[100 * k:100 * k + 100], "event_id bigint, client_key string, ts timestamp")
        part.coalesce(1).write.mode("append").option(*fmt).json(folder)
        time.sleep(0.02)
    # long after its time
    spark.createDataFrame([(9999, "hot", BASE)], "event_id bigint, client_key string, ts timestamp").coalesce(1).write.mode("append").option(*fmt).json(folder)
    src = RT.read_requests(spark, folder, max_files=1)
    S.run_available(RT.rate_window_stream(src, 60, 5), ckpt, out, late_path=late, stream="rates")
    got = {r.event_id: (r.window_count, r.flagged, r.retry_after) for r in spark.read.parquet(out).collect()}
    assert got == brute_rate(rows, 60, 5)
    assert spark.read.parquet(late).agg(F.sum("late_rows")).first()[0] == 1


def test_rate_state_function_gives_bounded_pieces(monkeypatch):
    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.value = value

        def setTimeoutTimestamp(self, ms):
            self.ms = ms

        def getCurrentWatermarkMs(self):
            return 0

    monkeypatch.setattr(RT, "PIECE", 100)
    n = 1050
    frames = (pd.DataFrame({"event_id": range(a, a + 50), "ts": [pd.Timestamp(BASE)] * 50}) for a in range(0, n, 50))
    out = list(RT._process_key(60_000_000, 1000)(("hot",), frames, State()))
    assert [len(f) for f in out] == [100] * 10 + [50]
    assert sum(f["flagged"].sum() for f in out) == 50 and out[-1]["retry_after"].tolist() == [60] * 50


class BucketState:
    """A bucket's state, as Spark gives it."""
    hasTimedOut = False

    def __init__(self, watermark=0):
        self.get, self.watermark = None, watermark

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.watermark
        self.ms = ms

    def getCurrentWatermarkMs(self):
        return self.watermark


def test_trend_takes_many_keys_in_a_call_and_forgets_old_ones():
    import pandas as pd
    day, state, step = TD.DAY_US, BucketState(), TD._changes(2 * 86_400_000)
    frame = lambda rows: pd.DataFrame(rows, columns=["review", "id", "us", "score"])
    out = list(step((0,), iter([frame([("a", 2, day, 50), ("b", 1, day, TD.NONE)]), frame([("a", 1, 0, 90), ("c", 1, TD.NONE, 10)])]), state))
    assert len(out) == 1 and {r[0] if r[0] == r[0] else None: r[1:] for r in out[0].astype(object).where(out[0].notna(), None).itertuples(index=False, name=None)} == {
        0: (1, 1, 50), day: (1, 0, 0), None: (1, 1, 10)}
    assert sorted(state.get[0]) == ["a", "b", "c"]
    out = list(step((0,), iter([frame([("a", 3, 5 * day, 70)])]), state))        # takes back what the key gave
    assert out[0].values.tolist() == [[0, 0, 0, 20]]
    state.watermark, state.hasTimedOut = 3 * 86_400_000 + 1, True
    assert list(step((0,), iter([]), state)) == [] and state.get[0] == ["a"] and state.ms == 7 * 86_400_000


@pytest.mark.parametrize("calls", [1, 4])
def test_rate_bucket_judges_many_clients_in_a_call(calls, monkeypatch):
    import pandas as pd
    monkeypatch.setattr(RT, "PIECE", 100)
    rows = sorted((r for r in requests(600)), key=lambda r: (r[2], r[0]))
    rows = [(i, None if k == "c1" else k, t) for i, k, t in rows]
    state, step, got, size = BucketState(), RT._process_bucket(60_000_000, 5), {}, len(rows) // calls
    for c in range(0, len(rows), size):
        frames = [pd.DataFrame(rows[a:a + 50], columns=["event_id", "client_key", "ts"]) for a in range(c, c + size, 50)]
        for f in step((0,), iter(frames), state):
            assert len(f) <= 100
            for i, k, n, over, wait in f.itertuples(index=False, name=None):
                got[i] = (k, n, over, None if pd.isna(wait) else wait)
    want = brute_rate([(i, k or "", t) for i, k, t in rows], 60, 5)
    assert got == {i: (k, *want[i]) for i, k, _ in rows}


COMMENTS = ("id bigint, review_id bigint, file_path string, line_number int, category string, severity string, title string, suggestion string")


def test_outbox_announces_a_review_once(spark):
    day = lambda d: BASE + dt.timedelta(days=d)
    rows = [(1, "o/a", 7, "Fix", "ann", "h1", 95, day(0)), (2, "o/b", 8, "Add", "bob", "h2", 95, day(1)), (3, "o/c", 9, None, "cid", "h3", 50, day(9))]
    comments = spark.createDataFrame([(10 + i, 2, "a.py", i or None, "security", "critical", f"t{i}", "s" * (119 + i)) for i in range(4)]
                                     + [(20, 3, "b.py", 1, "style", "info", "t", "s")], COMMENTS)
    out = scratch_path(spark, "outbox")
    a, b = (OB.outbox_batch_writer(lambda s: comments, out, name) for name in "ab")
    frame = lambda rs: spark.createDataFrame(rs, REVIEWS)
    a(frame(rows[:2]), 0)
    first = sorted(tuple(r) for r in OB.messages(spark, out).collect())
    a(frame(rows[:2]), 0)                                  # the same batch again
    a(frame(rows[:1] + rows[:1]), 1)                       # redelivered, in a later batch
    b(frame(rows), 0)                                      # and by another stream
    b(frame(rows).where("false"), 1)                       # a batch without rows
    assert sorted(tuple(r) for r in OB.messages(spark, out).collect()) == first
    got = {(r.review_id, r.kind): r for r in OB.messages(spark, out).collect()}
    assert set(got) == {(1, "approval"), (2, "critical")}
    m = got[(2, "critical")]
    assert m.headline == "🔴 *Critical issues found in PR*\n*<https://github.com/o/b/pull/8|o/b#8: Add>*"
    assert m.details == "*Author*\nbob\n*Quality Score*\n95/100\n*Critical Issues*\n4\n*Action*\nChanges requested"
    assert m.issue_list.split("\n\n") == ["• *t0* in `a.py`\n  " + "s" * 119, "• *t1* in `a.py`:1\n  " + "s" * 120,
                                          "• *t2* in `a.py`:2\n  " + "s" * 120 + "…"]
    assert got[(1, "approval")].headline.startswith("✅ *PR auto-approved by Code Review Bot*\n*<https://github.com/o/a/pull/7|")


def test_outbox_deals_out_a_batch_of_one_split(spark, monkeypatch):
    seen, messages = [], OB.review_messages
    monkeypatch.setattr(OB, "review_messages", lambda r, c: seen.append(r._jdf.queryExecution().executedPlan().toString()) or messages(r, c))
    batch = spark.createDataFrame([(1, "o/a", 7, "Fix", "ann", "h1", 95, BASE)], REVIEWS).coalesce(1)
    OB.outbox_batch_writer(lambda s: spark.createDataFrame([], COMMENTS), scratch_path(spark, "outbox"), "a")(batch, 0)
    # dealt by review, and kept after the aggregate, not before it
    assert "REPARTITION_BY_COL" in seen[0] and seen[0].index("InMemoryRelation") < seen[0].index("Aggregate")


def test_score_drop_message(spark):
    rows = [(1, "r", 1, "t", "u", "h", 90, BASE), (2, "r", 2, "t", "u", "h", 60, BASE + dt.timedelta(days=40)),
            (3, "r", 3, "t", "u", "h", 60, BASE + dt.timedelta(days=70))]
    got = A.score_drop(spark.createDataFrame(rows, REVIEWS)).collect()
    assert len(got) == 1 and got[0].details == "*Current Score*\n60/100\n*Previous Score*\n90/100\n*Threshold*\n70/100\n*Change*\n-30 pts"


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark):
    rows = [r for r in review_rows(200, 5) if r[6] is not None]
    path = scratch_path(spark, "reviews")
    frame = lambda rs: spark.createDataFrame(rs, REVIEWS)
    ST.apply_reviews(spark, path, frame(rows[:120]), 0, buckets=8)
    before = files_of(path)
    one = [rows[120]]
    touched = ST.apply_reviews(spark, path, frame(one), 1, buckets=8)
    assert len(touched) == 1
    after = files_of(path)
    kept = {f: t for f, t in before.items() if f"bucket={touched[0]}/" not in f}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    ST.apply_reviews(spark, path, frame(rows[100:]), 2, buckets=8)       # overlaps the first batch
    ST.apply_reviews(spark, path, frame(rows[100:]), 2, buckets=8)       # and comes again
    want = {}
    for r in rows[:120] + one + rows[100:]:
        k = (r[1], r[2], r[5])
        want[k] = r[:6] + (r[6],) + r[7:] if k not in want else want[k][:6] + (r[6],) + want[k][7:]
    got = Counter(tuple(r[c] for c in [x.split()[0] for x in REVIEWS.split(", ")]) for r in ST.stored_reviews(spark, path).collect())
    assert got == Counter(want.values())


def test_batch_ended_halfway_is_moved_in(spark, monkeypatch):
    rows = [r for r in review_rows(60, 6) if r[6] is not None]
    path = scratch_path(spark, "reviews")
    frame = lambda rs: spark.createDataFrame(rs, REVIEWS)
    ST.apply_reviews(spark, path, frame(rows[:20]), 0, buckets=4)
    move = ST._move_in
    monkeypatch.setattr(ST, "_move_in", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ST.apply_reviews(spark, path, frame(rows[20:40]), 1, buckets=4)
    monkeypatch.setattr(ST, "_move_in", move)
    ids = lambda rs: {(r[1], r[2], r[5]) for r in rs}
    got = ST.stored_reviews(spark, path)
    assert {(r.repo_full_name, r.pr_number, r.head_sha) for r in got.collect()} == ids(rows[:40])
    assert not ST.recover(spark, path)
    assert ST.apply_reviews(spark, path, frame(rows[:1]).where("false"), 2, buckets=4) == []


def test_log_is_folded_into_a_table(spark):
    rows = [r for r in review_rows(80, 7) if r[6] is not None]
    log, table = scratch_path(spark, "log"), scratch_path(spark, "table")
    write = S.upsert_batch_writer(log, "a")
    for k in range(3):
        write(spark.createDataFrame(rows[20 * k:20 * k + 30], REVIEWS), k)
    folded = ST.compact(spark, log, table, buckets=4)
    cols = S.merged_reviews(spark, log).columns
    assert Counter(tuple(r[c] for c in cols) for r in folded.collect()) == Counter(tuple(r) for r in S.merged_reviews(spark, log).collect())


ANSWER = "review_id bigint, comments array<" + RV.COMMENT_TYPE + ">"


def comment(i):
    return (f"f{i}.py", i, "style", "info", f"t{i}", "s", None, None, None)


def test_comment_ids_follow_the_order_and_survive_replays(spark):
    path = scratch_path(spark, "comments")
    frame = lambda rs: spark.createDataFrame(rs, ANSWER).repartition(5)
    batch = [(r, [comment(i) for i in range(r % 4)]) for r in range(40, 0, -1)]
    ST.append_comments(spark, path, frame(batch).where("false"), 0)
    ST.append_comments(spark, path, frame(batch), 1)
    once = sorted(tuple(r) for r in ST.stored_comments(spark, path).drop("created_at").collect())
    ST.append_comments(spark, path, frame(batch), 1)
    assert sorted(tuple(r) for r in ST.stored_comments(spark, path).drop("created_at").collect()) == once
    again = ST.stored_comments(spark, path)
    order = [(r, i) for r in range(1, 41) for i in range(r % 4)]
    assert [(r.id, r.review_id, r.pos) for r in again.orderBy("id").collect()] == [(k, *o) for k, o in enumerate(order, 1)]
    assert len(once) == len(order) and again.where("created_at IS NULL").count() == 0
    ST.append_comments(spark, path, frame([(7, [comment(0)] * 4), (99, [comment(5)])]), 2)   # 7 has three stored
    new = [(r.id, r.review_id, r.pos) for r in ST.stored_comments(spark, path).where(F.col("id") > len(order)).orderBy("id").collect()]
    assert new == [(len(order) + 1, 7, 3), (len(order) + 2, 99, 0)]


def brute_components(edges):
    at = {}

    def find(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return {x: find(x) for x in at}


def test_components_and_their_extension(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1050)]        # a chain and a star
    edges += [(rnd.randrange(2000, 2200), rnd.randrange(2000, 2200)) for _ in range(120)]
    edges = [(a, b) for a, b in edges if a != b]
    frame = lambda es: spark.createDataFrame(es, "a bigint, b bigint")
    got = {r.id: r.component for r in C.connected_components(frame(edges + [(5, 5), (None, 3)])).collect()}
    assert got == brute_components(edges)
    some, more = edges[::2], edges[1::2] + [(5000, 5001), (300, 1000)]
    labels = C.connected_components(frame(some))
    got = {r.id: r.component for r in C.extended_components(labels, frame(more)).collect()}
    assert got == brute_components(some + more)
    assert C.connected_components(frame(edges).where("false")).count() == 0
    assert C.extended_components(labels, frame(edges).where("false")).count() == labels.count()


def test_signatures_of_equal_gram_sets_are_equal(spark):
    texts = ["abcdefg", "abc", "", None, "ab𝒳cd é", "aaaaaaaa", "aaaaaa", "ab𝒳cd é ", "abcd", "ab𝒴cd é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: tuple(r.sig) for r in X.minhash_signatures(df, "t", "id").collect()}
    grams = lambda t: frozenset(t.strip()[i:i + 5] for i in range(max(len(t.strip()) - 4, 1)))
    assert set(got) == {i for i, t in enumerate(texts) if t is not None}
    for i in got:
        for j in got:
            assert (got[i] == got[j]) == (grams(texts[i]) == grams(texts[j]))


def test_signatures_estimate_similarity(spark):
    rnd = random.Random(5)
    base = [rnd.choice("abcdefghijklmnop ") for _ in range(4000)]
    rows, grams = [], lambda t: {t[i:i + 5] for i in range(len(t) - 4)}
    for k in range(12):
        t = list(base)
        for _ in range(60 * k):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        rows.append((k, " ".join("".join(t).split())))
    sig = {r.id: r.sig for r in X.minhash_signatures(spark.createDataFrame(rows, "id int, t string"), "t", "id", 256).collect()}
    one = grams(rows[0][1])
    for k, t in rows:
        true = len(one & grams(t)) / len(one | grams(t))
        assert abs(sum(a == b for a, b in zip(sig[0], sig[k])) / 256 - true) < 0.12


def test_signatures_of_a_long_text_are_linear(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcdefghij ", k=300_000))
    df = spark.createDataFrame([(1, text), (2, text[:-1] + "z"), (3, None)], "id int, t string")
    began = time.time()
    sig = {r.id: r.sig for r in X.minhash_signatures(df, "t", "id").collect()}
    assert time.time() - began < 60 and set(sig) == {1, 2}
    assert sum(a == b for a, b in zip(sig[1], sig[2])) > 60


def test_first_file_of_a_path_decides(spark):
    files = spark.createDataFrame([("r", 1, "a.js", 2, "aaa"), ("r", 1, "a.js", 1, "zzz"), ("r", 2, "a.js", 1, None), ("r", 2, "a.js", 2, "bbb"),
                                   ("r", 3, "a.js", 1, ""), ("r", 3, "a.js", 5, "c")], "repo string, pr_number int, path string, pos int, patch string")
    comments = spark.createDataFrame([("r", n, "a.js", n) for n in (1, 2, 3, 4)], "repo string, pr_number int, path string, comment_id int")
    assert [(r.comment_id, r.patch) for r in TH.comment_file_join(comments, files).collect()] == [(1, "zzz")]


def test_partial_answer_keeps_its_fraction(spark):
    texts = ['{"overallScore": 72.5, "summary": "s", "comments": []}', '{"overallScore": 72, "summary": "s", "comments": []}', "nonsense"]
    p = RV.parse_review(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw_text string"))
    assert {r.id: (r.outcome, r.overall_score) for r in p.collect()} == {0: ("partial", 72.5), 1: ("valid", 72.0), 2: ("unparsable", 70.0)}
    zero = F.lit(0)
    shown = p.select("id", RV.format_summary(F.lit("COMMENT"), F.col("overall_score"), F.col("summary"), zero, zero).alias("m"))
    assert {r.id: r.m.split("Score: ")[1].split("/")[0] for r in shown.collect()} == {0: "72.5", 1: "72", 2: "70"}
