"""Per-key request windows anchored at the first request.

Rule (per key, requests in (time, id) order): a request later than the
current window's end (strictly) opens a new window of ``window`` length;
every request counts; requests beyond ``limit`` in a window are flagged with
``retry_after = ceil((window end − time) / 1 s)``.

Batch form — exact and distributed, no per-key group in one task:

* time is cut into blocks of one window's length; requests are sorted and
  numbered inside a (key, block), and everything that spans blocks comes from
  the table of blocks (first and last time and number of requests of each);
* a gap longer than the window always starts a new window, so it cuts a key's
  log into pieces; a piece no longer than one window is that window;
* only in longer pieces must the chain of window starts be followed. At most
  one window starts in a block. "The first request after t + window" lies behind
  the requests of t's block and those of the next block up to t + window, and
  pointer doubling over it (``jump_{i+1} = jump_i ∘ jump_i``,
  ``starts ∪= jump_i(starts)``) reaches all starts in log₂(windows of a piece)
  rounds of equi-joins; each round is written to the scratch folder once;
* a request belongs to the start in its own block or in the previous one.

Stream form — ``applyInPandasWithState`` keeps (count, window end) per key
(O(1) state), the keys dealt over buckets so that a micro-batch takes one call
of Python a bucket and not one a key, and expires it when the window has ended,
at the latest by an event-time timeout (T4).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import scratch_path

REQUEST_SCHEMA = "event_id long, ts timestamp, client_key string, status int"
STREAM_SCHEMA = "event_id long, client_key string, window_count long, flagged boolean, retry_after long"


def _epoch_us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written to the scratch folder and read again, and its rows."""
    spark, path, seen = df.sparkSession, scratch_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def _blocks(r: DataFrame, w_us: int) -> DataFrame:
    """One row per (k, blk): piece (its first block), before (requests of the
    piece in earlier blocks), here (requests in the block), and of the piece
    its first time, its number of requests and whether it is one window."""
    per = r.groupBy("k", "blk").agg(F.min("tu").alias("lo"), F.max("tu").alias("hi"), F.count(F.lit(1)).alias("here"))
    order = Window.partitionBy("k").orderBy("blk")         # one row per block that has requests
    prev = F.lag("hi").over(order)
    per = per.withColumn("new", prev.isNull() | (F.col("lo") - prev > w_us))
    per = per.withColumn("piece", F.max(F.when(F.col("new"), F.col("blk"))).over(order))
    inside = Window.partitionBy("k", "piece")
    before = F.sum("here").over(inside.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    return per.select("k", "blk", "piece", "here", F.coalesce(before, F.lit(0)).alias("before"),
                      F.min("lo").over(inside).alias("first_us"), F.sum("here").over(inside).alias("size"),
                      (F.max("hi").over(inside) - F.min("lo").over(inside) <= w_us).alias("single"))


def _starts(nodes: DataFrame) -> DataFrame:
    """(k, piece, pos) of the window starts of pieces whose requests
    (k, piece, pos, nxt) point at the first request after their window."""
    key = ["k", "piece"]
    jump, _ = _stored(nodes.where("nxt IS NOT NULL").select(*key, F.col("pos").alias("src"), F.col("nxt").alias("dst")), "jumps")
    starts, n = nodes.where("pos = 1").select(*key, "pos"), 1
    while n:   # each round doubles the jumps
        add = starts.withColumnRenamed("pos", "src").join(jump, [*key, "src"]).select(*key, F.col("dst").alias("pos"))
        starts, _ = _stored(starts.unionByName(add).distinct(), "starts")
        further = jump.select(*key, F.col("src").alias("dst"), F.col("dst").alias("to"))
        jump, n = _stored(jump.join(further, [*key, "dst"]).select(*key, "src", F.col("to").alias("dst")), "jumps")
    return starts


def rate_window_flags(requests: DataFrame, window_seconds: int = 60, limit: int = 100,
                      key: str = "client_key", time_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """T3 (batch). See the module docstring. A request without a key, or
    without a time, belongs to no window and is left out."""
    w_us = int(window_seconds) * 1_000_000
    r = requests.select(F.col(key).alias("k"), F.col(time_col).alias("t"), F.col(id_col).alias("id"))
    r = r.where("k IS NOT NULL AND t IS NOT NULL").withColumn("tu", _epoch_us("t")).withColumn("blk", F.floor(F.col("tu") / w_us))
    blocks, _ = _stored(_blocks(r, w_us), "blocks")
    local = F.row_number().over(Window.partitionBy("k", "blk").orderBy("tu", "id"))
    placed = r.withColumn("n", local).join(blocks, ["k", "blk"]).withColumn("pos", F.col("before") + F.col("n"))

    def judged(df: DataFrame) -> DataFrame:
        """Over spos and stu, the position and time of the window's start."""
        count = F.col("pos") - F.col("spos") + 1
        retry = F.ceil((F.col("stu") + w_us - F.col("tu")) / 1_000_000.0)
        start = F.col("t") - F.make_dt_interval(secs=((F.col("tu") - F.col("stu")) / 1_000_000.0).cast("decimal(18,6)"))
        return df.select(F.col("id").alias("event_id"), F.col("k").alias("client_key"), F.col("t").alias("ts"),
                         start.alias("window_start"), count.cast("long").alias("window_count"),
                         (count > limit).alias("flagged"), F.when(count > limit, retry).cast("long").alias("retry_after"))

    single = judged(placed.where("single").withColumn("spos", F.lit(1)).withColumn("stu", F.col("first_us")))
    rest, n = _stored(placed.where("NOT single").select("k", "blk", "piece", "pos", "t", "tu", "id", "size",
                                                        (F.col("before") + F.col("here")).alias("through")), "pieces")
    if not n:
        return single
    # of the next block, the requests up to t + window: each probe is sorted among them
    probe = rest.select("k", (F.col("blk") + 1).alias("blk"), (F.col("tu") + w_us).alias("tu"), "piece", "pos", "through", "size",
                        F.lit(0).alias("weight"))
    real = rest.select("k", "blk", "tu", F.lit(None).cast("bigint").alias("piece"), F.lit(None).cast("bigint").alias("pos"),
                       F.lit(None).cast("bigint").alias("through"), F.lit(None).cast("bigint").alias("size"), F.lit(1).alias("weight"))
    upto = Window.partitionBy("k", "blk").orderBy("tu", F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.col("through") + F.col("passed") + 1
    nodes = (real.unionByName(probe).withColumn("passed", F.sum("weight").over(upto)).where("weight = 0")
                 .select("k", "piece", "pos", F.when(nxt <= F.col("size"), nxt).alias("nxt")))
    starts = _starts(nodes).join(rest.select("k", "piece", "pos", "blk", "tu"), ["k", "piece", "pos"]).select(
        "k", "blk", F.col("pos").alias("spos"), F.col("tu").alias("stu"))
    here = rest.join(starts, ["k", "blk"]).where(F.col("spos") <= F.col("pos"))
    prev = (rest.withColumn("blk", F.col("blk") - 1).join(starts, ["k", "blk"])
                .where((F.col("spos") <= F.col("pos")) & (F.col("tu") <= F.col("stu") + w_us)))
    # a request has one start, its own block's if that lies before it; so both kinds never meet but there
    best = (here.select("k", "piece", "pos", "spos", "stu").unionByName(prev.select("k", "piece", "pos", "spos", "stu"))
                .groupBy("k", "piece", "pos").agg(F.max("spos").alias("spos"), F.max("stu").alias("stu")))
    return single.unionByName(judged(rest.join(best, ["k", "piece", "pos"])))


PIECE = 65_536      # rows of one frame that the state function gives
BUCKETS = 1024      # groups that the clients' states are held in


def _rule(window_us: int, limit: int):
    """What both state functions do: read a frame, follow a client's windows,
    give the results (made here, so that workers get them with the functions)."""
    import numpy as np

    def read(f):
        return f["ts"].astype("datetime64[us]").astype("int64").to_numpy(), f["event_id"].to_numpy(np.int64)

    def windows(tu, count, end):
        """Of one client's sorted times, after a window of ``count`` requests
        that ends at ``end``: the requests' numbers in their windows, the
        windows' ends, and the last window."""
        counts, ends = np.empty(len(tu), np.int64), np.empty(len(tu), np.int64)
        i = 0
        while i < len(tu):
            if end < 0 or tu[i] > end:       # open a new window at request i
                count, end = 0, int(tu[i]) + window_us
            j = int(np.searchsorted(tu, end, side="right"))  # requests up to the window end
            counts[i:j] = np.arange(count + 1, count + 1 + (j - i))
            ends[i:j] = end
            count += j - i
            i = j
        return counts, ends, int(count), int(end)

    def results(ids, clients, tu, counts, ends):
        """In pieces; ``clients`` gives the client of rows i to j."""
        for i in range(0, len(tu), PIECE):
            c = counts[i:i + PIECE]
            wait = -((tu[i:i + PIECE] - ends[i:i + PIECE]) // 1_000_000)     # rounded up
            yield pd.DataFrame({"event_id": ids[i:i + PIECE], "client_key": clients(i, i + PIECE), "window_count": c, "flagged": c > limit,
                                "retry_after": pd.arrays.IntegerArray(wait, c <= limit)})
    return read, windows, results


def _process_key(window_us: int, limit: int):
    """State function for ``applyInPandasWithState`` by client: state = (count, end_us).

    Of a key's rows in a micro-batch only the times and ids are held, 16 bytes
    a row; the source bounds the micro-batch (:func:`read_requests`), so a hot
    key's share of it is bounded too. Results leave in pieces."""
    import numpy as np
    read, windows, results = _rule(window_us, limit)

    def fn(key, pdfs, state):
        if state.hasTimedOut:          # T4: the window ended, forget the key
            state.remove()
            return
        held = [read(f) for f in pdfs]
        tu, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1)) if held else (np.empty(0, np.int64),) * 2
        if not len(tu):
            return
        order = np.lexsort((ids, tu))
        tu, ids = tu[order], ids[order]
        counts, ends, count, end = windows(tu, *(state.get if state.exists else (0, -1)))
        state.update((count, end))
        # a window may end before the watermark that this batch has set
        state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield from results(ids, lambda i, j: key[0], tu, counts, ends)
    return fn


def _process_bucket(window_us: int, limit: int):
    """The same by bucket of clients: state = clients, their counts and window
    ends. Of a row 24 bytes are held. Clients whose window has ended are
    forgotten in each call, and all of them by the timeout at the last end."""
    import numpy as np
    read, windows, results = _rule(window_us, limit)

    def fn(bucket, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        code_of, held = {}, []
        for f in pdfs:
            codes, names = pd.factorize(f["client_key"], use_na_sentinel=False)
            names = [code_of.setdefault(None if pd.isna(n) else n, len(code_of)) for n in names]
            held.append((*read(f), np.array(names, np.int64)[codes]))
        if not held:
            return
        tu, ids, codes = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((ids, tu, codes))
        tu, ids, codes = tu[order], ids[order], codes[order]
        counts, ends = np.empty(len(tu), np.int64), np.empty(len(tu), np.int64)
        cuts = np.searchsorted(codes, np.arange(len(code_of) + 1))
        for client, k in code_of.items():
            part = slice(cuts[k], cuts[k + 1])
            counts[part], ends[part], *known[client] = windows(tu[part], *known.get(client, (0, -1)))
        now, names = state.getCurrentWatermarkMs(), np.array(list(code_of), dtype=object)
        known = {c: tuple(v) for c, v in known.items() if c in code_of or v[1] // 1000 + 1 >= now}
        state.update((list(known), *map(list, zip(*known.values()))))
        state.setTimeoutTimestamp(max(max(v[1] for v in known.values()) // 1000 + 1, now + 1))
        yield from results(ids, lambda i, j: names[codes[i:j]], tu, counts, ends)
    return fn


def read_requests(spark: SparkSession, folder: str, max_bytes: str = "256m", max_files: int | None = None) -> DataFrame:
    """The request log as a stream of JSON-lines files that arrive in time
    order. A micro-batch takes at most ``max_bytes`` (or ``max_files`` files),
    however much lies there, so no client's rows in it can outgrow that."""
    r = spark.readStream.schema(REQUEST_SCHEMA).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r.option("maxBytesPerTrigger", max_bytes)
    return r.json(folder)


def rate_window_stream(requests: DataFrame, window_seconds: int = 60, limit: int = 100, buckets: int | None = BUCKETS) -> DataFrame:
    """T3 + T4 (stream): per-key state (count, window end), expired by an
    event-time timeout when the window has ended. Requests that come later
    than the watermark (one window behind the newest) are not judged; run with
    ``late_path`` (:func:`ravel.streaming.streams.run_available`) their number
    per batch is stored. Clients are dealt by hash over ``buckets`` groups with
    one call of Python each in a micro-batch; None: one a client."""
    r = requests.select("client_key", "event_id", "ts").withWatermark("ts", f"{int(window_seconds)} seconds")
    if buckets is None:
        return r.groupBy("client_key").applyInPandasWithState(
            _process_key(int(window_seconds) * 1_000_000, int(limit)), STREAM_SCHEMA, "count long, end_us long",
            "append", GroupStateTimeout.EventTimeTimeout)
    r = r.withColumn("bucket", F.pmod(F.xxhash64("client_key"), F.lit(int(buckets))).cast("int"))
    return r.groupBy("bucket").applyInPandasWithState(
        _process_bucket(int(window_seconds) * 1_000_000, int(limit)), STREAM_SCHEMA,
        "client array<string>, count array<bigint>, end_us array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
