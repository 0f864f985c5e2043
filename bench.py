"""Benchmark: runs the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and prints one JSON line with per-query seconds.

Each query is executed completely through Spark's ``noop`` sink (all rows are
produced, nothing is collected to the driver). The batch queries come first and
make up ``value``; the streaming runs, which wait on triggers, and the corpus
operators are timed after them, as far as the time goes, and reported apart.
``BENCH_QUERIES`` (comma separated) restricts the set.

A query that takes longer than $BENCH_QUERY_S is cancelled, and none is begun
after $BENCH_LIMIT_S; both are named under ``unfinished``. The line is printed
in any case, also when the run is told to end."""

from __future__ import annotations

import json
import os
import signal
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# streaming runs (trigger waits, sleeps between time slices) are not headline
STREAMING = {"rate_window_stream", "rate_state_expiry", "stream_pr_events", "stream_upsert_reviews", "stream_alerts",
             "stream_quality_trend", "stream_webhook_github", "stream_webhook_gitlab"}


def timed(spark, key: str, query, sf_dir: str, most: float) -> float | None:
    """Seconds that the query took; None if it was cancelled or failed."""
    from pyspark import InheritableThread
    failed: list = []

    def work():
        spark.sparkContext.setJobGroup(key, key, interruptOnCancel=True)
        try:
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:
            failed.append(e)
            print(f"{key}: {str(e)[:300]}", file=sys.stderr, flush=True)

    t0 = time.perf_counter()
    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(most)
    if thread.is_alive():
        stopped = time.perf_counter()
        while thread.is_alive() and time.perf_counter() - stopped < 30:
            spark.sparkContext.cancelJobGroup(key)
            thread.join(1)
        return None
    return None if failed else round(time.perf_counter() - t0, 3)


def main() -> None:
    began = time.perf_counter()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    limit = float(os.environ.get("BENCH_LIMIT_S", "1500"))
    most = float(os.environ.get("BENCH_QUERY_S", "120"))
    from ravel.plans import QUERIES, load_all
    from ravel.session import build_session, configure
    load_all()
    spark = configure(build_session(f"local[{cpus}]", app="ravel-bench", shuffle_partitions=max(8, cpus * 2)))
    groups = {"queries": {k: QUERIES[k] for k in sorted(QUERIES) if k not in STREAMING},
              "streams": {k: QUERIES[k] for k in sorted(STREAMING)}, "corpus": {}}
    try:
        from ravel.llm.queries import QUERIES as corpus
        groups["corpus"] = dict(sorted(corpus.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))
    except ModuleNotFoundError as e:
        if e.name not in ("ravel.llm", "ravel.llm.queries"):
            raise
    if os.environ.get("BENCH_QUERIES"):
        wanted = os.environ["BENCH_QUERIES"].split(",")
        groups = {g: {k: q for k, q in qs.items() if k in wanted} for g, qs in groups.items()}
    times: dict[str, dict] = {g: {} for g in groups}
    unfinished: list[str] = []
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")

    def report(*_):
        print(json.dumps({"metric": "sum_query_seconds", "value": round(sum(times["queries"].values()), 3), "unit": "sec",
                          **times, "unfinished": unfinished, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                          "cpus": cpus, "n_queries": len(times["queries"])}), flush=True)

    def told_to_end(*_):
        report()
        os._exit(0)

    signal.signal(signal.SIGTERM, told_to_end)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    for group, queries in groups.items():
        for k, query in queries.items():
            left = limit - (time.perf_counter() - began)
            seconds = timed(spark, k, query, sf_dir, min(most, left)) if left > 1 else None
            if seconds is None:
                unfinished.append(k)
            else:
                times[group][k] = seconds
            print(f"{k}: {seconds}", file=sys.stderr, flush=True)
    report()
    sys.stdout.flush()
    if threading.active_count() > 1:
        os._exit(0)      # a cancelled query may still hold a thread


if __name__ == "__main__":
    main()
