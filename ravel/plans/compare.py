"""Spark-vs-DuckDB result comparison (row count, column names, order-free
value multiset) used by the tests and by ``python -m ravel.plans.compare``."""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
from collections import Counter

from .registry import ORACLE, QUERIES
from ..sources.tables import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return bool(v)
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    df = QUERIES[key](spark, sf_dir)
    cols = df.columns
    srows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    res = {"key": key, "spark_rows": len(srows), "columns": cols}
    if key not in ORACLE:
        res["status"] = "no-oracle"
        return res
    con = con or duck_connection(sf_dir)
    cur = con.execute(ORACLE[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    idx = {c: i for i, c in enumerate(ocols)}
    res["oracle_rows"] = len(orows)
    if sorted(ocols) != sorted(cols):
        res["status"] = f"columns differ: spark={sorted(cols)} oracle={sorted(ocols)}"
        return res
    orows = [tuple(_norm(r[idx[c]]) for c in cols) for r in orows]
    cs, co = Counter(srows), Counter(orows)
    if cs == co:
        res["status"] = "match"
    else:
        only_s = list((cs - co).elements())[:3]
        only_o = list((co - cs).elements())[:3]
        res["status"] = f"values differ: spark-only={only_s} oracle-only={only_o}"
    return res


def main(argv):
    from ..session import build_session
    from . import load_all
    load_all()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf)
    keys = argv or sorted(QUERIES)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "status": f"error: {type(e).__name__}: {str(e)[:300]}"}
        ok = r["status"] in ("match", "no-oracle")
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {k}: {r['status']} rows={r.get('spark_rows')}/{r.get('oracle_rows')}",
              flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
