"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

import pytest

from ravel.llm.queries import ORACLE, QUERIES
from ravel.plans.compare import _norm, duck_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, key):
    from collections import Counter
    df = QUERIES[key](spark, SF)
    cur = duck_connection(SF).execute(ORACLE[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(_norm(v) for v in r) for r in cur.fetchall())
    assert Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect()) == want


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    import __spark_entry__ as E
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from ravel.llm import decontamination, near_dups, quality
    from ravel.llm.common import saved
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "secret scan", "mixing"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = saved(stage(spark, docs, SF), "stage")
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert ids(out) == ids(quality.quality_report(docs).where("kept"))
        elif k == 1:
            assert ids(out) == ids(near_dups.near_duplicates(docs, percent=80).where("kept"))
        elif k == 2:
            assert ids(out) == ids(docs) - ids(decontamination.contamination(docs, bench).where("contaminated"))
        elif k == 3:
            assert ids(out) == ids(docs) and out.where("n_chars <> length(text)").count() == 0
            assert out.where("text rlike '[0-9a-f]{32,}'").count() == 0
        else:
            # those that are never drawn go
            from ravel.llm import mixing
            rates = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert out.columns == docs.columns + ["rate"] and ids(out) == {i for i in ids(docs) if rates[i] > 0}
            assert {r.doc_id: r.rate for r in out.collect()} == {i: r for i, r in rates.items() if r > 0}
        docs = out
