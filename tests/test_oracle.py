"""Every registered query against its DuckDB oracle (sf0.001), and the
known values of FIXTURES.md §3 at sf0.01."""

import pytest

from ravel.plans import ORACLE, QUERIES, load_all
from ravel.plans.compare import compare, duck_connection

load_all()
SF = "/root/testdata/sf0.001"
WITHOUT_ORACLE = {"near_duplicate_clusters"}


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    r = compare(spark, key, SF, duck)
    assert r["status"] == ("no-oracle" if key in WITHOUT_ORACLE else "match"), r["status"]


def test_every_key_has_entry():
    import __spark_entry__ as E
    assert set(QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) - set(ORACLE) == WITHOUT_ORACLE


def test_known_values_sf001(spark):
    d = "/root/testdata/sf0.01"
    m = QUERIES["metrics_overview"](spark, d).first()
    assert (m.total_reviews, m.total_issues, m.security_issues, m.critical_count) == (569, 2195, 420, 209)
    assert (m.avg_score, m.avg_score_per_review) == (47, 48)
    dec = {r.event: r.n for r in QUERIES["review_decision"](spark, d).groupBy("event").count()
           .withColumnRenamed("count", "n").collect()}
    assert dec == {"REQUEST_CHANGES": 4973, "COMMENT": 9531, "APPROVE": 496}
    assert [r.n for r in QUERIES["score_histogram"](spark, d).orderBy("bucket_pos").collect()] == [390, 144, 124, 210, 132]
    gh = {r.action: r.n for r in __import__("ravel.sources.views", fromlist=["x"]).pr_events(spark, d)
          .where("event_name = 'pull_request' AND action IN ('opened', 'synchronize')").groupBy("action").count()
          .withColumnRenamed("count", "n").collect()}
    assert gh == {"opened": 1352, "synchronize": 1325}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 1 and "avg_score" in df.columns
