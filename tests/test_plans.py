"""Plan properties that matter at scale (checked on the optimized plan)."""

from ravel.operators import quality as Q
from ravel.operators import reports as R
from ravel.operators import reviews as RV
from ravel.sources import views as V

SF = "/root/testdata/sf0.001"


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_filter_reaches_scan(spark):
    m = R.metrics_overview(V.reviews(spark, SF), V.review_comments(spark, SF), "2001-08-01", 90)
    plan = _physical(m)
    assert "o_orderdate" in plan and "2001-05-03" in plan   # pushed into the orders scan
    assert "LeftSemi" in plan                              # comments pruned before the aggregate


def test_score_filter_does_not_repeat_regexes(spark):
    kept = Q.threshold_filter(Q.score_examples(V.raw_examples(spark, SF)), 0.65)
    plan = _optimized(kept)
    # each flag regex is evaluated once (behind the generator), not again in the pushed filter
    assert plan.count(Q.HIGH_VALUE_RE) == 1
    assert plan.count(Q.ACTIONABLE_RE) == 1


def test_parse_filter_does_not_repeat_json_parsing(spark):
    p = RV.parse_review(V.responses(spark, SF))
    plan = _optimized(p.where("outcome <> 'quarantine'"))
    assert plan.count("parseJson") == 3   # the two strictness wrappers and the value, each once


def test_pr_page_is_cut_before_comments(spark):
    out = R.pr_rollup(V.reviews(spark, SF), V.review_comments(spark, SF), limit=20, offset=0)
    plan = _physical(out)
    assert "TakeOrderedAndProject" in plan and "BroadcastExchange" in plan
