"""JavaScript text semantics reproduced with Spark expressions."""

import json

import pytest
from pyspark.sql import functions as F

from ravel.functions.render import json_string
from ravel.functions.text import is_strict_json, js_trim, words_java
from ravel.operators import quality as Q
from ravel.operators.reviews import strip_fences


def ev(spark, expr, values, t="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {t}")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def test_word_boundary_is_ascii(spark):
    # D1: 'é' is not a word character for JS \b
    assert ev(spark, lambda c: c.rlike(words_java(["fix"])), ["éfix", "fixé", "xfix", "fix", "fix_"]) == \
        [True, True, False, True, False]


def test_o_n_needs_word_char_after(spark):
    # O(n) followed by \b matches only when a word character follows
    hv = lambda c: Q.high_value_flag(c)
    assert ev(spark, hv, ["O(n) is slow", "O(n)x", "(O(n)y"]) == [False, True, True]


def test_low_value_end_anchor(spark):
    # D2: '$' is the very end: "LGTM\n" is not the whole-text form
    assert ev(spark, Q.low_value_flag, ["LGTM", "lgtm.", "LGTM\n", "nit: x", "nit x", "nitpick"]) == \
        [True, True, False, True, True, False]


def test_js_trim_unicode_spaces(spark):
    # D3: trim strips Unicode spaces and BOM, not just ' '
    vals = ["  a　", "﻿b ", "  c  ", "\u0085d"]
    assert ev(spark, js_trim, vals) == ["a", "b", "c", "\u0085d"]


@pytest.mark.parametrize("text,ok", [
    ("", False), ('{"a":1} x', False), ('{"a":1,}', False), ("[1,]", False), ("1 2", False),
    ("NaN", False), ("01", False), ("{'a':1}", False), ('"a\tb"', False), ('{"a":1,"a":2}', True),
    ("null", True), ("[]", True), ('  {"a": [1, 2.5e3, "x", null, true]}  ', True), ("-0", True),
])
def test_strict_json(spark, text, ok):
    # JSON.parse acceptance
    assert ev(spark, is_strict_json, [text]) == [ok]


def test_strip_fences(spark):
    vals = ["```json\n{}\n```", "```JSON {} ```", "```\n{}\n```", "{}\n```\n", "x"]
    # a fence followed by a final newline is not at the very end ($ = end of input): kept
    assert ev(spark, strip_fences, vals) == ["{}", "{}", "{}", "{}\n```", "x"]
    assert ev(spark, lambda c: strip_fences(c, bare_fence=False), ["```\n{}\n```"]) == ["```\n{}"]


def test_json_string_matches_json_stringify(spark):
    vals = ['a"b\\c', "tab\tnew\nline", "ctl\x01\x1f", "é😀", " "]
    got = ev(spark, json_string, vals)
    assert got == [json.dumps(v, ensure_ascii=False) for v in vals]


def test_length_point_boundaries(spark):
    # X6 thresholds 30/80/400/700 on the trimmed length
    vals = ["a" * n for n in (0, 29, 30, 79, 80, 400, 401, 700, 701)]
    got = ev(spark, lambda c: Q.length_points(F.length(js_trim(c))), vals)
    assert got == [-0.5, -0.5, 0.1, 0.1, 0.25, 0.25, 0.15, 0.15, -0.1]


def test_score_double_order(spark):
    # 0.25+0.2+0.1+0.3-0.1-0.1 = 0.6500000000000001 (kept at 0.65)
    text = "Please use `x` here to fix the cache " + "y" * 60
    df = spark.createDataFrame([(text, False, 0, "NONE", "p")],
                               "review_comment string, author_ack boolean, reactions int, association string, patch string")
    s = Q.score_examples(df).select("quality_score", "quality_reasons").first()
    assert s.quality_score == 0.25 + 0.2 + 0.2 + 0.3
    assert s.quality_reasons == ["good_length", "actionable", "specific", "high_value"]


def test_infer_category_whole_words(spark):
    assert ev(spark, Q.infer_category, ["sql injection here", "injection", "slow loop", "layer cake",
                                        "a null deref", "hello"]) == \
        ["security", "style", "performance", "architecture", "correctness", "style"]


def test_ack_flag(spark):
    assert ev(spark, Q.ack_flag, ["Good catch, fixed", "you're right", "typo", "fixed-in", "Thanks!"]) == \
        [True, True, False, True, True]
