"""DuckDB (RE2) fragments of the text rules, for oracle SQL only."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.text import JS_SPACE, sql_js_trim, sql_str, words_re2


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {sql_str(pattern)})"


def rx_count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {sql_str(pattern)}))"


ACK = words_re2(P.ACK_1 + P.ACK_2)
ACTIONABLE = words_re2(P.ACTIONABLE_1 + P.ACTIONABLE_2 + P.ACTIONABLE_3)
SPECIFIC = [P.SPECIFIC_BACKTICK, r"\b" + P.SPECIFIC_CALL, words_re2(P.SPECIFIC_PLACE), P.SPECIFIC_QUOTED]
HIGH = words_re2([w for g in P.HIGH_VALUE for w in g])
LOW = [r"(?i)^(" + "|".join(P.LOW_VALUE_PREFIX) + r")[:" + JS_SPACE[1:],
       r"(?i)^(" + "|".join(P.LOW_VALUE_WHOLE) + r")\.?$",
       words_re2(P.LOW_VALUE_WORDS)]


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def flags_select(col: str = "review_comment") -> str:
    spec = " + ".join(f"CAST({rx(col, p)} AS INT)" for p in SPECIFIC)
    low = " OR ".join(rx(col, p) for p in LOW)
    return (f"length({sql_js_trim(col)}) AS _len, {rx(col, ACTIONABLE)} AS _act, ({spec}) AS _spec, "
            f"{rx(col, HIGH)} AS _high, ({low}) AS _low")


def length_points(n: str = "_len") -> str:
    return (f"CASE WHEN {n} < 30 THEN {d(-0.5)} WHEN {n} < 80 THEN {d(0.1)} WHEN {n} <= 400 THEN {d(0.25)} "
            f"WHEN {n} <= 700 THEN {d(0.15)} ELSE {d(-0.1)} END")


def score_expr() -> str:
    z = d(0)
    s = f"({z} + {length_points()})"
    s = f"({s} + CASE WHEN _act THEN {d(0.2)} ELSE {z} END)"
    s = f"({s} + least(_spec * {d(0.1)}, {d(0.25)}))"
    s = f"({s} + CASE WHEN _high THEN {d(0.3)} ELSE {z} END)"
    s = f"({s} - CASE WHEN _low THEN {d(0.4)} ELSE {z} END)"
    s = f"({s} + CASE WHEN author_ack THEN {d(0.2)} ELSE {z} END)"
    s = f"({s} + CASE WHEN reactions >= 3 THEN {d(0.15)} WHEN reactions >= 1 THEN {d(0.05)} ELSE {z} END)"
    s = f"({s} + CASE WHEN association IN ('OWNER', 'MEMBER', 'COLLABORATOR') THEN {d(0.1)} ELSE {z} END)"
    s = f"({s} - CASE WHEN patch IS NOT NULL AND patch <> '' AND _spec = 0 THEN {d(0.1)} ELSE {z} END)"
    return f"greatest({d(0)}, least({d(1)}, {s}))"


def reasons_expr() -> str:
    return ("array_to_string(list_filter([CASE WHEN _len < 30 THEN 'too_short' WHEN _len < 80 THEN NULL "
            "WHEN _len <= 400 THEN 'good_length' WHEN _len <= 700 THEN NULL ELSE 'too_long' END, "
            "CASE WHEN _act THEN 'actionable' END, CASE WHEN _spec > 0 THEN 'specific' END, "
            "CASE WHEN _high THEN 'high_value' END, CASE WHEN _low THEN 'low_value' END, "
            "CASE WHEN author_ack THEN 'author_ack' END, CASE WHEN reactions >= 3 THEN 'reactions' END, "
            "CASE WHEN association IN ('OWNER', 'MEMBER', 'COLLABORATOR') THEN 'trusted_author' END], "
            "lambda x: x IS NOT NULL), ',')")


def category_expr(col: str = "review_comment") -> str:
    parts = " ".join(f"WHEN {rx(col, words_re2(ws))} THEN '{cat}'" for cat, ws in P.CATEGORY_RULES)
    return f"CASE {parts} ELSE 'style' END"


def scored_cte(src: str = "raw_examples") -> str:
    """CTE text: raw examples with score, reasons, category."""
    return (f"f AS (SELECT *, {flags_select()} FROM {src}), "
            f"scored AS (SELECT *, {score_expr()} AS quality_score, {reasons_expr()} AS quality_reasons, "
            f"{category_expr()} AS category FROM f)")


def render_sql(template: str, **exprs: str) -> str:
    """DuckDB twin of :func:`ravel.functions.render.render`."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{\{(\w+)\}\}", template):
        if m.start() > pos:
            parts.append(sql_str(template[pos:m.start()]))
        parts.append(f"coalesce(CAST(({exprs[m.group(1)]}) AS VARCHAR), 'null')")
        pos = m.end()
    if pos < len(template):
        parts.append(sql_str(template[pos:]))
    return "concat(" + ", ".join(parts) + ")"


def json_string_sql(expr: str) -> str:
    return f"CASE WHEN ({expr}) IS NULL THEN 'null' ELSE CAST(to_json({expr}) AS VARCHAR) END"
