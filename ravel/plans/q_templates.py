"""Registered PR-template queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import DEFAULT_SECTIONS
from ..functions.text import JS_SPACE, sql_js_trim, sql_str
from ..operators import templates as TP
from ..sources import views as V
from .registry import register


def _re2(p: str) -> str:
    return "(?i)" + p.replace(r"\s", JS_SPACE)


def _default_ids_sql(b: str = "body") -> str:
    items = []
    for sid, pat, ph, _label, _desc in DEFAULT_SECTIONS:
        items.append(f"CASE WHEN NOT regexp_matches({b}, {sql_str(_re2(pat))}) THEN '{sid}' "
                     f"WHEN regexp_matches({b}, {sql_str(_re2(ph))}) THEN '{sid}_unfilled' END")
    listed = "array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), ',')"
    return f"CASE WHEN {b} IS NULL OR length({sql_js_trim(b)}) < 20 THEN 'no_description' ELSE {listed} END"


def _ids(col):
    return F.array_join(F.transform(col, lambda v: v["id"]), ",")


@register("template_violations", f"SELECT pr_id, {_default_ids_sql()} AS violation_ids FROM pr_bodies")
def q_template_violations(spark, d):
    return TP.template_violations(V.pr_bodies(spark, d)).select("pr_id", _ids(F.col("violations")).alias("violation_ids"))


_REQ_SQL = f"""lines AS (SELECT repo, i - 1 AS line_no, string_split(content, chr(10))[i] AS line
  FROM pr_templates, range(1, len(string_split(content, chr(10))) + 1) t(i)),
req AS (SELECT repo, line_no, {sql_js_trim("regexp_extract(line, '^##" + JS_SPACE + "+(.+)', 1)")} AS header FROM lines
  WHERE regexp_matches(line, '^##{JS_SPACE}+.')),
req2 AS (SELECT repo, line_no, regexp_replace(lower(header), '{JS_SPACE}+', '_', 'g') AS id, '## ' || header AS label, header
  FROM req WHERE NOT regexp_matches(header, '(?i)optional'))"""


@register("template_requirements", f"WITH {_REQ_SQL} SELECT repo, CAST(line_no AS INT) AS line_no, id, label FROM req2")
def q_template_requirements(spark, d):
    return TP.template_requirements(V.pr_templates(spark, d)).select("repo", "line_no", "id", "label")


@register("template_violations_custom", f"""WITH {_REQ_SQL},
pairs AS (SELECT b.pr_id, r.line_no, r.id, regexp_matches(b.body, '(?i)##{JS_SPACE}*' || regexp_replace(r.header, '([.*+?^$()|\\[\\]\\\\{{}}])', '\\\\\\1', 'g')) AS has
  FROM pr_bodies b JOIN req2 r ON r.repo = b.repo),
miss AS (SELECT pr_id, string_agg(id, ',' ORDER BY line_no) AS ids FROM pairs WHERE NOT has GROUP BY pr_id)
SELECT b.pr_id, CASE WHEN b.repo NOT IN (SELECT repo FROM pr_templates) THEN {_default_ids_sql('b.body')}
  WHEN b.body IS NULL OR length({sql_js_trim('b.body')}) < 20 THEN 'no_description' ELSE coalesce(m.ids, '') END AS violation_ids
FROM pr_bodies b LEFT JOIN miss m ON m.pr_id = b.pr_id""")
def q_template_custom(spark, d):
    req = TP.template_requirements(V.pr_templates(spark, d))
    return TP.template_violations(V.pr_bodies(spark, d), req).select(
        "pr_id", _ids(F.col("violations")).alias("violation_ids"))


def _comment_sql(b: str = "body") -> str:
    items = []
    for sid, pat, ph, label, desc in DEFAULT_SECTIONS:
        missing = sql_str(TP.MISSING_ISSUE.format(label=label, description=desc))
        unfilled = sql_str(TP.UNFILLED_ISSUE.format(label=label))
        items.append(f"CASE WHEN NOT regexp_matches({b}, {sql_str(_re2(pat))}) THEN {missing} "
                     f"WHEN regexp_matches({b}, {sql_str(_re2(ph))}) THEN {unfilled} END")
    listed = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    issues = (f"CASE WHEN {b} IS NULL OR length({sql_js_trim(b)}) < 20 THEN [{sql_str(TP.NO_DESCRIPTION[2])}] "
              f"ELSE {listed} END")
    head = "[" + ", ".join(sql_str(x) for x in TP.COMMENT_HEAD) + "]"
    tail = "[" + ", ".join(sql_str(x) for x in TP.COMMENT_TAIL + [TP.FOOTER.format(url="https://dashboard.example")]) + "]"
    return (f"CASE WHEN len({issues}) = 0 THEN NULL ELSE array_to_string(list_concat(list_concat({head}, "
            f"list_transform({issues}, lambda v: '- ' || v)), {tail}), chr(10)) END")


@register("template_comment", f"SELECT pr_id, {_comment_sql()} AS comment FROM pr_bodies")
def q_template_comment(spark, d):
    v = TP.template_violations(V.pr_bodies(spark, d))
    return v.select("pr_id", TP.template_comment(F.col("violations"), "https://dashboard.example").alias("comment"))
