"""PR-template checks.

The default sections are fixed patterns, so their check is a column
expression per PR. A repo's own template becomes rows (one per required
section, with a per-row regex built from the header) joined to that repo's
PRs; each PR's violations are collected in section order (bounded by the
number of sections of its template).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import DEFAULT_SECTIONS
from ..functions.text import JS_SPACE, js_trim

# ---------------------------------------------------------------- fixed values
MIN_BODY = 20
NO_DESCRIPTION = ("no_description", "PR description", "PR has no description. Please fill in the PR template.", "warning")
MISSING_ISSUE = "Missing section: **{label}** — {description}"
UNFILLED_ISSUE = "Section **{label}** appears to still have placeholder text. Please fill it in."
COMMENT_HEAD = ["## ⚠️ PR Template Checklist", "", "Code Review Bot noticed the following sections may need attention:", ""]
COMMENT_TAIL = ["", "*These are process reminders, not code issues. The AI code review has proceeded regardless.*", ""]
FOOTER = "<sub>Code Review Bot · [Dashboard]({url})</sub>"
# ------------------------------------------------------------ end fixed values

VIOLATION_TYPE = "struct<id:string,label:string,issue:string,severity:string>"
_REGEX_META = r"([.*+?^${}()|\[\]\\])"


def _java(p: str) -> str:
    """JS pattern with /i → Java: case-insensitive, JS white space for \\s."""
    return "(?iu)" + p.replace(r"\s", JS_SPACE)


def _violation(id_: Column, label: Column, issue: Column, severity: str) -> Column:
    return F.struct(id_.alias("id"), label.alias("label"), issue.alias("issue"), F.lit(severity).alias("severity"))


def _no_description(body: Column) -> Column:
    return body.isNull() | (F.length(js_trim(body)) < MIN_BODY)


def default_violations(body_col: str = "body") -> Column:
    """X31 with the default sections: array of violation structs."""
    b = F.col(body_col)
    items = []
    for sid, pat, placeholder, label, desc in DEFAULT_SECTIONS:
        missing = ~b.rlike(_java(pat))
        unfilled = b.rlike(_java(placeholder))
        items.append(F.when(missing, _violation(F.lit(sid), F.lit(label),
                                                F.lit(MISSING_ISSUE.format(label=label, description=desc)), "info"))
                      .when(unfilled, _violation(F.lit(f"{sid}_unfilled"), F.lit(label),
                                                 F.lit(UNFILLED_ISSUE.format(label=label)), "info")))
    listed = F.filter(F.array(*items), lambda x: x.isNotNull())
    nd = F.array(_violation(*[F.lit(x) for x in NO_DESCRIPTION[:3]], NO_DESCRIPTION[3]))
    return F.when(_no_description(b), nd).otherwise(listed)


def template_requirements(templates: DataFrame) -> DataFrame:
    """Required sections of each repo's template: ``## `` headers in
    line order, headers mentioning 'optional' skipped; id = lower case with
    white space runs → '_'; ``pattern`` is the header as a case-insensitive
    Java regex after ``##`` and optional white space."""
    lines = templates.select("repo", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    m = F.regexp_extract("line", r"^##" + JS_SPACE + r"+(.+)", 1)
    h = lines.withColumn("header", js_trim(m)).where(F.col("line").rlike(r"^##" + JS_SPACE + r"+.") & (m != ""))
    h = h.where(~F.col("header").rlike("(?i)optional"))
    esc = F.regexp_replace("header", _REGEX_META, r"\\$1")
    return h.select(
        "repo", "line_no",
        F.regexp_replace(F.lower("header"), JS_SPACE + "+", "_").alias("id"),
        F.concat(F.lit("## "), F.col("header")).alias("label"),
        F.concat(F.lit("(?iu)##" + JS_SPACE + "*"), esc).alias("pattern"),
        F.col("header").alias("description"))


def template_violations(prs: DataFrame, requirements: DataFrame | None = None,
                        body_col: str = "body") -> DataFrame:
    """Per PR an ordered array of violations. PRs of repos with a
    template are checked against its sections (regex per row); the others
    against the default sections."""
    if requirements is None:
        return prs.withColumn("violations", default_violations(body_col))
    b = F.col(body_col)
    # a repo's sections are one row, bounded by its template; so each body is joined once and stays where it is
    section = F.struct("line_no", "id", "label", "pattern", "description")
    of_repo = requirements.groupBy("repo").agg(F.array_sort(F.collect_list(section)).alias("_sections"))
    missing = F.transform(
        F.filter("_sections", lambda s: ~F.regexp_like(b, s["pattern"])),
        lambda s: _violation(s["id"], s["label"], F.concat(F.lit("Missing section: **"), s["label"], F.lit("** — "), s["description"]), "info"))
    nd = F.array(_violation(*[F.lit(x) for x in NO_DESCRIPTION[:3]], NO_DESCRIPTION[3]))
    custom = F.when(_no_description(b), nd).otherwise(missing)
    return (prs.join(of_repo, "repo", "left")
               .withColumn("violations", F.when(F.col("_sections").isNull(), default_violations(body_col)).otherwise(custom))
               .select(*prs.columns, "violations"))


def template_comment(violations: Column, dashboard_url: str = "") -> Column:
    """Markdown checklist of the violations; null when there are none."""
    lines = F.transform(violations, lambda v: F.concat(F.lit("- "), v["issue"]))
    parts = F.concat(F.array(*[F.lit(x) for x in COMMENT_HEAD]), lines,
                     F.array(*[F.lit(x) for x in COMMENT_TAIL]), F.array(F.lit(FOOTER.format(url=dashboard_url))))
    return F.when(F.size(violations) == 0, F.lit(None).cast("string")).otherwise(F.array_join(parts, "\n"))
