"""Prompts and description templates."""

import datetime as dt

from pyspark.sql import functions as F

from ravel.operators import prompts as PR
from ravel.operators import templates as TP

FILE_SCHEMA = "pr_id long, pos long, filename string, additions int, deletions int, changes int, patch string"
JOB_SCHEMA = "pr_id long, repo_full_name string, pr_title string, pr_body string, created_at timestamp_ntz"
CHANGED = [(1, 0, "billing/export.py", 12, 3, 15, "@@ -110,4 +110,6 @@\n-    path = name\n+    path = safe_join(EXPORT_ROOT, name)"),
           (1, 1, "billing/cli.py", 4, 0, 4, "@@ -7,2 +7,3 @@\n+import csv")]


def build(spark, title, body, files, langs, recent):
    jobs = spark.createDataFrame([(1, "o/r", title, body, dt.datetime(2024, 1, 1))], JOB_SCHEMA)
    f = spark.createDataFrame(files, FILE_SCHEMA)
    lg = spark.createDataFrame([("o/r", i, name) for i, name in enumerate(langs)] or [("x", 0, "x")],
                               "repo string, pos long, lang string")
    rc = spark.createDataFrame(recent, "pr_id long, rank int, file_path string, category string, suggestion string")
    return PR.review_prompt(jobs, f, PR.top_languages(lg), rc).first().prompt


def test_title_body_languages_patches_schema(spark):
    p = build(spark, "Keep exports below one folder", "Names came from the request", CHANGED, ["Python", "Cython", "Make", "C"], [])
    assert "Keep exports below one folder" in p and "Names came from the request" in p
    assert "**Languages:** Python, Cython, Make\n" in p
    assert "billing/export.py" in p and "safe_join" in p
    assert '"overallScore"' in p and '"comments"' in p and '"severity"' in p
    assert "Recent issues" not in p
    assert "**Files changed:** 2 (showing top 2 by diff size)" in p


def test_recent_issue_context(spark):
    p = build(spark, "t", "", CHANGED, [], [(1, 1, "billing/cli.py", "style", "Option names differ from the manual")])
    assert "## Recent issues in touched files (last 30 days)\n- [style] billing/cli.py: Option names differ from the manual" in p
    assert "**Description:** No description provided." in p


def test_top_15_of_25_files(spark):
    many = [(1, i, f"pkg/m{i:02}.go", 3 * i, i, 4 * i, f"@@ -1 +1 @@\n+v{i}") for i in range(25)]
    p = build(spark, "Split the package", "", many, [], [])
    assert "pkg/m24.go" in p and "pkg/m10.go" in p and "pkg/m09.go" not in p
    assert "(showing top 15 by diff size)" in p
    assert p.index("pkg/m24.go") < p.index("pkg/m23.go")


def test_null_patch_marker(spark):
    p = build(spark, "t", "", [(1, 0, "docs/plan.pdf", 0, 0, 0, None)], [], [])
    assert "### docs/plan.pdf (+0 -0)\n```diff\n[Binary or no diff available]\n```" in p


GOOD = """
## What
Exports are written below one folder, and the name is checked.
## Why
A name with dots in it could leave the folder.
## Testing
- A name with dots is refused, see the new cases
"""
PARTIAL = "\n## What\nClosed the file after the last row.\n## Testing\nRan the export twice by hand.\n"
PLACEHOLDER = "\n## What\n[Describe what this PR does]\n## Why\nThe export ran out of handles.\n## Testing\n[Describe how you tested this]\n  "
LOWER = "\n## what\nMoved the option parser.\n## why\nTwo tools share it.\n## testing\nBoth tools were started.\n  "


def check(spark, bodies, template=None):
    prs = spark.createDataFrame([(i, "o/r", b) for i, b in enumerate(bodies)], "pr_id long, repo string, body string")
    req = None
    if template is not None:
        req = TP.template_requirements(spark.createDataFrame([("o/r", template)], "repo string, content string"))
    out = TP.template_violations(prs, req).orderBy("pr_id").collect()
    return [[v.id for v in r.violations] for r in out]


def test_default_template_cases(spark):
    good, partial, empty, short, ph, lower = check(spark, [GOOD, PARTIAL, "", "one more try", PLACEHOLDER, LOWER])
    assert good == [] and "why" in partial and empty == ["no_description"] and short == ["no_description"]
    assert any("unfilled" in v for v in ph) and lower == []


def test_body_19_20_chars(spark):
    a, b = check(spark, ["x" * 19, "## What ## Why ## Testing"[:20]])
    assert a == ["no_description"] and b != ["no_description"]


def test_custom_template(spark):
    v = check(spark, ["\n## Goal\nFewer open files at night.\n  "], "\n## Goal\n## Rollback plan\n## Numbers (optional)\n## Numbers\n  ")
    assert v == [["rollback_plan", "numbers"]]


def test_template_comment(spark):
    df = spark.createDataFrame([([],), ([("why", "## Why", "Missing section: **## Why**", "info"),
                                        ("testing", "## Testing", "Missing section: **## Testing**", "info")],)],
                               f"v array<{TP.VIOLATION_TYPE}>")
    none, text = [r[0] for r in df.select(TP.template_comment(F.col("v"), "https://dash.example")).collect()]
    assert none is None
    assert "PR Template Checklist" in text and "## Why" in text and "## Testing" in text and "process reminders" in text
    assert text.endswith("<sub>Code Review Bot · [Dashboard](https://dash.example)</sub>")
