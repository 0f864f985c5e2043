"""Registered prompt-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prompts as PR
from ..operators.common import stored
from ..sources import views as V
from . import sqlfrag as S
from .registry import register

_J6_SQL = """ri AS (SELECT * FROM (SELECT j.pr_id, rc.id AS comment_id, rc.file_path, rc.category, rc.suggestion,
  row_number() OVER (PARTITION BY j.pr_id ORDER BY r.created_at DESC, rc.id) AS rank
 FROM review_jobs j JOIN (SELECT DISTINCT pr_id, filename FROM changed_files) f ON f.pr_id = j.pr_id
 JOIN review_comments rc ON rc.file_path = f.filename
 JOIN reviews r ON r.id = rc.review_id AND r.repo_full_name = j.repo_full_name
 WHERE r.created_at > j.created_at - INTERVAL 30 DAY AND r.created_at < j.created_at) WHERE rank <= 20)"""
_LANG_SQL = """lg AS (SELECT repo, array_to_string(list_slice(list(lang ORDER BY pos), 1, 3), ', ') AS languages FROM repo_languages GROUP BY repo)"""


def _recent(spark, d, files=None):
    return PR.recent_issue_context(V.review_jobs(spark, d), V.changed_files(spark, d) if files is None else files,
                                   V.reviews(spark, d), V.review_comments(spark, d))


@register("top_languages", f"WITH {_LANG_SQL} SELECT * FROM lg")
def q_top_languages(spark, d):
    return PR.top_languages(V.repo_languages(spark, d))


@register("top_files_per_pr", """SELECT pr_id, pos, rn FROM (SELECT pr_id, pos,
 row_number() OVER (PARTITION BY pr_id ORDER BY changes DESC, pos) AS rn FROM changed_files) WHERE rn <= 15""")
def q_top_files(spark, d):
    return PR.top_files_per_pr(V.changed_files(spark, d)).select("pr_id", "pos", F.col("rn").cast("long").alias("rn"))


@register("touched_files_semi", """SELECT rc.id FROM review_comments rc JOIN reviews r ON r.id = rc.review_id
WHERE (r.repo_full_name, rc.file_path) IN (SELECT DISTINCT j.repo_full_name, f.filename FROM review_jobs j JOIN changed_files f ON f.pr_id = j.pr_id)""")
def q_touched(spark, d):
    r = V.reviews(spark, d).select(F.col("id").alias("review_id"), "repo_full_name")
    c = V.review_comments(spark, d).join(r, "review_id")
    jf = V.changed_files(spark, d).join(V.review_jobs(spark, d).select("pr_id", "repo_full_name"), "pr_id")
    return PR.touched_files_semi(c, jf).select("id")


@register("recent_issue_context", f"WITH {_J6_SQL} SELECT pr_id, rank, comment_id, file_path, category, suggestion FROM ri")
def q_recent(spark, d):
    return _recent(spark, d).select("pr_id", F.col("rank").cast("long").alias("rank"), "comment_id", "file_path",
                                    "category", "suggestion")


_PROMPT_SQL = S.render_sql(
    PR.PROMPT, title="j.pr_title", body="CASE WHEN j.pr_body IS NULL OR j.pr_body = '' THEN 'No description provided.' ELSE j.pr_body END",
    languages="coalesce(lg.languages, '')", n_files="coalesce(nf.n_files, 0)", n_shown="coalesce(df.n_shown, 0)",
    recent="coalesce(rc.recent, '')", diff="coalesce(df.diff, '')")


@register("review_prompt", f"""WITH nf AS (SELECT pr_id, count(*) AS n_files FROM changed_files GROUP BY pr_id),
tf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY changes DESC, pos) AS rn FROM changed_files) WHERE rn <= 15),
df AS (SELECT pr_id, count(*) AS n_shown, string_agg('### ' || filename || ' (+' || CAST(additions AS VARCHAR) || ' -' || CAST(deletions AS VARCHAR)
  || ')' || chr(10) || '```diff' || chr(10) || CASE WHEN patch IS NULL OR patch = '' THEN '[Binary or no diff available]' ELSE substr(patch, 1, 3000) END
  || chr(10) || '```', chr(10) || chr(10) ORDER BY rn) AS diff FROM tf GROUP BY pr_id),
{_J6_SQL},
rc AS (SELECT pr_id, {S.sql_str(PR.RECENT_HEADER)} || string_agg('- [' || category || '] ' || file_path || ': ' || suggestion, chr(10) ORDER BY rank) AS recent
 FROM ri GROUP BY pr_id),
{_LANG_SQL}
SELECT j.pr_id, j.repo_full_name, {_PROMPT_SQL} AS prompt FROM review_jobs j LEFT JOIN nf ON nf.pr_id = j.pr_id
LEFT JOIN df ON df.pr_id = j.pr_id LEFT JOIN rc ON rc.pr_id = j.pr_id LEFT JOIN lg ON lg.repo = j.repo_full_name""")
def q_review_prompt(spark, d):
    files = stored(V.changed_files(spark, d), "files")      # read three times
    shown = PR.shown_files(files)
    return PR.review_prompt(V.review_jobs(spark, d), files, PR.top_languages(V.repo_languages(spark, d)),
                            _recent(spark, d, files), shown)
