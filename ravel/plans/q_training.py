"""Registered thread-collection and training-set queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import threads as T
from ..operators import training as TR
from ..functions.text import JS_SPACE, sql_js_trim
from ..session import ensure_checkpoint_dir
from ..sources import views as V
from . import sqlfrag as S
from .registry import register

N_PRS = 10            # shown by first_n_prs_per_repo
COLLECT_PRS = 200     # PRs a repo that examples are collected from


def _first_n(n: int) -> str:
    return f"""fn AS (SELECT * FROM (SELECT repo, pr_number, author_login, row_number() OVER (PARTITION BY repo ORDER BY updated_seq DESC, pr_number) AS rn
 FROM pulls WHERE state = 'closed' AND merged_seq IS NOT NULL) WHERE rn <= {n})"""


_NIT = r"(?i)^" + JS_SPACE + r"*nit[:" + JS_SPACE[1:]
_ELIGIBLE = (f"c.user_type <> 'Bot' AND length({sql_js_trim('c.body')}) >= 30 AND NOT regexp_matches(c.body, '{_NIT}')")
_FILES = """ff AS (SELECT repo, pr_number, path, first(patch ORDER BY pos) AS patch FROM pr_files GROUP BY repo, pr_number, path)"""
_ACK = f"""ack AS (SELECT DISTINCT c.repo, c.pr_number, c.in_reply_to_id AS comment_id FROM pr_comments c
 JOIN pulls p ON p.repo = c.repo AND p.pr_number = c.pr_number
 WHERE c.in_reply_to_id IS NOT NULL AND c.user_login = p.author_login AND {S.rx('c.body', S.ACK)})"""


@register("merged_prs", "SELECT repo, pr_number FROM pulls WHERE state = 'closed' AND merged_seq IS NOT NULL")
def q_merged(spark, d):
    return T.merged_prs(V.pulls(spark, d)).select("repo", "pr_number")


@register("first_n_prs_per_repo", f"WITH {_first_n(N_PRS)} SELECT repo, pr_number FROM fn")
def q_first_n(spark, d):
    return T.first_n_prs_per_repo(V.pulls(spark, d), N_PRS).select("repo", "pr_number")


@register("comment_eligibility", f"""WITH {_FILES}
SELECT c.comment_id FROM pr_comments c JOIN ff ON ff.repo = c.repo AND ff.pr_number = c.pr_number AND ff.path = c.path
WHERE {_ELIGIBLE} AND ff.patch IS NOT NULL AND ff.patch <> ''""")
def q_eligibility(spark, d):
    c = T.comment_eligibility(V.pr_comments(spark, d))
    return T.comment_file_join(c, V.pr_files(spark, d)).select("comment_id")


@register("comment_file_join", f"""WITH {_FILES}
SELECT c.comment_id, c.path, ff.patch FROM pr_comments c JOIN ff ON ff.repo = c.repo AND ff.pr_number = c.pr_number AND ff.path = c.path
WHERE ff.patch IS NOT NULL AND ff.patch <> ''""")
def q_file_join(spark, d):
    return T.comment_file_join(V.pr_comments(spark, d), V.pr_files(spark, d)).select("comment_id", "path", "patch")


@register("author_ack_join", f"""WITH {_ACK}
SELECT c.comment_id, ack.comment_id IS NOT NULL AS author_ack FROM pr_comments c
LEFT JOIN ack ON ack.repo = c.repo AND ack.pr_number = c.pr_number AND ack.comment_id = c.comment_id""")
def q_author_ack(spark, d):
    return T.author_ack(V.pr_comments(spark, d), V.pulls(spark, d)).select("comment_id", "author_ack")


_COLLECT = f"""{_first_n(COLLECT_PRS)}, {_FILES},
ack AS (SELECT DISTINCT c.repo, c.pr_number, c.in_reply_to_id AS comment_id FROM pr_comments c
 JOIN fn p ON p.repo = c.repo AND p.pr_number = c.pr_number
 WHERE c.in_reply_to_id IS NOT NULL AND c.user_login = p.author_login AND {S.rx('c.body', S.ACK)}),
ex AS (SELECT c.repo, c.pr_number, c.comment_id, c.path AS file_path, substr(ff.patch, 1, 2000) AS patch, c.body AS review_comment,
 ack.comment_id IS NOT NULL AS author_ack, coalesce(nullif(c.reactions, 0), 0) AS reactions, p.pr_title, substr(coalesce(p.pr_body, ''), 1, 500) AS pr_body,
 c.line AS comment_line, c.association, c.created_at
 FROM pr_comments c JOIN fn ON fn.repo = c.repo AND fn.pr_number = c.pr_number
 JOIN pulls p ON p.repo = c.repo AND p.pr_number = c.pr_number
 JOIN ff ON ff.repo = c.repo AND ff.pr_number = c.pr_number AND ff.path = c.path
 LEFT JOIN ack ON ack.repo = c.repo AND ack.pr_number = c.pr_number AND ack.comment_id = c.comment_id
 WHERE {_ELIGIBLE} AND ff.patch IS NOT NULL AND ff.patch <> '')"""


def _collect(spark, d):
    return T.collect_examples(V.pulls(spark, d), V.pr_comments(spark, d), V.pr_files(spark, d), COLLECT_PRS)


@register("project_raw_example", f"WITH {_COLLECT} SELECT * FROM ex")
def q_project(spark, d):
    return _collect(spark, d)


@register("examples_per_repo", f"WITH {_COLLECT} SELECT repo, count(*) AS n FROM ex GROUP BY ROLLUP (repo)")
def q_examples_per_repo(spark, d):
    return T.examples_per_repo(_collect(spark, d))


# ------------------------------------------------------------------ training

def _kept(spark, d):
    return Q.threshold_filter(Q.score_examples(V.raw_examples(spark, d)), 0.65)


_KEPT = f"{S.scored_cte()}, kept AS (SELECT * FROM scored WHERE quality_score >= CAST(0.65 AS DOUBLE))"
_SPLIT = f"""{_KEPT}, sp AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(example_id AS VARCHAR)), example_id) AS pos,
 count(*) OVER () AS n FROM kept),
sp2 AS (SELECT *, CASE WHEN pos <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'eval' END AS split FROM sp)"""

_SEV_SQL = ("CASE WHEN category = 'security' THEN 'critical' WHEN category = 'performance' AND quality_score > 0.8 THEN 'warning' "
            "WHEN category = 'architecture' THEN 'warning' WHEN quality_score > 0.8 THEN 'warning' ELSE 'info' END")
_TARGET_SQL = ("CASE WHEN author_ack THEN greatest(55, 90 - CASE WHEN category = 'security' THEN 25 "
               "WHEN category = 'architecture' THEN 15 ELSE 10 END) ELSE 75 END")


@register("infer_severity", f"WITH {_KEPT} SELECT example_id, {_SEV_SQL} AS severity FROM kept")
def q_infer_severity(spark, d):
    return _kept(spark, d).select("example_id", TR.infer_severity().alias("severity"))


@register("infer_target_score", f"WITH {_KEPT} SELECT example_id, CAST({_TARGET_SQL} AS INT) AS target_score FROM kept")
def q_infer_target(spark, d):
    return _kept(spark, d).select("example_id", TR.infer_target_score().cast("int").alias("target_score"))


_TITLE_SQL = sql_js_trim("substr(regexp_extract(review_comment, '^[^.!?]*', 0), 1, 60)")


@register("title_from_text", f"SELECT example_id, {_TITLE_SQL} AS title FROM raw_examples")
def q_title(spark, d):
    return V.raw_examples(spark, d).select("example_id", TR.title_from_text().alias("title"))


def _with_title(df):
    """PR titles, and descriptions for two of three examples."""
    return df.withColumn("pr_title", F.concat(F.lit("PR #"), F.col("pr_number").cast("string"))) \
             .withColumn("pr_body", F.when(F.col("example_id") % 3 == 0, "").otherwise(F.concat(F.lit("Changes "), "file_path")))


_PROMPT_SQL = S.render_sql(
    TR.USER_PROMPT, title="'PR #' || CAST(pr_number AS VARCHAR)", path="file_path", patch="patch",
    description="CASE WHEN example_id % 3 = 0 THEN '' ELSE '**Description:** Changes ' || file_path || chr(10) END")


@register("user_prompt", f"SELECT example_id, {_PROMPT_SQL} AS prompt FROM raw_examples")
def q_user_prompt(spark, d):
    return _with_title(V.raw_examples(spark, d)).select("example_id", TR.user_prompt().alias("prompt"))


_TARGET_JSON_SQL = S.render_sql(
    TR.TARGET_JSON, score=_TARGET_SQL, summary=S.json_string_sql("substr(review_comment, 1, 200)"),
    path=S.json_string_sql("file_path"),
    line="CASE WHEN comment_line IS NULL OR comment_line = 0 THEN 'null' ELSE CAST(comment_line AS VARCHAR) END",
    category=S.json_string_sql("category"), severity=S.json_string_sql(_SEV_SQL),
    title=S.json_string_sql(_TITLE_SQL), suggestion=S.json_string_sql("review_comment"))


@register("assistant_target_json", f"WITH {_KEPT} SELECT example_id, {_TARGET_JSON_SQL} AS target FROM kept")
def q_assistant_target(spark, d):
    k = _kept(spark, d)
    return k.select("example_id", TR.assistant_target(k).alias("target"))


@register("seeded_order", f"""WITH {_KEPT} SELECT example_id, row_number() OVER (ORDER BY md5('42:' || CAST(example_id AS VARCHAR)), example_id) AS pos FROM kept""")
def q_seeded_order(spark, d):
    return TR.seeded_order(_kept(spark, d), "example_id").select("example_id", "pos")


@register("exact_split", f"WITH {_SPLIT} SELECT example_id, pos, split FROM sp2")
def q_exact_split(spark, d):
    return TR.exact_split(_kept(spark, d), "example_id").select("example_id", "pos", "split")


@register("train_category_share", f"""WITH {_SPLIT}
SELECT category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM sp2 WHERE split = 'train'), 1) AS pct
FROM sp2 WHERE split = 'train' GROUP BY category""")
def q_train_share(spark, d):
    return TR.train_category_share(TR.exact_split(_kept(spark, d), "example_id"))


_MESSAGES_SQL = (f"'system' || chr(10) || {S.sql_str(TR.SYSTEM_PROMPT)} || chr(10) || 'user' || chr(10) || ({_PROMPT_SQL}) || "
                 f"CASE WHEN split = 'train' THEN chr(10) || 'assistant' || chr(10) || ({_TARGET_JSON_SQL}) ELSE '' END")


def _messages():
    """All messages as one text: roles and contents."""
    return F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["content"])), "\n")


@register("chat_messages", f"""WITH {_SPLIT}
SELECT example_id, split, {_MESSAGES_SQL} AS messages, CASE WHEN split = 'eval' THEN {_TARGET_JSON_SQL} END AS expected,
 repo AS meta_repo, category AS meta_category, round(quality_score, 6) AS meta_quality_score,
 CASE WHEN split = 'train' THEN author_ack END AS meta_author_ack FROM sp2""")
def q_chat_messages(spark, d):
    sp = _with_title(TR.exact_split(_kept(spark, d), "example_id"))
    ch = TR.chat_examples(sp)
    return ch.select("example_id", "split",
                     _messages().alias("messages"), "expected",
                     F.col("metadata.repo").alias("meta_repo"), F.col("metadata.category").alias("meta_category"),
                     F.round("metadata.qualityScore", 6).alias("meta_quality_score"),
                     F.col("metadata.authorAck").alias("meta_author_ack"))


@register("sink_jsonl", f"""WITH {_SPLIT}
SELECT example_id, split, CASE WHEN split = 'train' THEN 3 ELSE 2 END AS n_messages, md5({_MESSAGES_SQL}) AS messages_md5,
 CASE WHEN split = 'eval' THEN md5({_TARGET_JSON_SQL}) END AS expected_md5 FROM sp2""")
def q_sink_jsonl(spark, d):
    """K1: write the formatted train/eval examples as JSON lines (one folder
    per split) under the shared checkpoint folder and read them back."""
    sp = _with_title(TR.exact_split(_kept(spark, d), "example_id"))
    out = f"{ensure_checkpoint_dir(spark)}/sink-jsonl-{uuid.uuid4().hex}"
    TR.write_jsonl(TR.chat_examples(sp), out, partition_by="split")
    back = spark.read.schema("example_id bigint, messages array<struct<role:string,content:string>>, expected string, split string").json(out)
    return back.select("example_id", "split", F.size("messages").alias("n_messages"), F.md5(_messages()).alias("messages_md5"),
                       F.md5("expected").alias("expected_md5"))
