"""Comment-thread collection (P4–P6, J1, J2, W2, A16): turns dumps of PRs,
their changed files and their review comments into raw training examples.

The reference pages through a code host per repo and scans every comment's
replies in a nested loop; here the same rules are joins: replies by the PR
author that acknowledge a comment become one distinct parent id per comment
(a semi-aggregate, never a per-row scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import JS_SPACE, falsy_to, js_trim
from .common import top_n_per_group
from .quality import ack_flag

NIT_PREFIX_RE = r"(?i)\A" + JS_SPACE + r"*nit[:" + JS_SPACE[1:]


def merged_prs(pulls: DataFrame) -> DataFrame:
    """Closed PRs that were merged."""
    return pulls.where((F.col("state") == "closed") & F.col("merged_seq").isNotNull())


def first_n_prs_per_repo(pulls: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` most recently updated merged PRs of each repo (ties by PR
    number). Each task sends at most ``n`` rows of a repo."""
    return top_n_per_group(merged_prs(pulls), ["repo"],
                           [F.col("updated_seq").desc(), F.col("pr_number")], n).drop("rn")


def first_file_per_path(files: DataFrame, pos_col: str = "pos") -> DataFrame:
    """J1 helper: one file record per (repo, pr, path): the first in the
    change's order. Its patch counts even if it is null and a later record of
    the same path has one. An aggregate, so a hot path is combined map-side."""
    first = F.min_by(F.struct("patch"), pos_col).alias("f")
    return files.groupBy("repo", "pr_number", "path").agg(first).select("repo", "pr_number", "path", "f.patch")


def comment_eligibility(comments: DataFrame) -> DataFrame:
    """P5 (text rules): drop bot comments, comments shorter than 30 after
    trim, and comments that begin with 'nit' + ':' or white space."""
    body = F.col("body")
    return comments.where(
        (F.col("user_type") != "Bot")
        & (F.length(js_trim(body)) >= 30)
        & ~body.rlike(NIT_PREFIX_RE))


def comment_file_join(comments: DataFrame, files: DataFrame) -> DataFrame:
    """J1 + P5 (file rule): attach the comment's file, the first of its path
    in (repo, pr); comments whose file is missing or has no patch are dropped."""
    f = first_file_per_path(files).where(F.col("patch").isNotNull() & (F.col("patch") != ""))
    return comments.join(f, ["repo", "pr_number", "path"], "inner")


def author_ack(comments: DataFrame, pulls: DataFrame) -> DataFrame:
    """Per comment, did the PR author reply with an acknowledgement?

    Replies (``in_reply_to_id``) written by the PR's author whose text
    matches X1 are reduced to distinct parent ids, then left-joined back."""
    authors = pulls.select("repo", "pr_number", F.col("author_login").alias("_author"))
    replies = (comments.where(F.col("in_reply_to_id").isNotNull())
               .join(authors, ["repo", "pr_number"])
               .where((F.col("user_login") == F.col("_author")) & ack_flag("body"))
               .select("repo", "pr_number", F.col("in_reply_to_id").alias("comment_id"))
               .distinct()
               .withColumn("author_ack", F.lit(True)))
    return (comments.join(replies, ["repo", "pr_number", "comment_id"], "left")
                    .withColumn("author_ack", F.coalesce("author_ack", F.lit(False))))


def collect_examples(pulls: DataFrame, comments: DataFrame, files: DataFrame,
                     max_prs: int = 200) -> DataFrame:
    """P6 pipeline: raw examples from the first ``max_prs`` merged PRs per
    repo. Body of the PR cut to 500, patch to 2,000 characters (cut before
    any shuffle of the text)."""
    prs = first_n_prs_per_repo(pulls, max_prs)
    keep = prs.select("repo", "pr_number")
    c = comments.join(keep, ["repo", "pr_number"], "left_semi")
    c = author_ack(c, prs)
    c = comment_eligibility(c)
    c = comment_file_join(c, files)
    pr_cols = prs.select("repo", "pr_number", *[x for x in ("pr_title", "pr_body") if x in prs.columns])
    c = c.join(pr_cols, ["repo", "pr_number"])
    out = [F.col("repo"), F.col("pr_number"), F.col("comment_id"),
           (F.col("pr_title") if "pr_title" in c.columns else F.lit(None).cast("string")).alias("pr_title"),
           F.substring(falsy_to(F.col("pr_body") if "pr_body" in c.columns else F.lit(None).cast("string"),
                                F.lit("")), 1, 500).alias("pr_body"),
           F.col("path").alias("file_path"),
           F.substring("patch", 1, 2000).alias("patch"),
           F.col("body").alias("review_comment"),
           (F.col("line") if "line" in c.columns else F.lit(None).cast("int")).alias("comment_line"),
           F.col("author_ack"),
           falsy_to(F.col("reactions"), F.lit(0), kind="number").alias("reactions"),
           (F.col("association") if "association" in c.columns else F.lit(None).cast("string")).alias("association"),
           (F.col("created_at") if "created_at" in c.columns else F.lit(None).cast("timestamp")).alias("created_at")]
    return c.select(*out)


def examples_per_repo(examples: DataFrame) -> DataFrame:
    """Examples per repo plus a grand total (``repo`` null)."""
    return examples.rollup("repo").agg(F.count(F.lit(1)).alias("n"))
