"""Review prompt construction.

Per PR the prompt needs its top files (bounded: 15), the recent issues on the
files it touches (bounded: 20) and its repo's top languages (bounded: 3), so
every per-PR collection is small; the only join that could explode — prior
comments on hot files — is done by position (see
:func:`recent_issue_context`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import render
from .common import stored, top_n_per_group

# ---------------------------------------------------------------- fixed values
MAX_FILES = 15
MAX_PATCH = 3000
NO_DIFF = "[Binary or no diff available]"
NO_DESCRIPTION = "No description provided."
RECENT_HEADER = "\n\n## Recent issues in touched files (last 30 days)\n"
RECENT_LIMIT = 20
RECENT_DAYS = 30
FILE_BLOCK = "### {{filename}} (+{{additions}} -{{deletions}})\n```diff\n{{patch}}\n```"
PROMPT = """You are reviewing a pull request. Return ONLY valid JSON matching the schema below — no markdown, no explanation.

## PR Context
**Title:** {{title}}
**Description:** {{body}}
**Languages:** {{languages}}
**Files changed:** {{n_files}} (showing top {{n_shown}} by diff size)
{{recent}}

## Diff
{{diff}}

## Response Schema
```json
{
  "overallScore": <integer 0-100>,
  "summary": "<2-3 sentence overall assessment>",
  "comments": [
    {
      "filePath": "<path/to/file.ext>",
      "line": <integer line number in new file, or null>,
      "category": "<security|architecture|performance|style|correctness>",
      "severity": "<critical|warning|info|suggestion>",
      "title": "<short title, max 8 words>",
      "suggestion": "<actionable explanation, 1-4 sentences>",
      "codeExample": "<optional improved code snippet>",
      "language": "<code language for syntax highlighting, optional>",
      "references": ["<optional CVE/RFC/doc links>"]
    }
  ]
}
```

## Review Guidelines
- **Security**: Flag auth bypasses, injection vectors, hardcoded secrets, insecure defaults, unsafe deserialization, CORS misconfigs
- **Architecture**: Identify tight coupling, missing abstractions, violations of SRP/SOLID, circular dependencies, wrong layer of abstraction
- **Performance**: N+1 queries, missing indexes (infer from ORM usage), unnecessary re-renders, large bundle imports, blocking I/O
- **Correctness**: Race conditions, missing error handling, off-by-one errors, type coercion bugs, null/undefined deref
- **Style**: Naming clarity, function length, dead code, missing tests for critical paths

Scoring:
- Start at 100. Deduct 20 per critical, 8 per warning, 2 per info/suggestion.
- Minimum score: 10.

Be specific. Reference exact variable names, function names, and patterns. Do not flag formatting-only issues if a linter would catch them."""
# ------------------------------------------------------------ end fixed values
DAY_US = 86_400_000_000
FEW_PATHS = 100_000     # up to so many touched (repo, path) are broadcast, some 10 MB


def top_languages(langs: DataFrame, k: int = 3) -> DataFrame:
    """Per repo the first ``k`` languages in insertion order (``pos``,
    not by size), joined by ', ' (D17)."""
    agg = langs.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("pos", "lang"))).alias("_l"))
    return agg.select("repo", F.array_join(F.transform(F.slice("_l", 1, k), lambda s: s["lang"]), ", ")
                      .alias("languages"))


def top_files_per_pr(files: DataFrame, n: int = MAX_FILES) -> DataFrame:
    """Per PR the ``n`` files with most changes, stable on ties (``pos``),
    patch cut to 3,000 characters before anything is shuffled further."""
    f = files.withColumn("patch", F.substring("patch", 1, MAX_PATCH))
    return top_n_per_group(f, ["pr_id"], [F.col("changes").desc(), F.col("pos")], n)


def touched_files_semi(comments_with_repo: DataFrame, job_files: DataFrame) -> DataFrame:
    """Comments on any (repo, path) that a job touches (left semi join)."""
    keys = job_files.select(F.col("repo_full_name").alias("repo"), F.col("filename").alias("path")).distinct()
    c = comments_with_repo.withColumnRenamed("file_path", "path").withColumnRenamed("repo_full_name", "repo")
    return c.join(keys, ["repo", "path"], "left_semi")


def recent_issue_context(jobs: DataFrame, files: DataFrame, reviews: DataFrame, comments: DataFrame,
                         days: int = RECENT_DAYS, limit: int = RECENT_LIMIT) -> DataFrame:
    """Per job, the ``limit`` latest earlier issues (``created_at`` in
    (t − days, t), newest first, ties by comment id) on the files it
    touches, in its repo.

    Exact without pairing every job with every comment on a hot file, nor with
    ``limit`` comments of each of its files, and in steps each of which is
    stored, so that the disk holds the shuffles of one step at a time:

    1. a probe per (job, path) at t; comments on a (repo, path) leave at once
       if no probe of it can reach back to them;
    2. time is cut into blocks of ``days``; the comments of a (repo, path,
       block) are numbered from the block's end, ``limit`` of them make a slot.
       A probe among them learns how many come before it, the newest one and
       the times of the 1st, 2nd, 4th, 8th, ... newest one;
    3. a probe with fewer than ``limit`` comments before it in its block learns
       the same of the block before, which is as far as ``days`` reach;
    4. a path whose newest comment is not among the ``limit`` newest ones of
       the job's paths cannot hold any of the answer, so at most ``limit``
       probes per job go on. The times they know count a part, over a half, of
       the job's comments since any time: those since a time by which they
       count ``limit`` hold the answer, and a path whose newest comment is
       preceded by n others holds at most ``limit`` − n of it;
    5. a probe meets the slots that hold just these comments by an equi-join;
       a per-job top-``limit`` ends it.
    """
    span = int(days) * DAY_US
    place = ["file", "block"]      # the file is a number for its repo and path, which are longer
    us = F.unix_micros(F.col("t").cast("timestamp"))
    block = F.expr(f"(us - pmod(us, {span}L)) div {span}L")
    # of several jobs of one id the latest counts; joined on pr_id, so the grouping needs no exchange of its own
    probes = (files.select("pr_id", F.col("filename").alias("path"))
              .join(jobs.select("pr_id", F.col("repo_full_name").alias("repo"), F.col("created_at").alias("t")), "pr_id")
              .groupBy("repo", "path", F.col("pr_id").alias("ref")).agg(F.max("t").alias("t"))
              .where("t IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL"))
    probes = stored(probes.select("repo", "path", "ref", us.alias("us")), "probes")
    touched = probes.groupBy("repo", "path").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    touched = stored(touched.withColumn("file", F.monotonically_increasing_id()), "touched")
    touched = F.broadcast(touched) if touched.count() <= FEW_PATHS else touched.hint("merge")
    ev = (comments.select(F.col("id").alias("ref"), "review_id", F.col("file_path").alias("path"), "category", "suggestion")
          .join(reviews.select(F.col("id").alias("review_id"), F.col("repo_full_name").alias("repo"),
                               F.col("created_at").alias("t")).where("t IS NOT NULL").withColumn("us", us), "review_id")
          .join(touched, ["repo", "path"]).where((F.col("us") < F.col("last")) & (F.col("us") > F.col("first") - span))   # J5 pruning
          .select("file", "us", F.lit(True).alias("issue"), "ref", "t", "path", "category", "suggestion"))
    ev = stored(ev, "issues")
    # moved by place as it is; what is made for the numbering is made afterwards
    u = (probes.join(touched, ["repo", "path"]).select("file", "us", F.lit(False).alias("issue"), "ref")
         .unionByName(ev, allowMissingColumns=True).withColumn("block", block).repartition(*place)
         .withColumn("at", F.when(F.col("issue"), F.col("us"))).withColumn("newer", F.when(F.col("issue"), _newer(F.col("ref")))))
    # a probe comes before comments of its own time, which are not earlier; of
    # comments of equal time the lowest id is the newest
    order = Window.partitionBy(*place).orderBy("us", "issue", "newer")
    nth = "lag(at, {}) IGNORE NULLS OVER (PARTITION BY file, block ORDER BY us, issue, newer) AS at{}"
    depths = [2 ** i for i in range(int(limit).bit_length())]
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    probe = lambda c: F.when(~F.col("issue"), c)
    u = u.select("*", F.count("at").over(so_far).alias("n"), F.count("at").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"),
                 F.last(F.when(F.col("issue"), F.struct("us", "newer")), ignorenulls=True).over(so_far).alias("head"),
                 *[F.expr(nth.format(d, d)) for d in depths])
    # back: how many comments of the block come after the probe, or after the comment
    u = stored(u.select(*place, "us", "issue", "ref", "t", "path", "category", "suggestion", (F.col("size") - F.col("n")).alias("back"),
                        probe(F.col("n")).alias("n"), probe(F.col("head")).alias("head"),
                        probe(F.array_compact(F.array(*[f"at{d}" for d in depths]))).alias("times")), "placed")
    cm = u.where("issue").select(*place, "back", F.floor(F.col("back") / limit).alias("slot"), F.col("us").alias("at"),
                                 F.col("t").alias("comment_at"), F.col("ref").alias("comment_id"), "path", "category", "suggestion")
    pr = u.where("NOT issue").select(*place, "us", F.col("ref").alias("pr_id"), "back", "n", "head", "times")
    last = (cm.where((F.col("back") + 1).isin(depths)).groupBy("file", (F.col("block") + 1).alias("block"))
            .agg(F.max(F.struct(F.col("at").alias("us"), _newer(F.col("comment_id")).alias("newer"))).alias("old_head"),
                 F.array_sort(F.collect_list(F.struct("back", "at"))).alias("old")))
    reached = F.filter("old", lambda o: o["at"] > F.col("us") - span)
    known = pr.where(F.col("n") < limit).join(last, place, "left").withColumn("old", reached).withColumn(
        "head", F.coalesce("head", F.when(F.size("old") > 0, F.col("old_head")))).drop("old_head")
    known = known.unionByName(pr.where(F.col("n") >= limit), allowMissingColumns=True).where("head IS NOT NULL")
    best = top_n_per_group(known, ["pr_id"], [F.col("head").desc()], limit)
    meets = stored(_meets(best, depths, span, limit), "meets")
    cand = meets.join(cm, [*place, "slot"]).where(
        F.col("back").between(F.col("from"), F.col("to")) & (F.col("at") > F.col("us") - span)
        & (F.col("since").isNull() | (F.col("at") >= F.col("since")))
        & (F.col("bound").isNull() | (F.struct("at", _newer(F.col("comment_id"))) >= F.col("bound"))))
    top = top_n_per_group(cand.select("pr_id", "path", "comment_id", "category", "suggestion", "comment_at"), ["pr_id"],
                          [F.col("comment_at").desc(), F.col("comment_id")], limit, rank_col="rank")
    return top.select("pr_id", "rank", "comment_id", F.col("path").alias("file_path"), "category", "suggestion",
                      "comment_at")


def _meets(best: DataFrame, depths: list[int], span: int, limit: int) -> DataFrame:
    """The slots in which the best probes of each job (steps 4 and 5 of
    :func:`recent_issue_context`) find their part of the answer, with the
    numbers, ``from`` to ``to``, of the comments in question, and the bounds
    of the job: its ``limit``-th newest head and the time ``since`` which it
    is known to have ``limit`` comments."""
    job = Window.partitionBy("pr_id")
    best = best.withColumn("bound", F.max(F.when(F.col("rn") == limit, F.col("head"))).over(job))
    # a time counts the comments between it and the time before it in the list; the newest one of the
    # block before counts those of the probe's block that are older than its last time, too
    step = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.shiftright(F.element_at(F.lit(depths), i + 1), 1)).cast("bigint")
    counted = F.when(F.size("times") > 0, F.element_at(F.lit(depths), F.size("times"))).otherwise(F.lit(0))
    here = F.transform("times", lambda t, i: F.struct(t.alias("time"), step(i).alias("w")))
    back = F.transform("old", lambda o, i: F.struct(o["at"].alias("time"), (step(i) + F.when(i == 0, F.col("n") - counted).otherwise(F.lit(0))).alias("w")))
    marks = F.concat(here, F.coalesce(back, F.array().cast("array<struct<time:bigint,w:bigint>>")))
    marks = F.filter(marks, lambda m: F.col("bound").isNull() | (m["time"] >= F.col("bound.us")))
    rows = best.select("*", F.posexplode(marks).alias("i", "mark"))
    rows = rows.select("pr_id", "i", "mark.time", "mark.w", F.when(F.col("i") == 0, F.struct(
        "file", "block", "us", "back", "n", "bound")).alias("probe"))
    newest = job.orderBy(F.col("time").desc())
    rows = rows.select("*", F.sum("w").over(newest.rangeBetween(Window.unboundedPreceding, 0)).alias("known"),
                       F.coalesce(F.sum("w").over(newest.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("newer"))
    since = F.max(F.when(F.col("known") >= limit, F.col("time"))).over(newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("since", since).where((F.col("i") == 0) & (F.col("newer") < limit))
    rows = rows.select("pr_id", "probe.*", "since", (F.lit(limit) - F.col("newer")).alias("depth"))
    to = F.col("back") + F.least("depth", "n") - 1
    at = lambda b, s, x, y: F.struct(b.alias("block"), s.cast("bigint").alias("slot"), x.alias("from"), y.alias("to"))
    zero = F.lit(0).cast("bigint")
    here = F.when(F.col("n") > 0, F.transform(F.sequence(F.floor(F.col("back") / limit), F.floor(to / limit)),
                                              lambda s: at(F.col("block"), s, F.col("back"), to)))
    back = F.when((F.col("depth") > F.col("n")) & (F.col("since").isNull() | (F.col("since") < F.col("block") * span)),
                  F.array(at(F.col("block") - 1, zero, zero, F.col("depth") - F.col("n") - 1)))
    empty = F.array().cast("array<struct<block:bigint,slot:bigint,from:bigint,to:bigint>>")
    return rows.select("file", "us", "pr_id", "bound", "since", F.inline(F.concat(F.coalesce(here, empty), F.coalesce(back, empty))))


def _newer(comment_id: Column) -> Column:
    """Among comments of equal time the larger of these numbers comes first in
    the answer: the lower id, and null before all."""
    return F.coalesce(F.bitwise_not(comment_id.cast("bigint")), F.lit(2**63 - 1))


def shown_files(files: DataFrame) -> DataFrame:
    """Per PR the number of its files and those that a prompt shows. Stored:
    the shuffles of all files are gone before issues and prompts are made."""
    n_files = files.groupBy("pr_id").agg(F.count(F.lit(1)).alias("n_files"))
    shown = top_files_per_pr(files).groupBy("pr_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "filename", "additions", "deletions", "patch"))).alias("_d"))
    return stored(n_files.join(shown, "pr_id"), "shown")


def review_prompt(jobs: DataFrame, files: DataFrame, languages: DataFrame, recent: DataFrame,
                  shown: DataFrame | None = None) -> DataFrame:
    """The full prompt per job. PRs without files, issues or languages
    are kept (left joins); every per-PR list is bounded before it is
    collected, and texts are made last. ``shown`` is what
    :func:`shown_files` makes of the files, where that is known."""
    shown = shown_files(files) if shown is None else shown
    block = lambda f: render(FILE_BLOCK, filename=f["filename"], additions=f["additions"], deletions=f["deletions"],
                             patch=F.when(f["patch"].isNull() | (f["patch"] == ""), F.lit(NO_DIFF)).otherwise(f["patch"]))
    line = F.concat(F.lit("- ["), F.col("category"), F.lit("] "), F.col("file_path"), F.lit(": "), F.col("suggestion"))
    rec = recent.groupBy("pr_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("txt")))).alias("_r"))
    j = (jobs.join(languages.withColumnRenamed("repo", "repo_full_name"), "repo_full_name", "left")
             .join(shown, "pr_id", "left").join(rec, "pr_id", "left"))
    body = F.col("pr_body")
    diff = F.array_join(F.transform("_d", block), "\n\n")
    issues = F.concat(F.lit(RECENT_HEADER), F.array_join(F.transform("_r", lambda s: s["txt"]), "\n"))
    prompt = render(PROMPT, title=F.col("pr_title"),
                    body=F.when(body.isNull() | (body == ""), F.lit(NO_DESCRIPTION)).otherwise(body),
                    languages=F.coalesce("languages", F.lit("")),
                    n_files=F.coalesce("n_files", F.lit(0)), n_shown=F.when(F.col("_d").isNull(), 0).otherwise(F.size("_d")),
                    recent=F.coalesce(issues, F.lit("")), diff=F.coalesce(diff, F.lit("")))
    return j.select("pr_id", "repo_full_name", prompt.alias("prompt"))
