"""Training/eval set construction.

Order and split are exact and distributed: the seeded order key is an md5
hex string, positions come from :func:`global_position` (per-prefix counts +
a running sum over at most 4,096 groups), so no window ever runs over the
whole input in one task and the split sizes are exactly floor(n·p).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import json_string, render
from ..functions.text import js_trim
from .common import global_position

# ---------------------------------------------------------------- fixed values
SYSTEM_PROMPT = ("You are Code Review Bot, an expert senior software engineer performing code review. "
                 "You analyse pull request diffs and return a single JSON object with specific, "
                 "actionable review comments. You focus on security vulnerabilities, architectural "
                 "anti-patterns, performance bottlenecks, and correctness issues. You never comment on "
                 "formatting or trivial style. You always return valid JSON matching the provided schema.")

USER_PROMPT = """Review this pull request change and return a JSON review object.

## PR: {{title}}
{{description}}
## Changed file: {{path}}

```diff
{{patch}}
```

Return JSON matching this schema:
{
  "overallScore": <0-100>,
  "summary": "<1-2 sentence assessment>",
  "comments": [
    {
      "filePath": "{{path}}",
      "line": <integer or null>,
      "category": "<security|architecture|performance|style|correctness>",
      "severity": "<critical|warning|info|suggestion>",
      "title": "<max 8 words>",
      "suggestion": "<actionable 1-4 sentence explanation>",
      "codeExample": "<optional improved code>"
    }
  ]
}"""

# JSON.stringify(target, null, 2) layout of the expected answer
TARGET_JSON = """{
  "overallScore": {{score}},
  "summary": {{summary}},
  "comments": [
    {
      "filePath": {{path}},
      "line": {{line}},
      "category": {{category}},
      "severity": {{severity}},
      "title": {{title}},
      "suggestion": {{suggestion}},
      "codeExample": null
    }
  ]
}"""
# ------------------------------------------------------------ end fixed values


def infer_severity(category="category", q="quality_score") -> Column:
    """X10."""
    c, s = F.col(category), F.col(q)
    return (F.when(c == "security", "critical")
             .when((c == "performance") & (s > 0.8), "warning")
             .when(c == "architecture", "warning")
             .when(s > 0.8, "warning").otherwise("info"))


def infer_target_score(ack="author_ack", category="category") -> Column:
    """X11: acknowledged: max(55, 90 − 25/15/10); otherwise 75."""
    c = F.col(category)
    minus = F.when(c == "security", 25).when(c == "architecture", 15).otherwise(10)
    return F.when(F.col(ack), F.greatest(F.lit(55), F.lit(90) - minus)).otherwise(F.lit(75))


def title_from_text(text="review_comment") -> Column:
    """Text before the first '.', '!' or '?', cut to 60, trimmed."""
    first = F.regexp_extract(F.col(text), r"^[^.!?]*", 0)
    return js_trim(F.substring(first, 1, 60))


def user_prompt(title="pr_title", body="pr_body", path="file_path", patch="patch") -> Column:
    """The user message; the description line only when the body is
    non-empty."""
    b = F.col(body)
    desc = F.when(b.isNotNull() & (b != ""), F.concat(F.lit("**Description:** "), b, F.lit("\n"))).otherwise(F.lit(""))
    return render(USER_PROMPT, title=F.col(title), description=desc, path=F.col(path), patch=F.col(patch))


def assistant_target(df: DataFrame) -> Column:
    """The expected answer as JSON text laid out like
    ``JSON.stringify(obj, null, 2)``; line 0/null → null; summary = first
    200 characters."""
    line = F.when(F.col("comment_line").isNull() | (F.col("comment_line") == 0), F.lit("null")) \
            .otherwise(F.col("comment_line").cast("string"))
    return render(TARGET_JSON,
                  score=infer_target_score(),
                  summary=json_string(F.substring("review_comment", 1, 200)),
                  path=json_string(F.col("file_path")),
                  line=line,
                  category=json_string(F.col("category")),
                  severity=json_string(infer_severity()),
                  title=json_string(title_from_text()),
                  suggestion=json_string(F.col("review_comment")))


def seeded_order_key(id_col: str, seed: int = 42) -> Column:
    """Reproducible pseudo-random order key (intent of Q4)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_order(df: DataFrame, id_col: str, seed: int = 42, pos_col: str = "pos",
                 total_col: str | None = None) -> DataFrame:
    """1-based position in the seeded order, ties by id."""
    return global_position(df, seeded_order_key(id_col, seed), [F.col(id_col)], pos_col=pos_col,
                           total_col=total_col)


def exact_split(df: DataFrame, id_col: str, train_share: float = 0.9, seed: int = 42) -> DataFrame:
    """First floor(n·p) rows of the seeded order are 'train', the rest
    'eval'. n is the sum of the prefix counts (no extra pass, no collect)."""
    ordered = seeded_order(df, id_col, seed, total_col="_n")   # n from the prefix-count table
    cut = F.floor(F.col("_n") * F.lit(float(train_share)))
    return ordered.withColumn("split", F.when(F.col("pos") <= cut, "train").otherwise("eval")).drop("_n")


def chat_examples(split_df: DataFrame) -> DataFrame:
    """Train rows get system/user/assistant messages and metadata with
    ``authorAck``; eval rows get system/user messages, ``expected`` and
    metadata without it."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    sys_m, usr_m = msg("system", F.lit(SYSTEM_PROMPT)), msg("user", user_prompt())
    target = assistant_target(split_df)
    is_train = F.col("split") == "train"
    messages = F.when(is_train, F.array(sys_m, usr_m, msg("assistant", target))).otherwise(F.array(sys_m, usr_m))
    meta = F.struct(F.col("repo").alias("repo"), F.col("category").alias("category"),
                    F.col("quality_score").alias("qualityScore"),
                    F.when(is_train, F.col("author_ack")).alias("authorAck"))
    return split_df.select("example_id", "split", "pos", messages.alias("messages"), meta.alias("metadata"),
                           F.when(~is_train, target).alias("expected"))


def train_category_share(split_df: DataFrame) -> DataFrame:
    """Train rows per category and their percent (one decimal)."""
    t = split_df.where(F.col("split") == "train")
    per = t.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())       # one row per category
    return (per.withColumn("pct", F.round(F.col("n") * 100.0 / total, 1))
               .orderBy(F.col("n").desc(), "category"))


def write_jsonl(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """K1: one JSON object per line, replacing what is there; nulls kept."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)
