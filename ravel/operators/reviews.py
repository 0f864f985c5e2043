"""Model answers → reviews.

The answer text stays a ``VARIANT`` until it has been validated, so "missing",
built at the end. Every row gets exactly one ``outcome``: valid, partial,
unparsable or quarantine (inputs on which the reference throws, Q9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES, SEVERITIES
from ..functions.render import render
from ..functions.text import JS_SPACE, col_, js_trim, parse_json_strict, variant_type
from .common import compute_once

# ---------------------------------------------------------------- fixed values
UNPARSABLE_SCORE = 70
UNPARSABLE_SUMMARY = "Code Review Bot encountered an issue parsing the AI response. Manual review recommended."
PARTIAL_SCORE = 70
PARTIAL_SUMMARY = "Review completed with validation warnings."
TITLE_MAX = 100
SEVERITY_ICONS = {"critical": "🔴", "warning": "🟡", "info": "🔵", "suggestion": "💡"}
DEFAULT_ICON = "💡"
COMMENT_FOOTER = "\n\n<sub>Code Review Bot</sub>"
EVENT_LABELS = {"APPROVE": "✅ Approved", "REQUEST_CHANGES": "🔴 Changes requested"}
DEFAULT_EVENT_LABEL = "💬 Reviewed"
SUMMARY_TEMPLATE = ("## Code Review Bot — {{label}}\n\n**Quality Score: {{score}}/100**\n\n{{summary}}\n\n"
                    "| Severity | Count |\n|---|---|\n| 🔴 Critical | {{critical}} |\n| Other | {{other}} |")
APPROVE_MIN_SCORE = 85
APPROVE_MAX_COMMENTS = 2
# ------------------------------------------------------------ end fixed values

COMMENT_TYPE = ("struct<filePath:string,line:bigint,category:string,severity:string,title:string,"
                "suggestion:string,codeExample:string,language:string,references:array<string>>")
_NUM = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def strip_fences(c, bare_fence: bool = True) -> Column:
    """Drop a leading ```json fence, then (app variant) a bare leading
    fence, then a trailing fence, then trim. ``bare_fence=False`` is the
    evaluation variant (Q14)."""
    c = col_(c)
    s = F.regexp_replace(c, rf"(?i)\A```json{JS_SPACE}*", "")
    if bare_fence:
        s = F.regexp_replace(s, rf"(?i)\A```{JS_SPACE}*", "")
    # texts without a fence at an end, which are most, meet no pattern
    s = F.when(c.startswith("```"), s).otherwise(c)
    s = F.when(c.endswith("```"), F.regexp_replace(s, rf"(?i){JS_SPACE}*```\z", "")).otherwise(s)
    return js_trim(s)


def _present(t: Column) -> Column:
    """Field exists and is not JSON null."""
    return t.isNotNull() & (t != "VOID")


def _is_int_number(v: Column, path: str) -> Column:
    t = variant_type(v, path)
    d = F.try_variant_get(v, path, "double")
    return t.rlike(_NUM) & (d == F.floor(d))


def comment_violations(x: Column) -> Column:
    """Violation codes of one comment element (a variant)."""
    def t(p):
        return variant_type(x, p)

    def s(p):
        return F.try_variant_get(x, p, "string")

    line_t = t("$.line")
    line_ok = ~_present(line_t) | (_is_int_number(x, "$.line") & (F.try_variant_get(x, "$.line", "double") > 0))
    refs_t = t("$.references")
    refs = F.try_variant_get(x, "$.references", "array<variant>")
    refs_ok = ~refs_t.isNotNull() | (refs_t.startswith("ARRAY") &
                                     F.forall(refs, lambda r: F.schema_of_variant(r) == "STRING"))
    checks = [
        (F.schema_of_variant(x).startswith("OBJECT"), "comment.type"),
        (t("$.filePath") == "STRING", "comment.filePath"),
        (line_ok, "comment.line"),
        ((t("$.category") == "STRING") & s("$.category").isin(*CATEGORIES), "comment.category"),
        ((t("$.severity") == "STRING") & s("$.severity").isin(*SEVERITIES), "comment.severity"),
        ((t("$.title") == "STRING") & (F.length(s("$.title")) <= TITLE_MAX), "comment.title"),
        (t("$.suggestion") == "STRING", "comment.suggestion"),
        (t("$.codeExample").isNull() | (t("$.codeExample") == "STRING"), "comment.codeExample"),
        (t("$.language").isNull() | (t("$.language") == "STRING"), "comment.language"),
        (refs_ok, "comment.references"),
    ]
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in checks]),
                    lambda e: e.isNotNull())


def _typed_comment(x: Column) -> Column:
    return F.try_variant_get(x, "$", COMMENT_TYPE)


def _lenient_ok(x: Column) -> Column:
    """P10: filePath, suggestion and title are strings."""
    return ((variant_type(x, "$.filePath") == "STRING") & (variant_type(x, "$.suggestion") == "STRING")
            & (variant_type(x, "$.title") == "STRING"))


def lenient_comments(df: DataFrame, text: str = "raw_text", out: str = "kept") -> DataFrame:
    """P10: ``df`` with the array of comments that pass the lenient rule, for
    answers that have a list of comments; the others go. Parsed once."""
    v = parse_json_strict(strip_fences(F.col(text)))
    d = compute_once(df, **{out: F.try_variant_get(v, "$.comments", "array<variant>")}).where(F.col(out).isNotNull())
    return d.withColumn(out, F.filter(out, _lenient_ok))


def parse_review(df: DataFrame, text: str = "raw_text", bare_fence: bool = True) -> DataFrame:
    """X19 + X20: parse and validate a model answer.

    Adds ``outcome``, ``overall_score`` (a double: only valid answers have a
    whole number for sure), ``summary``, ``comments`` (typed array) and ``violations`` (array of rule codes, empty when valid)."""
    clean = strip_fences(F.col(text), bare_fence)
    d = compute_once(df, _v=parse_json_strict(clean))
    v = F.col("_v")
    obj = F.schema_of_variant(v).startswith("OBJECT")
    score_t, summ_t, com_t = variant_type(v, "$.overallScore"), variant_type(v, "$.summary"), variant_type(v, "$.comments")
    score_d = F.try_variant_get(v, "$.overallScore", "double")
    arr0 = F.when(com_t.startswith("ARRAY"), F.try_variant_get(v, "$.comments", "array<variant>"))

    top = F.array(
        F.when(~obj, F.lit("review.type")),
        F.when(obj & ~F.coalesce(_is_int_number(v, "$.overallScore"), F.lit(False)), F.lit("overallScore.type")),
        F.when(obj & F.coalesce(score_t.rlike(_NUM) & ((score_d < 0) | (score_d > 100)), F.lit(False)),
               F.lit("overallScore.range")),
        F.when(obj & ~F.coalesce(summ_t == "STRING", F.lit(False)), F.lit("summary.type")),
        F.when(obj & arr0.isNull(), F.lit("comments.type")),
    )
    per_comment = F.flatten(F.transform(F.coalesce(arr0, F.array().cast("array<variant>")), comment_violations))
    violations = F.array_distinct(F.concat(F.filter(top, lambda e: e.isNotNull()), per_comment))
    d = compute_once(d, _arr=arr0, violations=F.when(v.isNotNull(), violations))
    arr = F.col("_arr")

    valid = v.isNotNull() & (F.size("violations") == 0)
    quarantine = v.isNotNull() & (F.is_variant_null(v)
                                  | (obj & _present(com_t) & arr.isNull())
                                  | (arr.isNotNull() & F.exists(arr, lambda x: F.is_variant_null(x))))
    outcome = (F.when(v.isNull(), "unparsable").when(valid, "valid")
                .when(quarantine, "quarantine").otherwise("partial"))

    typed_all = F.transform(arr, _typed_comment)
    typed_lenient = F.transform(F.filter(F.coalesce(arr, F.array().cast("array<variant>")), _lenient_ok),
                                _typed_comment)
    # an answer that fails validation keeps the score it has, fraction and all
    partial_score = F.when(obj & _present(score_t), score_d).otherwise(F.lit(PARTIAL_SCORE).cast("double"))
    partial_summary = F.when(obj & _present(summ_t), F.try_variant_get(v, "$.summary", "string")) \
                       .otherwise(F.lit(PARTIAL_SUMMARY))
    d = compute_once(d, outcome=outcome)
    o = F.col("outcome")
    return compute_once(
        d,
        overall_score=F.when(o == "valid", score_d)
                       .when(o == "unparsable", F.lit(UNPARSABLE_SCORE).cast("double"))
                       .when(o == "partial", partial_score),
        summary=F.when(o == "valid", F.try_variant_get(v, "$.summary", "string"))
                 .when(o == "unparsable", F.lit(UNPARSABLE_SUMMARY))
                 .when(o == "partial", partial_summary),
        comments=F.when(o == "valid", typed_all)
                  .when(o == "unparsable", F.array().cast(f"array<{COMMENT_TYPE}>"))
                  .when(o == "partial", typed_lenient),
    ).drop("_v", "_arr")


def review_decision(critical: Column, score: Column, n_comments: Column) -> Column:
    """Any critical → REQUEST_CHANGES; score ≥ 85 and ≤ 2 comments →
    APPROVE; else COMMENT."""
    return (F.when(critical, "REQUEST_CHANGES")
             .when((score >= APPROVE_MIN_SCORE) & (n_comments <= APPROVE_MAX_COMMENTS), "APPROVE")
             .otherwise("COMMENT"))


def decide(parsed: DataFrame) -> DataFrame:
    """X21 over parsed answers (``comments`` array column)."""
    crit = F.exists("comments", lambda c: c["severity"] == "critical")
    return parsed.withColumn("event", review_decision(F.coalesce(crit, F.lit(False)), F.col("overall_score"),
                                                      F.coalesce(F.size("comments"), F.lit(0))))


def severity_summary(comments: DataFrame, review_col: str = "review_id") -> DataFrame:
    """Per review, comments per severity (fixed pivot values, so no
    extra pass to find them) and critical vs other."""
    p = comments.groupBy(review_col).pivot("severity", SEVERITIES).agg(F.count(F.lit(1))).na.fill(0, SEVERITIES)
    total = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    return p.withColumn("other", total - F.col("critical"))


def rubric_score(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """max(10, 100 − 20·critical − 8·warning − 2·(info + suggestion))
    per review, and its difference from the stored score."""
    s = severity_summary(comments)
    r = reviews.select("id", "overall_score").join(s, reviews.id == s.review_id, "left").drop("review_id")
    r = r.na.fill(0, SEVERITIES)
    rub = F.greatest(F.lit(10), F.lit(100) - 20 * F.col("critical") - 8 * F.col("warning")
                     - 2 * (F.col("info") + F.col("suggestion")))
    return r.select("id", "overall_score", rub.alias("rubric_score"),
                    (F.col("overall_score") - rub).alias("score_minus_rubric"))


def format_comment(category="category", severity="severity", title="title", suggestion="suggestion",
                   code_example="code_example", language="language") -> Column:
    """Markdown body of an inline comment."""
    icons = F.create_map(*[F.lit(x) for kv in SEVERITY_ICONS.items() for x in kv])
    icon = F.coalesce(F.element_at(icons, F.col(severity)), F.lit(DEFAULT_ICON))
    head = render("{{icon}} **[{{category}}] {{title}}**\n\n{{suggestion}}", icon=icon,
                  category=F.col(category), title=F.col(title), suggestion=F.col(suggestion))
    ce = F.col(code_example)
    lang = F.coalesce(F.nullif(F.col(language), F.lit("")), F.lit(""))
    fix = F.when(ce.isNotNull() & (ce != ""),
                 render("\n\n**Suggested fix:**\n```{{lang}}\n{{code}}\n```", lang=lang, code=ce)).otherwise(F.lit(""))
    return F.concat(head, fix, F.lit(COMMENT_FOOTER))


def format_summary(event: Column, score: Column, summary: Column, critical: Column, total: Column) -> Column:
    """Markdown summary with decision label and severity counts."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_LABELS.items() for x in kv]), event),
                       F.lit(DEFAULT_EVENT_LABEL))
    return render(SUMMARY_TEMPLATE, label=label, score=number_text(score), summary=summary, critical=critical,
                  other=total - critical)


def number_text(c: Column) -> Column:
    """A number as JavaScript prints it: no fraction where there is none."""
    whole = c.cast("bigint")
    return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))


REVIEW_KEY = ["repo_full_name", "pr_number", "head_sha"]


def upsert_reviews(existing: DataFrame | None, incoming: DataFrame, seq: str = "id") -> DataFrame:
    """K2: ``INSERT … ON CONFLICT (repo, pr, sha) DO UPDATE SET overall_score``.

    Rows are applied in ``seq`` order: per key the first row supplies every
    column (and the id), the last row supplies ``overall_score``. An
    aggregate (partial + final), so a hot key is combined map-side; applying
    the same batch twice gives the same table."""
    inc = incoming.withColumn("_batch", F.lit(1))
    rows = inc if existing is None else existing.withColumn("_batch", F.lit(0)).unionByName(
        inc, allowMissingColumns=True)
    cols = [c for c in rows.columns if c != "_batch"]
    others = [c for c in cols if c not in REVIEW_KEY + ["overall_score"]]
    order = F.struct(F.col("_batch"), F.col(seq))
    first = F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("_first")
    agg = rows.groupBy(*REVIEW_KEY).agg(first, F.max_by("overall_score", order).alias("overall_score"))
    return agg.select(*REVIEW_KEY, "_first.*", "overall_score").select(*cols)


def review_comment_rows(parsed: DataFrame, review_id: str = "review_id", created_at: Column | None = None) -> DataFrame:
    """K3: one stored-comment row per parsed comment (the write the reference
    never does, Q6). ``created_at``: the time of the write, now by default.
    :func:`ravel.streaming.store.append_comments` gives ids and stores them."""
    when = F.current_timestamp() if created_at is None else created_at
    e = parsed.select(F.col(review_id).alias("review_id"), when.alias("created_at"), F.posexplode("comments").alias("pos", "c"))
    return e.select("review_id", "pos", "created_at",
                    F.col("c.filePath").alias("file_path"), F.col("c.line").alias("line_number"),
                    F.col("c.category").alias("category"), F.col("c.severity").alias("severity"),
                    F.col("c.title").alias("title"), F.col("c.suggestion").alias("suggestion"),
                    F.col("c.codeExample").alias("code_example"))


# ----------------------------------------------------------- constraint audit

REVIEWS_NOT_NULL = ["repo_full_name", "pr_number", "head_sha", "overall_score", "created_at"]
COMMENTS_NOT_NULL = ["review_id", "file_path", "category", "severity", "title", "suggestion"]


def null_audit(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """Nulls per required column, one aggregate pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = f"stack({len(cols)}, " + ", ".join(f"'{c}', `{c}`" for c in cols) + ") AS (column_name, nulls)"
    return one.selectExpr(f"'{table}' AS table_name", stack)


def unique_key_violations(reviews: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    return reviews.groupBy(*REVIEW_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphan_comments(comments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Comments whose review does not exist (anti join)."""
    return comments.join(reviews.select(F.col("id").alias("review_id")), "review_id", "left_anti")


def cascade_delete(comments: DataFrame, surviving_reviews: DataFrame) -> DataFrame:
    """``ON DELETE CASCADE`` — comments kept only for surviving reviews."""
    return comments.join(surviving_reviews.select(F.col("id").alias("review_id")), "review_id", "left_semi")
