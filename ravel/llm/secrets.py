"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a document is content-addressed by the SHA-256 of its text
(a blob). The ledger is a Parquet table (rule_version, blob, spans) of blobs
already scanned with a set of rules; only unseen (blob, rule version) pairs
are scanned, each once however many paths hold it, and the findings are
joined back to all paths."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import compute_once
from .common import fresh, running_sum


def either_case(word: str) -> str:
    """A pattern for ``word`` with ASCII letters in either case, the same in
    every regex dialect."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, of which group
    ``group`` has at least ``least`` characters. ``base`` rules are the fixed
    ones; the others are added by this method."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


_NAMES = "|".join([either_case(w) for w in ("password", "passwd", "secret", "token", "api_")]) \
    .replace("_", "_?") + either_case("key")

# In the order in which spans with the same start are listed. A run of hex
# digits or of an access key's characters matches as a whole, so the least
# length can stand in the pattern.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("githost", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
)


def rules_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _rule_spans(text: str, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of one rule's matches. The pieces
    between matches (``split``) and the matches themselves alternate, so the
    running sum of their lengths gives the positions in code points."""
    t, pat = F.col(text), F.lit(rule.pattern)
    hits = F.regexp_extract_all(t, pat, F.lit(0))
    vals = F.regexp_extract_all(t, pat, F.lit(rule.group)) if rule.group else hits
    gaps = F.split(t, rule.pattern, -1)
    n = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")),
                    lambda x: F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0)))
    ends = running_sum(F.slice(n, 1, F.size(hits)))
    rows = F.transform(
        F.arrays_zip(ends.alias("e"), hits.alias("h"), vals.alias("v")),
        lambda x: F.struct((x["e"] - F.length(x["h"])).cast("bigint").alias("start"), F.lit(order).alias("ord"),
                           x["e"].cast("bigint").alias("end"), F.lit(rule.kind).alias("kind"),
                           F.length(x["v"]).alias("n")))
    kept = F.transform(F.filter(rows, lambda x: x["n"] >= rule.least),
                       lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"]))
    return F.when(t.rlike(rule.pattern), kept).otherwise(
        F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>"))


def find_spans(text: str, rules=RULES) -> Column:
    """All spans of a text, by start, then in the order of the rules."""
    return F.sort_array(F.concat(*[_rule_spans(text, r, k) for k, r in enumerate(rules)]))


def read_ledger(spark: SparkSession, ledger: str, version: str) -> DataFrame | None:
    """The scanned blobs of a rule version (null where there are none yet). A
    blob that a repeated run has entered twice is taken once."""
    try:
        df = spark.read.parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return df.where(F.col("rule_version") == version).select("blob", "spans")


def update_ledger(versions: DataFrame, ledger: str, text: str = "text", rules=RULES) -> DataFrame:
    """Scan the blobs of ``versions`` that the ledger lacks for these rules,
    append them, and return the ledger's (blob, spans) of this rule version."""
    spark, version = versions.sparkSession, rules_version(rules)
    blobs = versions.select(address(F.col(text)).alias("_blob"), F.coalesce(F.col(text), F.lit("")).alias("_text")).dropDuplicates(["_blob"])
    seen = read_ledger(spark, ledger, version)
    if seen is not None:
        blobs = blobs.join(seen.select(F.col("blob").alias("_blob")), "_blob", "left_anti")
    found = compute_once(blobs, spans=find_spans("_text", rules))
    (found.select(F.lit(version).alias("rule_version"), F.col("_blob").alias("blob"), "spans")
          .write.mode("append").parquet(ledger))
    return read_ledger(spark, ledger, version)


def address(text: Column) -> Column:
    """The address of a text (null: of the empty text)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def with_findings(versions: DataFrame, ledger: str, out: str, text: str = "text", rules=RULES) -> DataFrame:
    """``versions`` plus the array column ``out`` of each row's spans."""
    blob = fresh(versions, "_blob")
    found = (update_ledger(versions, ledger, text, rules).where(F.size("spans") > 0)
             .dropDuplicates(["blob"]).select(F.col("blob").alias(blob), F.col("spans").alias(out)))
    empty = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    return (versions.withColumn(blob, address(F.col(text))).join(found, blob, "left").drop(blob)
            .withColumn(out, F.coalesce(out, empty)))


def secret_report(docs: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per document: doc_id, the number of spans of the base kinds,
    base_sha256 and spans (kind:start:end, comma-joined). Null and empty texts
    have no spans (the hash is that of the empty string); repeated rows and
    copies give equal rows; null ids are kept."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    f = with_findings(d, ledger, "found", "text", rules)
    base = [k for k, r in enumerate(rules) if r.base]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(order: int) -> Column:
        return F.size(F.filter("found", lambda x: x["ord"] == order)).cast("bigint").alias(f"n_{rules[order].kind}")

    return f.select("doc_id", *[count(k) for k in base],
                    F.sha2(listed(F.filter("found", lambda x: x["ord"].isin(base))), 256).alias("base_sha256"),
                    listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, ledger: str, text: str = "text", mark: str = "[secret]", rules=RULES) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping
    spans by one). Rows without a span, and null texts, stay as they are."""
    out = fresh(docs, "_found")
    f = with_findings(docs, ledger, out, text, rules)
    # where a span starts behind all earlier ones, a merged span starts
    merged = F.aggregate(
        out, F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, x: F.when(
            F.try_element_at(acc, F.lit(-1))["e"] > x["start"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["s"].alias("s"),
                F.greatest(F.try_element_at(acc, F.lit(-1))["e"], x["end"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))))
    m = fresh(f, "_merged")
    f = compute_once(f, **{m: merged})
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(m, lambda x: x["e"]))
    until = F.concat(F.transform(m, lambda x: x["s"]), F.array(F.length(text).cast("bigint")))
    pieces = F.transform(F.arrays_zip(before.alias("b"), until.alias("u")),
                         lambda x: F.substring(F.col(text), x["b"].cast("int") + 1, (x["u"] - x["b"]).cast("int")))
    clean = F.when(F.size(m) > 0, F.array_join(pieces, mark)).otherwise(F.col(text))
    return f.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
