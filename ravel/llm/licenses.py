"""License scans with ordered signature rules, in DataFrame functions only.

A rule is a pattern over the words of a text (lower-cased, one space between),
gated by keywords: a text meets only rules whose keywords it holds. Detections
overlap; one whose word interval lies within that of another with at least its
priority is suppressed. What remains gives the labels and the score."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import compute_once
from .common import LOWER, NONALNUM_CLASS, UPPER, running_sum

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Licenses: label, keyword that every wording holds, wordings of the name.
LICENSES = (
    ("mit", "mit", ("mit", "mit x11")),
    ("apache-2", "apache", ("apache", "apache(?: software)? license(?: version)? 2(?: 0)?", "apache 2(?: 0)?")),
    ("bsd-2", "bsd", ("bsd 2 clause", "simplified bsd", "freebsd")),
    ("bsd-3", "bsd", ("bsd 3 clause", "new bsd", "modified bsd", "revised bsd")),
    ("bsd", "bsd", ("bsd", "bsd style")),
    ("gpl-2", "gpl", ("gpl(?: v| version )?2(?: 0)?", "gplv2")),
    ("gpl-3", "gpl", ("gpl(?: v| version )?3(?: 0)?", "gplv3")),
    ("gpl-2", "gnu", ("gnu general public license(?: as published by the free software foundation)? (?:version |v )?2",)),
    ("gpl-3", "gnu", ("gnu general public license(?: as published by the free software foundation)? (?:version |v )?3",)),
    ("gpl", "gnu", ("gnu general public license", "gnu gpl")),
    ("lgpl-2.1", "lgpl", ("lgpl(?: v| version )?2 1", "lgplv2 1")),
    ("lgpl-3", "lgpl", ("lgpl(?: v| version )?3(?: 0)?", "lgplv3")),
    ("lgpl", "lesser", ("gnu lesser general public license", "lesser general public license")),
    ("agpl-3", "affero", ("gnu affero general public license(?: version 3)?", "affero gpl")),
    ("agpl-3", "agpl", ("agpl(?: v| version )?3(?: 0)?", "agplv3")),
    ("mpl-2", "mozilla", ("mozilla public license(?: version)? 2(?: 0)?", "mozilla public license v 2 0")),
    ("epl-2", "eclipse", ("eclipse public license(?: version)? 2(?: 0)?", "eclipse public license v 2 0")),
    ("isc", "isc", ("isc",)),
    ("isc", "consortium", ("internet systems consortium",)),
    ("zlib", "zlib", ("zlib", "zlib libpng")),
    ("unlicense", "unlicense", ("unlicense", "the unlicense")),
    ("boost-1", "boost", ("boost software license(?: version 1 0)?", "boost")),
    ("wtfpl", "wtfpl", ("wtfpl",)),
    ("cc0-1", "cc0", ("cc0(?: 1 0)?", "creative commons cc0")),
    ("cc0-1", "zero", ("creative commons zero",)),
    ("cc-by-nc", "cc", ("cc by nc(?: [1-4] 0)?",)),
    ("cc-by-nc", "commons", ("creative commons attribution non ?commercial(?: [1-4] 0)?",)),
    ("cc-by-sa", "cc", ("cc by sa(?: [1-4] 0)?",)),
    ("cc-by-sa", "commons", ("creative commons attribution share ?alike(?: [1-4] 0)?",)),
    ("cc-by", "cc", ("cc by(?: [1-4] 0)?",)),
    ("cc-by", "commons", ("creative commons attribution(?: [1-4] 0)?",)),
    ("artistic-2", "artistic", ("artistic(?: license)? 2(?: 0)?", "perl artistic")),
)

# Ways to grant a license: keyword, pattern around a name N, priority, confidence.
GRANTS = (
    ("spdx", "spdx license identifier N", 9, 1.0),
    ("licensed", "(?:is |are )?licensed under (?:the )?(?:terms of the )?N(?: licen[cs]e)?", 8, 0.95),
    ("released", "(?:is |are )?released under (?:the )?(?:terms of the )?N(?: licen[cs]e)?", 8, 0.95),
    ("distributed", "(?:is |are )?distributed under (?:the )?(?:terms of the )?N(?: licen[cs]e)?", 8, 0.95),
    ("available", "(?:is |are )?(?:made )?available under (?:the )?(?:terms of the )?N(?: licen[cs]e)?", 8, 0.9),
    ("covered", "covered by (?:the )?N licen[cs]e", 7, 0.85),
    ("subject", "subject to (?:the )?(?:terms of the )?N(?: licen[cs]e)", 7, 0.85),
    ("under", "under (?:the )?(?:terms of the )?N licen[cs]e", 7, 0.85),
    ("licen", "licen[cs]e (?:is )?N", 5, 0.6),
    ("licen", "N licen[cs]e", 5, 0.6),
)

# Wordings that stand for a license by themselves: label, keyword, pattern, confidence.
PHRASES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("public-domain", "domain", "(?:in|into|to) the public domain", 0.7),
    ("proprietary", "reserved", "all rights reserved", 0.5),
)

# A text without any of these words' parts meets no rule.
GATE = ("licen", "spdx", "apache", "bsd", "gpl", "cc by", "cc0", "commons", "domain", "reserved", "hereby", "wtfpl",
        "permission", "redistribut", "lesser", "mozilla", "artistic", "released under", "available under",
        "distributed under", "covered by", "subject to")


@dataclass(frozen=True)
class Rule:
    label: str
    words: str                 # pattern over words with one space between
    kw: str                    # keywords that every match holds
    kw2: str
    priority: int
    confidence: float
    base: bool = False


def make_rules() -> list[Rule]:
    """Every grant with every wording of every license, the phrases, and the
    base phrases with the highest priority."""
    rules = [Rule(label, phrase, phrase.split()[0], phrase.split()[-1], 10, 0.9, True) for phrase, label in BASE]
    for label, kw, names in LICENSES:
        for grant, pattern, priority, confidence in GRANTS:
            words = pattern.replace("N", f"(?:{'|'.join(names)})")
            rules.append(Rule(label, words, kw, grant, priority, confidence))
    return rules + [Rule(label, words, kw, kw, 6, conf) for label, kw, words, conf in PHRASES]


RULES = make_rules()
LEVELS = sorted({r.priority for r in RULES})


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def detections(words: str) -> Column:
    """Sorted array of all detections in ``words`` (one space before, between
    and after the words): start, last (minus end), rank (minus priority), rule.
    The pieces between matches and the matches alternate, so the running sum
    of their spaces numbers the words."""
    w = F.col(words)
    table = json.dumps([asdict(r) | {"rule": k, "words": f"(?<= ){r.words}(?= )"} for k, r in enumerate(RULES)])
    rules = F.from_json(F.lit(table), "array<struct<rule:int,words:string,kw:string,kw2:string,priority:int>>")
    gated = F.filter(rules, lambda r: F.contains(w, r["kw"]) & F.contains(w, r["kw2"]) & F.rlike(w, r["words"]))

    def places(r: Column) -> Column:
        hits = F.regexp_extract_all(w, r["words"], F.lit(0))
        steps = F.transform(F.arrays_zip(F.split(w, r["words"], -1).alias("g"), hits.alias("h")),
                            lambda x: (_spaces(x["g"]) + F.coalesce(_spaces(x["h"]), F.lit(0))).cast("bigint"))
        return F.transform(
            F.arrays_zip(running_sum(F.slice(steps, 1, F.size(hits))).alias("e"), hits.alias("h")),
            lambda x: F.struct((x["e"] - _spaces(x["h"]) - 1).alias("start"), (-x["e"]).alias("last"),
                               (-r["priority"]).alias("rank"), r["rule"].alias("rule")))

    return F.sort_array(F.flatten(F.transform(gated, places)))


def surviving(found: str) -> Column:
    """(labels, score) of the detections that are not suppressed. They come by
    start, longest and highest priority first, so a detection lies within an
    earlier one exactly if the furthest end so far reaches its own; that end is
    kept for each priority and those above."""
    labels = F.from_json(F.lit(json.dumps([r.label for r in RULES])), "array<string>")
    sure = F.from_json(F.lit(json.dumps([r.confidence for r in RULES])), "array<double>")
    none = F.array().cast("array<string>")
    start = F.struct(*[F.lit(-1).cast("bigint").alias(f"e{p}") for p in LEVELS], none.alias("labels"), F.lit(0.0).alias("score"))

    def step(a: Column, x: Column) -> Column:
        end, priority = -x["last"], -x["rank"]
        far = F.lit(-1).cast("bigint")
        for p in LEVELS:
            far = F.when(priority == p, a[f"e{p}"]).otherwise(far)
        stays = far < end
        return F.struct(
            *[F.when(priority >= p, F.greatest(a[f"e{p}"], end)).otherwise(a[f"e{p}"]).alias(f"e{p}") for p in LEVELS],
            F.when(stays, F.array_union(a["labels"], F.array(F.get(labels, x["rule"])))).otherwise(a["labels"]).alias("labels"),
            F.when(stays, F.greatest(a["score"], F.get(sure, x["rule"]))).otherwise(a["score"]).alias("score"))

    return F.aggregate(found, start, step)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of base phrases),
    first_word and last_word (their smallest and largest start), base_labels,
    labels (sorted, comma-joined), score (the highest confidence of a
    surviving detection, 0 without one).

    Words are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased. Null and empty texts have no words and no labels; repeated
    rows give equal rows; null ids are kept. Every row is judged by itself,
    without a shuffle."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = compute_once(d, _w=F.concat(F.lit(" "), F.trim(F.regexp_replace("_t", NONALNUM_CLASS + "+", " ")), F.lit(" "))).drop("_t")
    none = "array<struct<start:bigint,last:bigint,rank:int,rule:int>>"
    low = F.lower("_w")    # for the gate only
    gate = F.lit(False)
    for part in GATE:
        gate = gate | F.contains("_low", F.lit(part))
    # texts past the gate are lower-cased in A-Z only, as the patterns ask
    d = compute_once(d, n_words=F.when(F.col("_w") == "  ", F.lit(0)).otherwise(_spaces(F.col("_w")) - 1).cast("bigint"), _low=low)
    d = compute_once(d, _w2=F.when(gate, F.translate("_w", UPPER, LOWER))).drop("_w", "_low")
    d = compute_once(d, _d=F.when(F.col("_w2").isNotNull(), detections("_w2")).otherwise(F.array().cast(none))).drop("_w2")
    base = F.filter("_d", lambda x: x["rule"] < len(BASE))
    names = F.from_json(F.lit(json.dumps([label for _, label in BASE])), "array<string>")
    d = compute_once(d, _base=base, _s=surviving("_d")).drop("_d")
    starts = F.transform("_base", lambda x: x["start"])
    of_base = F.array_distinct(F.transform("_base", lambda x: F.get(names, x["rule"])))
    return d.select(
        "doc_id", "n_words", F.size("_base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.sort_array(of_base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(of_base, F.col("_s.labels"))), ",").alias("labels"),
        F.col("_s.score").alias("score"))
