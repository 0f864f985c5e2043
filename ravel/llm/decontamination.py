"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of consecutive benchmark words, the alphabet is words.
For each pattern length m a shift table over blocks of two words says how far
the search may jump; where the shift is 0, the block's bucket lists the
patterns that end with it, and a direct comparison confirms an occurrence.
Documents stream through ``mapInArrow`` without a shuffle; only the pattern
block is broadcast, and its size is checked: more benchmark text than
``block_bytes`` is searched in several passes of bounded blocks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, fresh, saved

WINDOW = 13
BLOCK_BYTES = 16 << 20

SCAN_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                     T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.LongType()))])


class WordSearch:
    """Wu-Manber tables for word patterns; one table per pattern length."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        owners: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = alnum_words(text)
            if words:
                m = min(window, len(words))
                for i in range(len(words) - m + 1):
                    owners[m][tuple(words[i:i + m])].add(item)
        self.tables = [self._build(m, pats) for m, pats in sorted(owners.items())]

    @staticmethod
    def _build(m: int, pats: dict[tuple, set]):
        b = min(2, m)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, list] = defaultdict(list)
        for p, ids in pats.items():
            for end in range(b, m + 1):
                block = p[end - b:end]
                shift[block] = min(shift.get(block, m - b + 1), m - end)
            buckets[p[m - b:]].append((p, ids))
        return m, b, shift, {k: dict(v) for k, v in buckets.items()}

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) word spans of all occurrences, and the ids of
        the items they come from."""
        spans, found = [], set()
        n = len(words)
        for m, b, shift, buckets in self.tables:
            far = m - b + 1
            get = shift.get
            i = m
            while i <= n:
                step = get(tuple(words[i - b:i]), far)
                if step:
                    i += step
                    continue
                ids = buckets[tuple(words[i - b:i])].get(tuple(words[i - m:i]))
                if ids is not None:
                    spans.append((i - m, i))
                    found |= ids
                i += 1
        return merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _scanner(tables, text: str, out: str, first: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = tables.value
        for batch in batches:
            before = None if first else batch.column(out).to_pylist()
            got = []
            for k, data in enumerate(batch.column(text).cast(pa.large_binary()).to_pylist()):
                words = alnum_words(data)
                spans, items = search.search(words)
                if before:
                    spans = merge(spans + [(s["start"], s["end"]) for s in before[k]["spans"]])
                    items |= set(before[k]["items"])
                got.append({"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in spans],
                            "items": sorted(x for x in items if x is not None)})
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            col = pa.array(got, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)),
                                           ("items", pa.list_(pa.int64()))]))
            keep = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [col], names=keep + [out])
    return scan


def find_overlaps(docs: DataFrame, items: DataFrame, out: str, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus the struct column ``out`` (n_words, spans, items): the
    merged word spans of ``docs[text]`` covered by occurrences of windows of
    the items, and the sorted distinct ids of those items.

    Null or empty texts have no words and no spans; an item without words is
    never found; an item with a null id marks spans but is not listed; items
    that repeat an id share it; other columns pass through untouched. An empty
    benchmark finds nothing."""
    spark = docs.sparkSession
    it = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    size = it.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, SCAN_TYPE)])
    for k in range(blocks):
        part = it.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else it
        rows = [(r.i, r.t.encode()) for r in part.collect()]  # at most about block_bytes of text
        tables = spark.sparkContext.broadcast(WordSearch(rows, window))
        docs = docs.mapInArrow(_scanner(tables, text, out, k == 0), schema)
        if k < blocks - 1:
            docs = saved(docs, "overlaps")
    return docs


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  per_hit: int = 20, **kw) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside spans),
    n_items, items_sha256 (of the ids sorted as strings, comma-joined) and
    contaminated (n_hit > 0 and per_hit * n_hit >= n_words)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return measures(find_overlaps(d, items, "_scan", "text", **kw), "_scan", per_hit)


def measures(df: DataFrame, scan: str, per_hit: int = 20) -> DataFrame:
    s = F.col(scan)
    hit = F.aggregate(s["spans"], F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    ids = F.array_join(F.sort_array(F.transform(s["items"], lambda x: x.cast("string"))), ",")
    return df.select("doc_id", s["n_words"].alias("n_words"), hit.alias("n_hit"),
                     F.size(s["items"]).cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
                     is_contaminated(scan, per_hit).alias("contaminated"))


def is_contaminated(scan: str, per_hit: int = 20):
    s = F.col(scan)
    hit = F.aggregate(s["spans"], F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return (hit > 0) & (hit * per_hit >= s["n_words"])


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", per_hit: int = 20, **kw) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = fresh(docs, "_scan")
    return find_overlaps(docs, items, name, text, **kw).where(~is_contaminated(name, per_hit)).drop(name)
