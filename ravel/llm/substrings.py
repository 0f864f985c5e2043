"""Exact substring deduplication by recompression.

A window is ``WINDOW`` consecutive words of one document. Words covered by a
window whose word sequence also starts elsewhere are removed.

Recompression names ever longer blocks: a round names runs of equal symbols,
the next ones name pairs (a left and a right symbol, told apart by a bit of
the name and the round). Names are hashes of what they stand for, so they are
global without a dictionary: equal substrings get equal symbols everywhere,
but for some symbols at their ends, which may be joined to what stands
outside. How far in a window's symbols are certain follows from the window
alone, and so does its *anchor*, the least of its certain top symbols (the
window itself where none is certain). Equal windows have equal anchors.

1. Consecutive windows with one anchor form a span; spans meet by the name of
   the anchor. A name that occurs once rules out all its windows. Spans whose
   whole word sequence occurs again are repeated throughout.
2. For the other spans of repeated names (the ends of repeats), and one span
   of each sequence they could be part of, the single windows are compared.
3. The words covered are dropped from each document.

Before rows are shuffled each batch keeps one of those that agree, so a group
holds at most a row per batch, however often a passage occurs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, saved, word_hashes

WINDOW = 35
ROUNDS, LONGEST = 6, 10        # pair rounds; most words a symbol stands for

_seeds = mix64(np.arange(1001, 1001 + 128, dtype=np.uint64))
_A, _B, _C, _D = (_seeds[:4] | np.uint64(1))
_SIDE, _RANK, _ALONE = _seeds[4:24], _seeds[24], _seeds[25]
_BASE = int(_seeds[26]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Spans:
    """Hashes of any word span of a sequence of word hashes."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(x + (end - start).astype(np.uint64) * _D)


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST):
    """(names, first, last): the top symbols of the words ``h`` (``doc`` is
    the number of each word's document); for a window that starts at word i,
    the first symbol that is certain, and for one that ends before word j, the
    symbol before which certainty ends."""
    n = len(h)
    names, size = h, np.ones(n, np.int64)
    first = last = np.arange(n + 1)

    # runs: what stands at the ends of a window may go on outside
    new = np.ones(n + 1, bool)
    new[1:n] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    run = np.cumsum(new[:n]) - 1                     # of each word
    begin = np.flatnonzero(new)                      # of each run, and n
    length = np.diff(begin)
    whole = length <= longest                        # longer runs stay as they are
    head = new[:n] | ~whole[run]
    index = np.concatenate([[0], np.cumsum(head)])   # symbols before word i
    first = index[np.append(begin[run + 1], n)]
    last = index[np.append(0, begin[run])]
    at = np.flatnonzero(head)
    k = np.where(whole[run[at]], length[run[at]], 1)
    names = np.where(k > 1, mix64(names[at] * _C + k.astype(np.uint64) * _D), names[at])
    size, doc = k, doc[at]

    for r in range(rounds):
        m = len(names)
        left = (mix64(names ^ _SIDE[r]) & np.uint64(1)).astype(bool)
        joins = left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= longest) & (doc[:-1] == doc[1:])
        inner = np.zeros(m + 1, bool)                # right halves
        inner[1:m] = joins
        index = np.cumsum(~inner) - 1                # of the new symbol at or around each old one
        small = np.append(size < longest, False)
        # a small right symbol may belong to one outside, and so may a left one at the other end
        begin = np.arange(m + 1) + (small & np.append(~left, False))
        end = np.arange(m + 1)
        end[1:] -= small[:m] & left
        first, last = index[begin[first]], index[end[last]]
        at = np.flatnonzero(~inner[:m])
        pair = np.zeros(m, bool)
        pair[:-1] = joins
        pair = pair[at]
        right = names[np.minimum(at + 1, m - 1)]
        size = size[at] + np.where(pair, size[np.minimum(at + 1, m - 1)], 0)
        names = np.where(pair, mix64(names[at] * _A + mix64(right + _B)), names[at])
        doc = doc[at]
    return names, first, last


def anchored(h: np.ndarray, offsets: np.ndarray, width: int = WINDOW):
    """Spans of windows with one anchor, of a batch of texts: arrays (name,
    text number, first window's place in the text, number of windows, hash of
    all words). ``offsets`` bounds the texts' words in ``h``."""
    count = np.diff(offsets)
    doc = np.repeat(np.arange(len(count)), count)
    many = np.maximum(count - width + 1, 0)
    total = int(many.sum())
    none = np.empty(0, np.int64)
    if not total:
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    names, first, last = recompress(h, doc)
    of = np.repeat(np.arange(len(count)), many)
    place = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    at = offsets[of] + place
    s, e = first[at], last[at + width]

    # the least symbol of each distinct range of certain symbols
    new = np.ones(total, bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    group = np.cumsum(new) - 1
    s, e = s[new], e[new]
    rank = mix64(names ^ _RANK)
    best = np.full(len(s), -1)
    least = np.zeros(len(s), np.uint64)
    live = np.flatnonzero(s < e)
    step = 0
    while len(live):
        x = s[live] + step
        better = (best[live] < 0) | (rank[x] < least[live])
        w = live[better]
        best[w], least[w] = x[better], rank[x[better]]
        step += 1
        live = live[s[live] + step < e[live]]
    best = best[group]

    new = np.ones(total, bool)
    new[1:] = (best[1:] != best[:-1]) | (best[1:] < 0) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, total))
    spans = Spans(h)
    whole = spans(at[begin], at[begin] + n + width - 1)
    a = best[begin]
    name = np.where(a >= 0, mix64(names[np.maximum(a, 0)] + _A), mix64(whole ^ _ALONE))
    return name, of[begin], place[begin], n, whole


SPAN = "k1 bigint, k2 bigint, name bigint, whole bigint, start int, n int, multi boolean, mixed boolean, meet bigint"


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(batch.column(k)) for k in ("k1", "k2")]


def _spanner(width: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, offsets = word_hashes(batch.column("text"))
            name, of, start, n, whole = anchored(h, offsets, width)
            k1, k2 = (k[of] for k in _keys(batch))
            # of spans with one sequence, the first is sent to meet the others; of those with one name, the first
            # meets by name, the rest (the name is known to be repeated, in several sequences) by sequence
            _, one, inverse, times = np.unique(np.stack([name, whole]), axis=1, return_index=True, return_inverse=True,
                                               return_counts=True) if len(name) else (None,) + (np.empty(0, np.int64),) * 3
            multi = times[inverse.ravel()] > 1 if len(name) else np.empty(0, bool)
            sent = np.zeros(len(name), bool)
            sent[one] = True
            w = np.flatnonzero(sent)
            _, lead, inv, kinds = np.unique(name[w], return_index=True, return_inverse=True, return_counts=True)
            mixed = np.zeros(len(name), bool)
            mixed[w] = kinds[inv] > 1
            meet = mix64(name + whole)
            meet[w[lead]] = name[w[lead]]
            meet = meet.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1), pa.array(k2), pa.array(name.view(np.int64)), pa.array(whole.view(np.int64)),
                 pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(multi), pa.array(mixed),
                 pa.array(meet, mask=~sent)],
                names=["k1", "k2", "name", "whole", "start", "n", "multi", "mixed", "meet"])
    return spans


def _window_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, offsets = word_hashes(batch.column("text"))
            probes = batch.column("probes")
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(probes.offsets)))
            flat = probes.flatten()
            start, n = (np.asarray(flat.field(f)).astype(np.int64) for f in ("start", "n"))
            win = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(of, n)
            at = offsets[of] + win
            x = Spans(h)(at, at + width)
            _, lead, inverse, times = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
            sent = np.zeros(len(x), bool)
            sent[lead] = True
            k1, k2 = (k[of] for k in _keys(batch))
            known = times[inverse] > 1
            keep = sent | known
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[keep]), pa.array(k2[keep]), pa.array(x.view(np.int64)[keep], mask=~sent[keep]),
                 pa.array(win[keep].astype(np.int32)), pa.array(known[keep])],
                names=["k1", "k2", "meet", "start", "known"])
    return rows


def _remover(width: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of = batch.column("text").cast(pa.large_binary())
            found = batch.column("found")
            n_words, removed, digest = [], [], []
            for i in range(batch.num_rows):
                data = words_of[i].as_py()
                words = data.split() if data else []
                n, gone = len(words), 0
                if found[i].is_valid and n:
                    flat = found[i].values
                    start, count = (np.asarray(flat.field(f)).astype(np.int64) for f in ("start", "n"))
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + count + width - 1, -1)
                    gap = np.cumsum(edge[:-1]) == 0
                    gone = n - int(gap.sum())
                    words = [words[j] for j in np.flatnonzero(gap)] if gone < n else []
                n_words.append(n), removed.append(gone)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    return remove


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(k1, k2, start, n): runs of repeated windows of the rows of ``docs``
    (k1, k2, text); a row's keys may be those of others with the same text."""
    spans = docs.mapInArrow(_spanner(width), SPAN)
    # a span not sent has its first equal in the same batch and is known to be repeated; such rows meet nobody
    alone = F.when(F.col("meet").isNull(), F.xxhash64("k1", "k2", "start")).otherwise(F.col("meet"))
    spans = spans.withColumn("sent", F.col("meet").isNotNull()).withColumn("meet", alone)
    name = Window.partitionBy("meet", "sent")
    same = Window.partitionBy("meet", "sent", "whole")
    spans = spans.select(
        "k1", "k2", "start", "n", "sent", "multi", F.count(F.lit(1)).over(name).alias("in_name"),
        F.max("mixed").over(name).alias("mixed"), (F.min("whole").over(name) < F.max("whole").over(name)).alias("differ"),
        F.count(F.lit(1)).over(same).alias("in_same"),
        F.row_number().over(same.orderBy("k1", "k2", "start")).alias("nth"))
    again = F.col("multi") | (F.col("in_same") > 1)
    repeated = F.col("multi") | F.col("mixed") | (F.col("in_name") > 1)
    probe = F.col("sent") & (F.col("mixed") | F.col("differ")) & (~again | (F.col("nth") == 1))
    spans = saved(spans.where(repeated).select("k1", "k2", "start", "n", again.alias("done"), probe.alias("probe"))
                  .where("done OR probe"), "spans")

    probes = spans.where("probe").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("probes"))
    rows = (docs.join(probes, ["k1", "k2"]).select("k1", "k2", "text", "probes")
                .mapInArrow(_window_rows(width), "k1 bigint, k2 bigint, meet bigint, start int, known boolean"))
    alone = F.when(F.col("meet").isNull(), F.xxhash64("k1", "k2", "start")).otherwise(F.col("meet"))
    rows = rows.withColumn("sent", F.col("meet").isNotNull()).withColumn("meet", alone)
    met = F.count(F.lit(1)).over(Window.partitionBy("meet", "sent"))
    rows = rows.withColumn("met", met).where("known OR met > 1").select("k1", "k2", "start", F.lit(1).alias("n"))
    return spans.where("done").select("k1", "k2", "start", "n").unionByName(rows)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_sha256 (of the
    words kept, joined by one space).

    Words are separated by white space and compared unchanged. Null and empty
    texts have no words; shorter texts than a window lose nothing. Repeated
    rows are repeats of each other: each loses all its windows. Null ids are
    kept. Windows are compared by 64-bit hashes of their words."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                    F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1)).alias("k1"),
                    F.xxhash64(F.col(text), F.col(doc_id).isNull()).alias("k2"))
    runs = repeated_windows(d.select("k1", "k2", "text"), width)
    found = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("found"))
    both = d.join(found, ["k1", "k2"], "left").select("doc_id", "text", "found")
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_remover(width), f"doc_id {schema}, n_words bigint, n_removed bigint, kept_sha256 string")
