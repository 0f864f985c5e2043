"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. That holds exactly when their common prefix and common suffix
together reach the longer length minus one, so that one of both is at least
half as long as the longer word. Words therefore meet by that half: for each
longer length M a word of length M or M - 1 is filed under its first M // 2 code
points and under its last M // 2.

The filed rows are sorted by key and cut into strips. A strip and another are
held as padded code-point matrices, once from the left and once from the right,
and all pairs of their rows are compared column by column: one tile gives the
common prefix and suffix of every pair in it. Keys with many words are cut into
parts, and each pair of parts is a group of its own, so no task holds more than
two parts of a key. What leaves a tile is one row per word that has near words
in it (their number and the best of them), not the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, saved

SEPARATORS = "[^A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
DELETE_EVERY = 97
PART = 2048      # words of one key that are held together
STRIP = 128      # rows of a tile's side
BUFFER = 8192    # rows read before whole groups are compared

_TILED = "word string, n_near bigint, best_n bigint, best string"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, delete_every: int | None = DELETE_EVERY) -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points that occur
    at least ``min_count`` times in all texts.

    A word is a run of Latin letters, A-Z lower-cased. Where ``delete_every``
    divides the CRC-32 of ``<doc_id>:<run>`` the run loses the code point at
    that number modulo its length (a null id counts as an empty string).
    Deleting only shortens, so shorter runs are dropped before they are
    counted; counts are combined map-side."""
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = F.filter(F.split(F.col(text), SEPARATORS), lambda r: F.length(r) >= min_length)
    d = docs.select(ident.alias("d"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    word = F.col("run")
    if delete_every:
        h = F.crc32(F.concat("d", F.lit(":"), "run"))
        at = F.pmod(h, F.length("run").cast("bigint")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.pmod(h, F.lit(delete_every).cast("bigint")) == 0, cut).otherwise(word)
    return (d.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
             .where((F.col("n") >= min_count) & (F.length("word") >= min_length)))


def _filed(words: DataFrame, part: int) -> DataFrame:
    """The words under their keys: (g, i, j, half, longer, last, word, n). Rows
    of one (g, i, j) meet; ``half`` is 2 where part i meets itself, else 0 for
    part i and 1 for part j. ``last``: filed by the end, not the beginning."""
    size = F.length("word")

    def key(longer, last: bool):
        k = F.floor(longer / 2).cast("int")
        chars = F.substring("word", size - k + 1, k) if last else F.substring("word", F.lit(1), k)
        return F.struct(longer.alias("longer"), F.lit(last).alias("last"),
                        F.xxhash64(longer, F.lit(last), chars).alias("g"))

    keys = F.array(*[key(longer, last) for longer in (size, size + 1) for last in (False, True)])
    rows = words.select("word", "n", F.inline(keys))
    # a key needs two words, one of them of the longer length
    groups = (rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.max((size == F.col("longer")).cast("int")).alias("full"))
                  .where("rows > 1 AND full = 1").select("g", F.ceil(F.col("rows") / part).cast("int").alias("parts")))
    rows = rows.join(groups, "g").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    half = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    return rows.select("g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                       half.alias("half"), "longer", "last", "word", "n")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading columns in which each row of ``x`` equals each row of ``y``."""
    same = x[:, 0][:, None] == y[:, 0][None, :]
    total = same.astype(np.uint16)
    for c in range(1, x.shape[1]):
        same &= x[:, c][:, None] == y[:, c][None, :]
        if not same.any():
            break
        total += same
    return total


def near_rows(words: list[str], group: np.ndarray, half: np.ndarray, longer: np.ndarray,
              last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of row numbers of near words, each pair in one of its keys
    only. Rows of a group lie together."""
    n = len(words)
    chars = np.array(words)
    width = max(chars.dtype.itemsize // 4, 1)
    left = chars.view(np.uint32).reshape(n, width)
    size = np.fromiter(map(len, words), np.int64, n)
    back = size[:, None] - 1 - np.arange(width)[None, :]
    right = np.where(back >= 0, np.take_along_axis(left, np.maximum(back, 0), axis=1), np.uint32(0))
    beyond = np.arange(width)[None, :] >= size[:, None]
    # the other side is padded by another number, so ends never count as equal
    left_y, right_y = np.where(beyond, np.uint32(0xFFFFFFFF), left), np.where(beyond, np.uint32(0xFFFFFFFF), right)
    xs, ys = [], []
    for s in range(0, n, STRIP):
        e = min(s + STRIP, n)
        t = s
        while t < n and group[t] <= group[e - 1]:
            f = min(t + STRIP, n)
            a, b = slice(s, e), slice(t, f)
            w = int(max(size[a].max(), size[b].max()))
            meet = group[a][:, None] == group[b][None, :]
            if t == s:
                meet = np.triu(meet, 1)
            both = half[a][:, None] + half[b][None, :]          # 0 + 1, or 2 + 2
            meet &= (both == 1) | (both == 4)
            top = longer[a][:, None]
            meet &= np.maximum(size[a][:, None], size[b][None, :]) == top
            if meet.any():
                head, tail = _common(left[a, :w], left_y[b, :w]), _common(right[a, :w], right_y[b, :w])
                k = top // 2
                mine = np.where(last[a][:, None], (tail >= k) & (head < k), head >= k)
                x, y = np.nonzero(meet & mine & (head + tail >= top - 1))
                xs.append(x + s), ys.append(y + t)
            t = f
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.empty(0, np.int64), np.empty(0, np.int64))


def _best(words: list[str], counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Per word with near words: how many, and the most frequent of them (of
    equally frequent ones the smallest)."""
    own, other = np.concatenate([x, y]), np.concatenate([y, x])
    rank = np.unique(np.array(words), return_inverse=True)[1] if len(own) else np.empty(0, np.int64)
    order = np.lexsort((rank[other], -counts[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    near = np.diff(np.append(first, len(own)))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in own[first]], pa.string()), pa.array(near, pa.int64()),
         pa.array(counts[other[first]], pa.int64()), pa.array([words[i] for i in other[first]], pa.string())],
        names=["word", "n_near", "best_n", "best"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares whole groups of rows sorted by (g, i, j); what is carried on
    to the next rows is one group at most."""
    def compared(t: pa.Table) -> pa.RecordBatch:
        words = t.column("word").to_pylist()
        num = {c: t.column(c).to_numpy() for c in ("half", "longer", "last", "n")}
        x, y = near_rows(words, starts(t).cumsum(), num["half"], num["longer"].astype(np.int64), num["last"].astype(bool))
        return _best(words, num["n"], x, y)

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in ("g", "i", "j"):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return new

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER:
            t = pa.Table.from_batches(held)
            cuts = np.flatnonzero(starts(t))
            if len(cuts):
                yield compared(t.slice(0, cuts[-1]))
                t = t.slice(cuts[-1])
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield compared(pa.Table.from_batches(held))


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones."""
    keys = ["g", "i", "j"]
    filed = _filed(words, part).repartition(*keys).sortWithinPartitions(*keys)
    found = filed.mapInArrow(_tiles, _TILED)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) over the links (word, form), by pointer doubling. A form
    has at least twice the count of its word, so chains end, and have fewer
    links than a count has bits."""
    at = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        at = saved(at.join(ahead, "root", "left").select(
            "word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                    min_count: int = MIN_COUNT, delete_every: int | None = DELETE_EVERY, part: int = PART) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words and their counts n: :func:`word_counts`. ``form`` is the near word of
    largest count (ties: the smallest in code-point order) if that count is at
    least twice n, else null, and ``form_n`` its count; ``root`` is where forms
    lead in the end, the word itself if it has none. Null and empty texts have
    no words; a repeated row counts again; an empty table gives no rows."""
    if min_length < 2:
        raise ValueError("words of one code point have no half to meet by")
    words = saved(word_counts(docs, doc_id, text, min_length, min_count, delete_every), "words")
    all_words = words.join(near_words(words, part), "word", "left")
    has = F.col("best_n") >= 2 * F.col("n")
    out = saved(all_words.select("word", F.when(has, F.col("best")).alias("form"), "n",
                                 F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                 F.when(has, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                  "n", "n_near", "form_n")
