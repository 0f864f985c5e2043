"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

A document's set is its distinct word shingles. Documents with equal sets
form a class; everything after works on classes, so copies cost nothing.

* Bands of MinHash values put classes into buckets.
* A second sample (the smallest shingle hash of each of 2,048 ranges) is
  folded into a parity bitmap, the odd sketch: every sample flips one bit. The
  population count of two sketches' XOR estimates how many samples differ,
  most precisely at high similarity. A candidate pair is dropped only when the
  estimate lies SIGMAS standard errors below the limit.
* The other candidates are confirmed on the full shingle sets.

Not all pairs of a bucket are formed. Round one compares each class with the
smallest of its buckets and confirms the most similar; round two compares, in
buckets that still hold several components, one member of each with one of the
smallest; round three compares, in blocks of bounded size, all members of
different components in the buckets that remain, confirms what passes within
the block and gives only links that join components. So no link that could
join two components is lost, however a bucket is made up."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, extended_components, fresh, mix64, saved, word_hashes

SHINGLE = 5
BANDS, ROWS = 32, 4
SAMPLES, SKETCH_WORDS = 2048, 32         # ranges sampled; 64-bit words of a sketch
SIGMAS = 6
BLOCK, BLOCK_SHINGLES = 4096, 4 << 20    # members of a bucket compared at once, and their shingles

_seeds = mix64(np.arange(1, 4 * BANDS * ROWS + 64, dtype=np.uint64))
_FLIP = (_seeds[:BANDS * ROWS] >> np.uint64(32)).astype(np.uint32)[:, None]
_ODD = ((_seeds[BANDS * ROWS:2 * BANDS * ROWS] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
_PLACE = _seeds[2 * BANDS * ROWS:2 * BANDS * ROWS + 32] | np.uint64(1)


def shingle_set(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text's word hashes; a text
    of fewer than ``k`` words is one shingle, one without words none."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    x = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        x += h[j:n - k + 1 + j] * _PLACE[j]
    return np.unique(mix64(x))


def band_keys(s: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ROWS MinHash values."""
    low = np.full((BANDS * ROWS, 1), 0xFFFFFFFF, np.uint32)
    x = s.astype(np.uint32)
    for i in range(0, len(x), 4096):
        part = (x[None, i:i + 4096] ^ _FLIP) * _ODD
        np.minimum(low, part.min(axis=1, keepdims=True), out=low)
    low = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * _PLACE[j] + low[:, j])
    return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of samples, and the parity bitmap they are folded into."""
    part = s >> np.uint64(64 - int(math.log2(SAMPLES)))
    first = np.ones(len(s), bool)
    first[1:] = part[1:] != part[:-1]
    bits = mix64(s[first] + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * SKETCH_WORDS)
    flips = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS).astype(np.uint8) & 1
    return int(first.sum()), np.packbits(flips, bitorder="little").view(np.int64)


def least_equal(a_size, b_size, a_samples, b_samples, percent: int, m=np):
    """The fewest equal samples a pair at the limit can be estimated to have,
    but for a chance of SIGMAS standard errors. ``m`` computes (numpy, or the
    functions of Spark's columns).

    At the limit the union has a known size, and so many ranges hold a sample
    of it; the share ``t`` of those is equal, give or take what sampling
    leaves out; the sketch's error comes from samples that share a bit."""
    t, bits = percent / 100, 64.0 * SKETCH_WORDS
    union = (a_size + b_size) / (1 + t)
    held = (1 - m.exp(union * math.log(1 - 1 / SAMPLES))) * SAMPLES
    equal = held * t
    differ = a_samples + b_samples - equal * 2
    kept = m.exp(differ * (-4 / bits))
    sketch = ((1 - kept) * (bits / 4) - differ * kept) / kept
    left_out = (union - held) / union
    return equal - m.sqrt(equal * (1 - t) * m.abs(left_out) + m.abs(sketch) / 4 + 1) * SIGMAS


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b
    for batch in batches:
        keys, sizes, bands, counts, bitmaps = [], [], [], [], []
        hashes, at = word_hashes(batch.column("text"), lower=True)
        for i in range(batch.num_rows):
            s = shingle_set(hashes[at[i]:at[i + 1]])
            sizes.append(len(s))
            if not len(s):
                keys.append(None), bands.append(None), counts.append(None), bitmaps.append(None)
                continue
            keys.append(int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
            n, bitmap = odd_sketch(s)
            bands.append(band_keys(s)), counts.append(n), bitmaps.append(bitmap)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tkey"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
             pa.array(bands, longs), pa.array(counts, pa.int32()), pa.array(bitmaps, longs)],
            names=["doc_id", "tkey", "n_shingles", "key", "bands", "n_samples", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_shingles, key, bands, n_samples, sketch) per row of
    ``docs`` (doc_id, text): tkey hashes the text, key the shingle set (null
    where it is empty)."""
    d = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    return d.mapInArrow(_signer, "doc_id bigint, tkey bigint, n_shingles bigint, key bigint, bands array<bigint>, "
                                 "n_samples int, sketch array<bigint>")


def _differ() -> Column:
    """Bits that differ between the two sketches."""
    return F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                       lambda s, x: s + x)


def _similar_enough(percent: int) -> Column:
    """Over columns a_/b_ n_shingles, n_samples, sketch: can the pair reach
    the limit? Sizes decide exactly, then the sketches' estimate."""
    bits = 64.0 * SKETCH_WORDS
    changed = -bits / 2 * F.ln(F.greatest(1 - 2 * _differ() / bits, F.lit(1e-6)))
    equal = (F.col("a_n_samples") + F.col("b_n_samples") - changed) / 2
    sizes = (F.least("a_n_shingles", "b_n_shingles") * 100 >= F.greatest("a_n_shingles", "b_n_shingles") * percent)
    return sizes & (equal >= least_equal(*[F.col(c) for c in ("a_n_shingles", "b_n_shingles", "a_n_samples", "b_n_samples")],
                                         percent, F))


def _sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, differ) of the pairs (a, b) whose sketches allow a link."""
    side = {x: classes.select(F.col("key").alias(x), *[F.col(c).alias(f"{x}_{c}")
                                                       for c in ("n_shingles", "n_samples", "sketch")]) for x in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    return both.where(_similar_enough(percent)).select("a", "b", _differ().alias("differ"))


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in "ab")
            (ha, ia), (hb, ib) = (word_hashes(batch.column(c), lower=True) for c in ("a_text", "b_text"))
            hit = []
            for i in range(batch.num_rows):
                x, y = shingle_set(ha[ia[i]:ia[i + 1]]), shingle_set(hb[ib[i]:ib[i + 1]])
                union = len(np.unique(np.concatenate([x, y])))
                hit.append(100 * (len(x) + len(y) - union) >= percent * union)
            pairs = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            yield pairs.filter(pa.array(hit, pa.bool_()))
    return confirm


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) linked by their full shingle sets."""
    both = (pairs.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a")
                 .join(texts.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b"))
    return saved(both.mapInArrow(_confirmer(percent), "a bigint, b bigint"), "links")


def _blocks(percent: int):
    bits = 64.0 * SKETCH_WORDS

    def compare(group: pa.Table) -> pa.Table:
        """Confirmed links of one block (i, j) of a bucket that join different
        components. A pair that meets in several buckets is compared in the
        first of them; members of the largest component are compared with
        the others only."""
        side, key, label, size, samples = (group.column(c).to_numpy() for c in ("side", "key", "label", "n_shingles", "n_samples"))
        label = label.copy()
        names, times = np.unique(label, return_counts=True)
        out: list[tuple[int, int]] = []
        if len(names) > 1:
            sketch = np.stack(group.column("sketch").to_numpy()).view(np.uint64)   # bit counts of signed numbers drop the sign
            bands = np.stack(group.column("bands").to_numpy())
            own, texts = int(group.column("band")[0].as_py()), group.column("text")
            few = label != names[np.argmax(times)]
            left, right, sets = side != 1, side != 0, {}

            def set_of(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingle_set(word_hashes(pa.array([texts[i].as_py()], pa.large_string()), lower=True)[0])
                return sets[i]

            def against(x: int, others: np.ndarray) -> None:
                y = np.flatnonzero(others & (label != label[x]) & (np.minimum(size, size[x]) * 100 >= np.maximum(size, size[x]) * percent))
                if not len(y):
                    return
                differ = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1)
                changed = -bits / 2 * np.log(np.maximum(1 - 2 * differ / bits, 1e-6))
                equal = (samples[y] + samples[x] - changed) / 2
                pick = equal >= least_equal(size[y], size[x], samples[y], samples[x], percent)
                y, equal = y[pick], equal[pick]
                pick = np.argmax(bands[y] == bands[x], axis=1) == own if len(y) else np.empty(0, bool)
                y, equal = y[pick], equal[pick]
                for j in y[np.argsort(-equal)]:
                    if label[j] == label[x]:
                        continue
                    union = len(np.unique(np.concatenate([set_of(x), set_of(j)])))
                    if 100 * (len(set_of(x)) + len(set_of(j)) - union) >= percent * union:
                        out.append((max(key[x], key[j]), min(key[x], key[j])))
                        label[label == label[j]] = label[x]

            if (side == 2).any():
                for x in np.flatnonzero(few):
                    against(x, ~few | (key > key[x]))
            else:
                for x in np.flatnonzero(few & left):
                    against(x, right)
                for x in np.flatnonzero(few & right):
                    against(x, left & ~few)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return compare


def _across(buckets: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Round three: links (a, b) between different components in one bucket."""
    mine = _labelled(buckets, labels)
    rows = mine.join(_mixed(mine).select("bucket"), "bucket", "left_semi").join(
        classes.select("key", "n_shingles", "n_samples", "sketch", "bands"), "key")
    load = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("load"))
    parts = load.select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("load") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    rows = rows.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # block (i, j) with i <= j holds part i as its left and part j as its right side; (i, i) holds it once
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(texts, "key")
    rows = rows.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                       F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0)
                       .otherwise(1).alias("side"), "band", "key", "label", "n_shingles", "n_samples", "sketch", "bands", "text")
    links = rows.groupBy("bucket", "i", "j").applyInArrow(_blocks(percent), "a bigint, b bigint")
    return saved(links, "links")


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.withColumn("label", F.col("key"))
    l = labels.select(F.col("id").alias("key"), "component")
    return buckets.join(l, "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")


def _mixed(mine: DataFrame) -> DataFrame:
    """Buckets that hold more than one component: (bucket, low, n)."""
    return (mine.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                       F.count(F.lit(1)).alias("n")).where("low < high").drop("high"))


def linked_classes(classes: DataFrame, texts_of, percent: int) -> DataFrame:
    """(id, component) of the classes that have a link. ``texts_of(keys)``
    gives (key, text) of some classes."""
    b = classes.select("key", F.posexplode("bands").alias("band", "bucket"))
    full = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    buckets = saved(b.join(full, "bucket", "left_semi"), "buckets")
    busy = saved(classes.join(buckets.select("key").distinct(), "key", "left_semi"), "classes")
    texts = saved(texts_of(busy), "texts")

    heads = buckets.groupBy("bucket").agg(F.min("key").alias("b"))
    pairs = buckets.join(heads, "bucket").select(F.col("key").alias("a"), "b").where("a <> b").distinct()
    best = _sketched(pairs, busy, percent).groupBy("a").agg(F.min(F.struct("differ", "b")).alias("m"))
    tried = saved(best.select("a", "m.b"), "tried")
    links = _confirmed(tried, texts, percent)
    labels = saved(connected_components(links), "labels")

    mine = _labelled(buckets, labels)
    heads = mine.groupBy("bucket", "label").agg(F.min("key").alias("key"))
    low = _mixed(mine).select("bucket", "low")
    pivot = heads.join(low, "bucket")
    pairs = (pivot.where("label <> low").select("bucket", F.col("key").alias("x"))
             .join(pivot.where("label = low").select("bucket", F.col("key").alias("y")), "bucket")
             .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
             .join(tried, ["a", "b"], "left_anti"))
    more = saved(_sketched(pairs, busy, percent).select("a", "b"), "tried")
    labels = saved(extended_components(labels, _confirmed(more, texts, percent)), "labels")

    return extended_components(labels, _across(buckets, labels, busy, texts, percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links 100 * intersection >= percent * union, itself
    included), kept (doc_id = component_id), tkey (hash of the text).

    Words are separated by white space, A-Z lower-cased. A text without words
    (null, empty) is linked with nothing. Repeated rows give equal results. A
    row without an id is in no group: its component is null and it is kept.
    Rows of one id with different texts are judged each by its own text."""
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sig = saved(signatures(d), "signatures")
    # the class is named by 64 bits of its set; one row each, copies combined before the shuffle
    classes = saved(sig.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("doc_id", "tkey", "n_shingles", "n_samples", "sketch", "bands")).alias("m")).select("key", "m.*"),
        "classes")

    def texts_of(some: DataFrame) -> DataFrame:
        want = some.select("key", "doc_id", "tkey")
        return (d.withColumn("tkey", F.xxhash64("text")).join(want, ["doc_id", "tkey"])
                 .select("key", "text").dropDuplicates(["key"]))

    comp = linked_classes(classes, texts_of, percent)
    ids = classes.select("key", "doc_id").join(comp.select(F.col("id").alias("key"), "component"), "key")
    low = ids.groupBy("component").agg(F.min("doc_id").alias("low"))
    linked = ids.join(low, "component").select("key", "low")
    of_class = (classes.select("key", F.col("doc_id").alias("first")).join(linked, "key", "left")
                       .select("key", F.coalesce("low", "first").alias("low")))
    out = sig.select("doc_id", "tkey", "n_shingles", "key").join(of_class, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "tkey")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest id, with its own
    columns; of repeated rows, one."""
    found = saved(near_duplicates(docs, doc_id, text, percent).where("doc_id IS NOT NULL"), "found")
    id_, key, comp = (fresh(docs, c) for c in ("_id", "_tkey", "_comp"))
    # rows that go are few against those that stay, and known by id and text hash; a row without an id stays
    gone = found.where("NOT kept").select(F.col("doc_id").alias(id_), F.col("tkey").alias(key)).distinct()
    kept = found.where("kept").select(F.col("doc_id").alias(id_), F.col("component_id").alias(comp), F.col("tkey").alias(key))
    several = kept.groupBy(id_, comp).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_, comp)
    again = saved(kept.distinct().join(several, [id_, comp], "left_semi"), "again")
    d = docs.withColumn(id_, F.col(doc_id).cast("bigint")).withColumn(key, F.xxhash64(text))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return d.join(saved(gone, "gone"), [id_, key], "left_anti").select(*cols)
    gone = saved(gone.unionByName(again.select(id_, key)).distinct(), "gone")
    once = d.join(again, [id_, key]).dropDuplicates([id_, comp])
    return d.join(gone, [id_, key], "left_anti").select(*cols).unionByName(once.select(*cols))
