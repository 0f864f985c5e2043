"""Helpers shared by the corpus operators: session settings for Arrow
batches, scratch tables in the shared folder, byte-level word splitting and
running sums over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, extended_components  # noqa: F401 (for the operators)
from ..session import ensure_checkpoint_dir, scratch_path

# Regexes over text: white-space separated words, and their separators.
SPACE_CLASS = r"[\x20\x09-\x0D]"
NONSPACE_CLASS = r"[^\x20\x09-\x0D]"
# Separators of alphanumeric words before lower-casing (A-Z count as letters).
NONALNUM_CLASS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Byte tables: lower-case A-Z only; and the same with every separator of
# alphanumeric words turned into a space. Bytes over 0x7F belong to words.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_BYTES = bytes(
    32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in LOWER_BYTES)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators need: modest Arrow batches (texts are long) and
    64-bit Arrow offsets, so a batch of very long texts cannot overflow."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    return spark


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet folder in the shared scratch folder and
    read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def sample_bound(rows: int, wanted: int) -> int:
    """The 64-bit signed hash below which about ``wanted`` of ``rows`` rows
    lie: a sample that needs no sort and is the same in every run."""
    share = min(1.0, wanted / max(rows, 1))
    return min(int(-(1 << 63) + share * (1 << 64)), (1 << 63) - 1)


def alnum_words(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) alphanumeric words of a UTF-8 text, in order."""
    return data.translate(ALNUM_BYTES).split() if data else []


def running_sum(lens: Column, chunk: int = 512) -> Column:
    """Inclusive running sums of an array<bigint> column (empty stays empty).

    Done in chunks of ``chunk`` elements plus one pass over the chunk totals,
    so that an array of k elements costs k * chunk + (k / chunk)**2 steps and
    not k**2."""
    def run(a: Column) -> Column:
        return F.aggregate(
            a, F.array().cast("array<bigint>"),
            lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)).cast("bigint")
                                                 + x.cast("bigint"))))

    def long_form(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / F.lit(chunk)).cast("int"))
        parts = F.transform(starts, lambda c: run(F.slice(a, c * chunk + 1, F.lit(chunk))))
        totals = run(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, totals, lambda p, t: F.transform(
            p, lambda x: x + t - F.element_at(p, -1))))

    return F.when(F.size(lens) <= chunk, run(lens)).otherwise(long_form(lens))


def word_hashes(texts, lower: bool = False):
    """64-bit hashes of the white-space separated words of an Arrow array of
    texts (null: none), in order, and the offsets of each text's words. Words
    are split and numbered by Arrow; only the distinct ones are hashed."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh3_64_intdigest
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = words.flatten(), np.asarray(words.offsets, np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    offsets = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])[offsets]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names))
    if not len(names):
        return np.empty(0, np.uint64), offsets
    return hashes[np.asarray(coded.indices)], offsets


def mix64(x):
    """Scramble a uint64 array (the finaliser of splitmix64)."""
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
