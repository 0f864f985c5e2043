"""SimHash near duplicates: a hierarchical index in Gray order.

Documents with equal fingerprints form a class; everything after works on the
distinct fingerprints. Two fingerprints that differ in at most three of 64 bits
agree in one of four blocks of 16. So each fingerprint is filed four times,
rotated so that another block leads; the leading block is the root of an index
tree, in which no difference is allowed.

Under a root the rotated codes are sorted by Gray rank (the position of a code
in the reflected Gray sequence), where neighbours differ in few bits. Runs of
them become nodes. A node factors out what its codes share: a mask of the bits
in which all agree, and those bits. Two nodes whose shared bits already differ
in more than three places cannot hold a link, so the whole pair of groups is
dropped; a child's mask holds its parent's, so differences add up on the way
down. Pairs of leaves that are left are compared code by code.

Nodes above blocks of BLOCK codes are rows of Spark tables and the descent is
one join a level, so a root that holds a third of all fingerprints is spread
over many tasks. From a block, or a pair of blocks, come only the links of a
spanning forest, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, connected_components, saved

SHINGLE, SEED = 3, 42
BITS = 3                        # most bits in which linked fingerprints differ
BLOCKS, WIDTH = 4, 16           # blocks of a fingerprint, one more than BITS
BLOCK, LEAF, FAN = 1024, 32, 64  # codes of a block and of a leaf; children of an upper node

_CHUNK = 1 << 16                # shingles whose bits are unpacked at once


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the 64-bit ``hashes``."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        octets = hashes[i:i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest
    for batch in batches:
        prints = []
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            words = text.translate(LOWER_BYTES).split() if text else []
            if not words:
                prints.append(0)
                continue
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            k = min(SHINGLE, len(size))
            cuts = zip((ends - size)[:len(size) - k + 1].tolist(), ends[k - 1:].tolist())
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(size) - k + 1)
            prints.append(fingerprint(hashes))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) per row: fp is the 64-bit fingerprint as a signed number,
    of word shingles (A-Z lower-cased, repeats count); 0 without words."""
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(_signer, "doc_id bigint, fp bigint")


def rotated(c: Column, bits) -> Column:
    """``c`` rotated left by ``bits`` (a number from 0 to 63, or a column)."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    left = F.call_function("shiftleft", c, bits)
    return F.when(bits == 0, c).otherwise(left.bitwiseOR(F.call_function("shiftrightunsigned", c, F.lit(64) - bits)))


def gray_rank(c: Column) -> Column:
    """Position of a code in the reflected Gray sequence: each bit is the
    parity of the code's bits from the top down to it."""
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def _turn_back(codes: np.ndarray, rotation: int) -> np.ndarray:
    """The fingerprints of codes rotated left by ``rotation`` blocks."""
    s = np.uint64(WIDTH * rotation)
    return codes if rotation == 0 else (codes >> s) | (codes << (np.uint64(64) - s))


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rotation, rank, code) in order to blocks of codes of one root."""
    def blocks(rotation, root, rank, code, whole: bool):
        cut = np.flatnonzero((rotation[1:] != rotation[:-1]) | (root[1:] != root[:-1])) + 1
        starts = np.concatenate([[0], cut])
        ends = np.append(cut, len(root))
        spans = [(a, min(a + BLOCK, e)) for s, e in zip(starts, ends) for a in range(s, e, BLOCK)]
        done = spans if whole else spans[:-1]
        both = np.bitwise_and.reduceat(code, [a for a, _ in done]) if done else np.empty(0, np.int64)
        either = np.bitwise_or.reduceat(code, [a for a, _ in done]) if done else np.empty(0, np.int64)
        # reduceat runs to the next start, which is the end of the span but for the last one
        if done and done[-1][1] < len(code):
            a, e = done[-1]
            both[-1], either[-1] = np.bitwise_and.reduce(code[a:e]), np.bitwise_or.reduce(code[a:e])
        first = [a for a, _ in done]
        offsets = np.array(first + [done[-1][1]], np.int64) if done else np.zeros(1, np.int64)
        out = pa.RecordBatch.from_arrays(
            [pa.array(rotation[first], pa.int32()), pa.array(root[first], pa.int32()), pa.array(rank[first], pa.int64()),
             pa.array(both, pa.int64()), pa.array(either, pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code, pa.int64()))],
            names=["rotation", "root", "block", "both", "either", "codes"])
        return out, (done[-1][1] if done else 0)

    kept = None
    for batch in batches:
        cols = [np.asarray(batch.column(c)) for c in ("rotation", "root", "rank", "code")]
        if kept is not None:
            cols = [np.concatenate([k, c]) for k, c in zip(kept, cols)]
        if not len(cols[0]):
            continue
        out, used = blocks(*cols, whole=False)
        yield out
        kept = [c[used:] for c in cols]
    if kept is not None and len(kept[0]):
        yield blocks(*kept, whole=True)[0]


def index_blocks(prints: DataFrame) -> DataFrame:
    """Blocks of codes with their shared bits: (rotation, root, block, both,
    either, codes). ``prints``: distinct fp. ``block`` is the least Gray rank;
    ``both`` and ``either`` are the AND and the OR of the codes, so the bits in
    which they agree are shared by all."""
    turns = F.array(*[F.struct(F.lit(r).alias("rotation"), rotated(F.col("fp"), WIDTH * r).alias("code")) for r in range(BLOCKS)])
    rows = prints.select(F.inline(turns)).select(
        "rotation", F.shiftrightunsigned("code", 64 - WIDTH).cast("int").alias("root"), gray_rank(F.col("code")).alias("rank"), "code")
    # in rank order the codes of a root lie together; a large root spans several partitions
    rows = rows.repartitionByRange("rotation", "rank").sortWithinPartitions("rotation", "rank")
    return rows.mapInArrow(_packer, "rotation int, root int, block bigint, both bigint, either bigint, codes array<bigint>")


def _bits_apart(x: str, y: str) -> Column:
    """Places in which the shared bits of two nodes differ."""
    shared = F.bitwise_not(F.col(f"{x}_both").bitwiseXOR(F.col(f"{x}_either")).bitwiseOR(
        F.col(f"{y}_both").bitwiseXOR(F.col(f"{y}_either"))))
    return F.bit_count(F.col(f"{x}_both").bitwiseXOR(F.col(f"{y}_both")).bitwiseAND(shared))


def _side(nodes: DataFrame, x: str) -> DataFrame:
    return nodes.select("rotation", "root", *[F.col(c).alias(f"{x}_{c}") for c in nodes.columns if c not in ("rotation", "root")])


def block_pairs(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """(rotation, root, x_block, y_block) of the pairs of different blocks of
    a root that can hold a link: from the top nodes down, a join a level."""
    roots = ["rotation", "root"]
    split = blocks.groupBy(*roots).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*roots)
    heads = blocks.select(*roots, "block", "both", "either").join(split, roots, "left_semi")
    number = F.row_number().over(Window.partitionBy(*roots).orderBy("block")) - 1   # one row per BLOCK codes
    level = saved(heads.withColumn("node", number.cast("bigint")), "heads")
    levels = [level]
    while not level.where(F.col("node") >= fan).isEmpty():
        level = saved(level.groupBy(*roots, F.floor(F.col("node") / fan).alias("node")).agg(
            F.bit_and("both").alias("both"), F.bit_or("either").alias("either")), "nodes")
        levels.append(level)
    top = levels.pop()
    pairs = _side(top, "x").join(_side(top, "y"), roots).where("x_node <= y_node").where(_bits_apart("x", "y") <= BITS)
    while levels:
        below = levels.pop()
        up = F.floor(F.col("node") / fan)
        x, y = (_side(below.withColumn("up", up), s) for s in "xy")
        pairs = saved(pairs.select(*roots, F.col("x_node").alias("x_up"), F.col("y_node").alias("y_up")), "pairs")
        pairs = (pairs.join(x, [*roots, "x_up"]).join(y, [*roots, "y_up"]).where("x_node <= y_node")
                      .where(_bits_apart("x", "y") <= BITS))
    return pairs.where("x_node < y_node").select(*roots, "x_block", "y_block")


def _leaf_bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.arange(0, len(codes), LEAF)
    both, either = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    return starts, both, ~(both ^ either)


def close_pairs(x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of codes that differ in at most BITS bits, between
    ``x`` and ``y`` or (y is None) inside ``x``. Leaves are compared by their
    shared bits first, code by code only where those allow a link."""
    own = y is None
    y = x if own else y
    (xs, xb, xm), (ys, yb, ym) = _leaf_bits(x), _leaf_bits(y)
    apart = np.bitwise_count((xb[:, None] ^ yb[None, :]) & xm[:, None] & ym[None, :])
    may = apart <= BITS
    out_a, out_b = [], []
    for p, q in zip(*np.nonzero(np.triu(may) if own else may)):
        a, b = x[xs[p]:xs[p] + LEAF], y[ys[q]:ys[q] + LEAF]
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= BITS)
        i, j = i + xs[p], j + ys[q]
        if own and p == q:
            i, j = i[i < j], j[i < j]
        out_a.append(i), out_b.append(j)
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions is connected to."""
    low = np.arange(n)
    while len(a):
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))   # the larger root points at the smaller one
        while not np.array_equal(low, low[low]):
            low = low[low]
        keep = low[a] != low[b]
        a, b = a[keep], b[keep]
    return low


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rotation, x_codes, y_codes; y null: inside x) to the links of a
    spanning forest."""
    for batch in batches:
        a_out, b_out = [], []
        xs, ys = batch.column("x_codes"), batch.column("y_codes")
        for i, rotation in enumerate(batch.column("rotation").to_pylist()):
            x = np.asarray(xs[i].values).view(np.uint64)
            if ys[i].is_valid:
                y = np.asarray(ys[i].values).view(np.uint64)
                a, b = close_pairs(x, y)
                codes, b = np.concatenate([x, y]), b + len(x)
            else:
                codes, (a, b) = x, close_pairs(x)
            low = _forest(len(codes), a, b)
            prints = _turn_back(codes, rotation).view(np.int64)
            link = low != np.arange(len(codes))
            a_out.append(prints[link]), b_out.append(prints[low[link]])
        none = [np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v or none)) for v in (a_out, b_out)], names=["a", "b"])


def close_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) whose connected components are those of the distinct
    fingerprints ``prints`` (fp) at BITS bits; a stored table."""
    blocks = saved(index_blocks(prints), "blocks")
    schema = "a bigint, b bigint"
    inside = blocks.where(F.size("codes") > 1).select(
        "rotation", F.col("codes").alias("x_codes"), F.lit(None).cast("array<bigint>").alias("y_codes"))
    keys = ["rotation", "root"]
    codes = {s: blocks.select(*keys, F.col("block").alias(f"{s}_block"), F.col("codes").alias(f"{s}_codes")) for s in "xy"}
    across = block_pairs(blocks).join(codes["x"], [*keys, "x_block"]).join(codes["y"], [*keys, "y_block"])
    return saved(inside.mapInArrow(_linker, schema).unionByName(
        across.select("rotation", "x_codes", "y_codes").mapInArrow(_linker, schema)).distinct(), "links")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hexadecimal
    digits), component_id (the smallest doc_id reachable over fingerprints at
    most BITS bits apart, itself included).

    Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows give equal rows; rows of one id with different texts are
    judged each by its own text. A row without an id is in no group: it gets a
    fingerprint and no component. An empty table gives no rows."""
    prints = saved(fingerprints(docs, doc_id, text), "fingerprints")
    classes = saved(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    comp = connected_components(close_links(classes.select("fp"))).select(F.col("id").alias("fp"), "component")
    member = classes.join(comp, "fp")
    lows = member.groupBy("component").agg(F.min("low").alias("first"))
    linked = member.join(lows, "component").select("fp", "first")
    of_class = classes.join(linked, "fp", "left").select("fp", F.coalesce("first", "low").alias("low"))
    out = prints.join(of_class, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("low")).alias("component_id"))
