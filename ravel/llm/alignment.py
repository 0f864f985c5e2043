"""Alignment of two tokenizers over the same texts, in Arrow.

Both tokenizers encode a text; their tokens cover the same bytes. Where a token
of each ends at the same byte offset the text is cut, and the two tokens that
end there are linked. Over the corpus every pair of ids is counted.

A text is cut into units first, at single spaces between characters that are
not white space. Neither tokenizer has a token across such a place (checked
when they are loaded; else a text is one unit), so a unit is encoded by itself,
and the distinct units of a batch are encoded once:

* token lists are flattened, with the unit of each token as its parent index;
* a cumulative sum of token sizes, taken anew in every unit, gives byte ends;
* an Acero hash join on (unit, end) gives the links, and the group borders;
* ``Table.group_by`` counts the pairs of a batch, Spark sums the counts.

The links of a document are kept as its distinct pairs with their numbers, so
its counts are looked up later without encoding the text again. The table of
pairs is bounded by the vocabularies alone: the shorter of two linked tokens is
a suffix of the longer one."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
FILE_BYTES = 64 << 20      # the most a tokenizer file may hold; it is broadcast
MAX_PAIRS = 8 << 20        # the most pairs two vocabularies may allow; their counts are broadcast
SLICE_CHARS = 4 << 20      # characters of texts handled at once (a longer text by itself)

_BORDER = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")   # to tokenizer B the character ▁ is a space
_LOW = (1 << 32) - 1


def _read(spark: SparkSession, path: str) -> bytes:
    """A tokenizer file; a path with a scheme is read by Spark, any other by
    the driver."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            data = f.read(FILE_BYTES + 1)
    if len(data) > FILE_BYTES:
        raise ValueError(f"the tokenizer {path} has more than {FILE_BYTES} bytes")
    return data


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: visible
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _text(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the ``tokenizers`` library. Encodes
    a space and the text."""

    def __init__(self, data: bytes):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        from tokenizers import Tokenizer
        text = data.decode()
        self._t = Tokenizer.from_str(text)
        self._t.encode_special_tokens = True
        byte = _byte_level()
        added = {t["id"]: t["content"].encode() for t in json.loads(text).get("added_tokens", [])}
        names = {i: bytes(byte[c] for c in w) for w, i in self._t.get_vocab(with_added_tokens=False).items()}
        names |= added
        self.pieces = [names.get(i, b"?") for i in range(max(names) + 1)]
        pre = json.loads(text).get("pre_tokenizer") or {}
        self.parts_at_spaces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) \
            and json.loads(text).get("normalizer") is None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._t.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a ``sentencepiece`` model, which adds the space itself."""

    def __init__(self, data: bytes):
        import sentencepiece
        self._s = s = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [s.id_to_piece(i) for i in range(s.vocab_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(names)]
        # no piece holds a space behind another character, so no merge reaches over one
        self.parts_at_spaces = all("▁" not in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._s.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.parts_at_spaces = self.a.parts_at_spaces and self.b.parts_at_spaces
        if not all(self.a.pieces) or not all(self.b.pieces):
            raise ValueError("a token without bytes ends nowhere")
        self.bytes = [pa.array(t.pieces, pa.large_binary()) for t in (self.a, self.b)]
        self.sizes = [np.asarray(pc.binary_length(x), np.int64) for x in self.bytes]
        self.names = [pa.array(map(str, range(len(x))), pa.large_string()) for x in self.bytes]

    def most_pairs(self) -> int:
        """No more pairs of ids can be linked, whatever the texts: the tokens
        end together, so one of both is a suffix of the other."""
        a, b = Counter(self.a.pieces), Counter(self.b.pieces)
        total = sum(n * b[p[i:]] for p, n in a.items() for i in range(len(p)))
        return total + sum(n * a[p[i:]] for p, n in b.items() for i in range(1, len(p)))

    def units(self, text: str) -> list[str]:
        return _BORDER.split(text) if self.parts_at_spaces else [text]

    def _tokens(self, side: int, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all tokens, the offsets of the units, and which units' tokens
        join to the unit's bytes."""
        lists = (self.a, self.b)[side].encode(units)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        ids = pa.LargeListArray.from_arrays(offsets, pa.array([i for x in lists for i in x], pa.int64()))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.bytes[side].take(ids.flatten())), pa.scalar(b"", pa.large_binary()))
        same = pc.equal(joined, pa.array([b" " + u.encode() for u in units], pa.large_binary()))
        return np.asarray(ids.flatten()), offsets, np.asarray(same)

    def align(self, units: list[str]) -> dict:
        """Per unit: fits (do both tokenizers give its bytes?), n_a, n_b, groups
        (as text), and the pairs of its links as a list, a << 32 | b."""
        tokens = [self._tokens(side, units) for side in (0, 1)]
        fits = tokens[0][2] & tokens[1][2]
        tables, flat = [], []
        for side, (ids, offsets, _) in enumerate(tokens):
            count = np.diff(offsets)
            parent = np.repeat(np.arange(len(units)), count)
            total = np.cumsum(self.sizes[side][ids])
            before = np.concatenate([[0], total])[offsets[:-1]]
            at = np.flatnonzero(fits[parent])                       # the others have no groups
            end = (total - before[parent])[at]
            flat.append((ids[at], parent[at]))
            tables.append(pa.table({"unit": parent[at], "end": end, "ab"[side]: np.arange(len(at))}))
        links = tables[0].join(tables[1], ["unit", "end"], join_type="inner", use_threads=False)
        a, b = (np.sort(np.asarray(links.column(c))) for c in "ab")   # both rise with the unit and the end
        unit = flat[0][1][a]
        texts = [pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], last + 1]), self.names[side].take(pa.array(flat[side][0]))), _text(","))
                 for side, last in enumerate((a, b))]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(units)))])
        groups = pc.binary_join_element_wise(*texts, _text("|"))
        return {"fits": fits, "n": [np.diff(t[1]) for t in tokens],
                "groups": pc.binary_join(pa.LargeListArray.from_arrays(offsets, groups), _text(";")),
                "pairs": pa.LargeListArray.from_arrays(offsets, pa.array((flat[0][0][a] << 32) | flat[1][0][b]))}

    def documents(self, texts: list[str]) -> dict:
        """Per text (none null or empty): n_a, n_b, n_groups, n_links,
        groups_sha256, pairs and times (its distinct pairs, and how often)."""
        lists = [self.units(t) for t in texts]
        known = pa.array([u for x in lists for u in x], pa.large_string()).dictionary_encode()
        found = self.align(known.dictionary.to_pylist())
        code = np.asarray(known.indices, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        odd = np.flatnonzero(np.add.reduceat(~found["fits"][code], offsets[:-1]) > 0) if len(texts) else []
        if len(odd) and any(len(lists[i]) > 1 for i in odd):
            # tokens that do not give a unit's bytes say nothing of the units beside it: the text is one unit
            self_units, whole = self.units, {texts[i] for i in odd}
            try:
                self.units = lambda t: [t] if t in whole else self_units(t)
                return self.documents(texts)
            finally:
                del self.units
        fit = np.ones(len(texts), bool)
        fit[odd] = False
        mine = [np.add.reduceat(n[code], offsets[:-1]) * fit for n in found["n"]]
        strings = pc.binary_join(pa.LargeListArray.from_arrays(offsets, found["groups"].take(pa.array(code))), _text(";"))
        digest = [sha256(s.as_buffer()).hexdigest() if ok else "" for s, ok in zip(strings, fit)]
        each = found["pairs"].take(pa.array(code))
        n = np.asarray(pc.list_value_length(each), np.int64)
        doc = np.repeat(np.repeat(np.arange(len(texts)), np.diff(offsets)), n)
        once = pa.table({"doc": doc, "pair": each.flatten()}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        once = once.sort_by([("doc", "ascending"), ("pair", "ascending")])
        cuts = np.searchsorted(np.asarray(once.column("doc")), np.arange(len(texts) + 1))
        links = np.bincount(doc, minlength=len(texts))
        return {"n_a": mine[0], "n_b": mine[1], "n_groups": links, "n_links": links, "groups_sha256": digest, "cuts": cuts,
                "pairs": np.asarray(once.column("pair")), "times": np.asarray(once.column("count_all"))}


_loaded: dict = {}


def _aligner(broadcast) -> Aligner:
    """One aligner per worker and pair of files."""
    key = hash(broadcast.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(*broadcast.value)
    return _loaded[key]


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _encoder(files):
    def slices(size: np.ndarray) -> Iterator[slice]:
        """Runs of texts of at most SLICE_CHARS, or of one."""
        s = 0
        while s < len(size):
            e = s + max(1, int(np.searchsorted(np.cumsum(size[s:]), SLICE_CHARS, side="right")))
            yield slice(s, e)
            s = e

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        for whole in batches:
            size = np.asarray(pc.fill_null(pc.utf8_length(whole.column("text").cast(pa.large_string())), 0), np.int64)
            for part in slices(size):
                batch = whole.slice(part.start, part.stop - part.start)
                filled = np.flatnonzero(size[part] > 0)
                out = aligner.documents(batch.column("text").take(pa.array(filled)).to_pylist()) if len(filled) else None
                cols, n = [batch.column("doc_id")], batch.num_rows
                for c in _NUMBERS:
                    v = np.zeros(n, np.int64)
                    if out:
                        v[filled] = out[c]
                    cols.append(pa.array(v))
                digest = np.full(n, "", object)
                length = np.zeros(n, np.int64)
                if out:
                    digest[filled] = out["groups_sha256"]
                    length[filled] = np.diff(out["cuts"])
                cols.append(pa.array(digest, pa.string()))
                offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                for c in ("pairs", "times"):
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(out[c] if out else [], pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *_NUMBERS, "groups_sha256", "pairs", "times"])
    return encode


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.table({"pair": batch.column("pairs").flatten(), "n": batch.column("times").flatten()})
        yield from t.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"]).to_batches()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): links per id pair (a << 32 | b) over all documents."""
    return (aligned.select("pairs", "times").mapInArrow(_partial_counts, "pair bigint, n bigint")
                   .groupBy("pair").agg(F.sum("n").alias("n")))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists), np.int64))
            at = np.searchsorted(pairs, np.asarray(lists.flatten()))
            times = np.asarray(batch.column("times").flatten())
            sums = []
            for value in (best[at] * times, counts[at] * times):
                total = np.concatenate([[0], np.cumsum(value)])
                cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                sums.append(pa.array(total[cuts[1:]] - total[cuts[:-1]], pa.int64()))
            names = ["doc_id", *_NUMBERS]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *sums, batch.column("groups_sha256")],
                                             names=[*names, "n_best", "count_sum", "groups_sha256"])
    return score


def aligned_documents(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, stored: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and its links as pairs (a << 32 | b) and their times."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((_read(spark, tokenizer_a), _read(spark, tokenizer_b)))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in _NUMBERS)
    return saved(d.mapInArrow(_encoder(files), f"doc_id {kind}, {numbers}, groups_sha256 string, "
                                               "pairs array<bigint>, times array<bigint>"), "aligned")


def alignment(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose count is the highest of their B id, ties included),
    count_sum (counts of the links summed), groups_sha256.

    A text that is null or empty, or whose tokens do not join to a space and
    its bytes, has no tokens: zeros and an empty string, and it adds nothing to
    the counts. Repeated rows give equal rows and count again; null ids are
    kept; an empty table gives no rows."""
    spark = docs.sparkSession
    most = Aligner(_read(spark, tokenizer_a), _read(spark, tokenizer_b)).most_pairs()
    if most > MAX_PAIRS:
        raise ValueError(f"the vocabularies allow {most} pairs, more than {MAX_PAIRS}")
    aligned = aligned_documents(docs, tokenizer_a, tokenizer_b, doc_id, text)
    counts = pair_counts(aligned).toArrow()    # at most ``most`` rows, however many documents there are
    pairs, n = (np.asarray(counts.column(c), np.int64) for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    top = np.zeros(int((pairs & _LOW).max(initial=0)) + 1, np.int64)
    np.maximum.at(top, pairs & _LOW, n)
    shared = spark.sparkContext.broadcast((pairs, n, (n == top[pairs & _LOW]).astype(np.int64)))
    kind = aligned.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in (*_NUMBERS, "n_best", "count_sum"))
    return aligned.mapInArrow(_scorer(shared), f"doc_id {kind}, {numbers}, groups_sha256 string")
