"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links: where the text leaves the trie at
a node, the longest pieces that the node's string begins with are popped and
matching goes on at the node of what remains. How many pieces each link pops
is computed beforehand, so the number of greedy longest-match pieces of a word
follows in one pass over its bytes, without building a piece."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 16 << 20    # the most a vocabulary may hold; it is broadcast


class LongestMatch:
    """Greedy longest-match piece counts over the byte strings ``pieces``."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                v = self.next[v][c]
            ends[v] = v > 0
        # link: the node of what remains after popping (-1: nothing can be popped); pops: how many pieces
        self.link, self.pops = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if ends[v]:
                    self.link[v], self.pops[v] = 0, 1
                    continue
                z, pops = self.link[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    pops += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.next[z][c], pops

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; -1 if greedy matching gets stuck."""
        nxt, link, pops = self.next, self.link, self.pops
        v = n = 0
        for c in word:
            while c not in nxt[v]:
                n += pops[v]
                v = link[v]
                if v < 0:
                    return -1
            v = nxt[v][c]
        while v:
            n += pops[v]
            v = link[v]
            if v < 0:
                return -1
        return n


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a file with one base64 piece (and its rank) a line. A
    path with a scheme is read by Spark, any other by the driver."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).select("value").toLocalIterator()]
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    pieces = [base64.b64decode(x.split()[0]) for x in lines if x.strip()]
    if sum(map(len, pieces)) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary {path} has more than {VOCABULARY_BYTES} bytes")
    return pieces


_built: dict = {}


def _automaton(broadcast) -> LongestMatch:
    """One automaton per worker and vocabulary."""
    if broadcast.id not in _built:
        _built.clear()
        _built[broadcast.id] = LongestMatch(broadcast.value)
    return _built[broadcast.id]


class _Shared:
    """A broadcast vocabulary and a name for it that workers can see."""

    def __init__(self, spark: SparkSession, pieces: list[bytes]):
        import uuid
        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast(pieces)

    @property
    def value(self):
        return self._b.value


def _counter(shared: _Shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _automaton(shared)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            words = pc.ascii_split_whitespace(texts)
            flat = words.flatten()
            offsets = np.asarray(words.offsets, np.int64)
            full = np.asarray(pc.greater(pc.binary_length(flat), 0))
            offsets = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])[offsets - offsets[0]]
            coded = flat.filter(pa.array(full)).dictionary_encode()
            code = np.asarray(coded.indices, np.int64)
            names = coded.dictionary.cast(pa.large_binary()).to_pylist()
            size = np.fromiter((match.count(b" " + w) for w in names), np.int64, len(names))
            each = size[code] if len(names) else np.empty(0, np.int64)
            # the first word of a text has no space before it
            some = np.flatnonzero(offsets[1:] > offsets[:-1])
            for i in some:
                each[offsets[i]] = match.count(names[code[offsets[i]]])
            stuck = np.concatenate([[0], np.cumsum(each < 0)])
            total = np.concatenate([[0], np.cumsum(np.where(each < 0, 1, each))])
            lo, hi = offsets[:-1], offsets[1:]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(hi - lo), pa.array(total[hi] - total[lo]), pa.array(stuck[hi] - stuck[lo])],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"])
    return count


def token_counts(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown.

    Words are separated by white space; a word is matched with one space
    before it, but for the first of the text. A word in which matching gets
    stuck (the vocabulary lacks a byte) is one token and is counted in
    n_unknown. Null and empty texts have no words and no tokens; repeated rows
    give equal rows; null ids are kept; an empty table gives no rows."""
    shared = _Shared(docs.sparkSession, vocabulary)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_counter(shared), f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
