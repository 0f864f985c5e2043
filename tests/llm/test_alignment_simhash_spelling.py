"""Tokenizer alignment, SimHash groups and spelling groups against brute force
on small rows: nulls, empty and long texts, ties, repeated rows, empty tables,
clashing columns, hot keys."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravel.llm import alignment, common, simhash, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def sp(spark):
    common.prepare(spark)
    # small batches, so that groups cross them
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def frame(sp, values, extra=()):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(values)] + list(extra)
    return sp.createDataFrame(rows, DOCS).repartition(3, F.xxhash64("text", F.col("doc_id")))


ODD = [None, "", " ", "  two  spaces ", " led", "trailing ", "\ttab\n\nline", "<|endoftext|> a <s>b</s> <unk>", "x▁y ▁ z",
       "nul\x00char", "漢字 かな 🙂🙂 é", "a b   c", "1234567 89", "don't won't", "<0x41>", "\x1c \x1d x", "A" * 300,
       "word " * 400, "﻿bom", "é" * 50, " ".join(f"w{i}" for i in range(500)), "a\r\nb\x0bc", "ﬁ ½ ①"]


# --- tokenizer alignment ---------------------------------------------------

def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(alignment.TOKENIZER_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.TOKENIZER_B)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(x): x for x in plain}
    chars |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    a_bytes = lambda i: bytes(chars[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        want = b" " + text.encode() if text else b""
        if not text or b"".join(map(a_bytes, ia)) != want or b"".join(map(b_bytes, ib)) != want:
            docs.append((doc_id, 0, 0, [], ""))
            continue
        ends = [dict(zip(np.cumsum([len(f(i)) for i in ids]).tolist(), range(len(ids)))) for f, ids in ((a_bytes, ia), (b_bytes, ib))]
        common_ends = sorted(set(ends[0]) & set(ends[1]))
        pa_, pb, parts, links = 0, 0, [], []
        for e in common_ends:
            x, y = ends[0][e] + 1, ends[1][e] + 1
            parts.append(",".join(map(str, ia[pa_:x])) + "|" + ",".join(map(str, ib[pb:y])))
            links.append((ia[x - 1], ib[y - 1]))
            pa_, pb = x, y
        counts.update(links)
        docs.append((doc_id, len(ia), len(ib), links, ";".join(parts)))
    best = defaultdict(int)
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter((d, na, nb, len(ls), len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls),
                    sha256(s.encode()).hexdigest() if s else "") for d, na, nb, ls, s in docs)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_odd_texts(sp):
    docs = frame(sp, ODD, [(3, ODD[3], "en", "s", 1), (None, "no id here", None, None, None)])
    got = alignment.alignment(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in ALIGNED) for r in got.collect()) == brute_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_documents(spark):
    common.prepare(spark)
    docs = spark.read.parquet(SF)
    got = alignment.alignment(docs)
    assert Counter(tuple(r[c] for c in ALIGNED) for r in got.collect()) == brute_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_long_text_and_slices(sp, monkeypatch):
    rnd = random.Random(3)
    long = " ".join("".join(rnd.choices("abcdeé ,.", k=rnd.randint(1, 9))) for _ in range(40000))
    docs = frame(sp, [long, "short", None, long])
    assert Counter(tuple(r[c] for c in ALIGNED) for r in alignment.alignment(docs).collect()) == brute_alignment(
        [(i, t) for i, t in enumerate([long, "short", None, long])])


def test_alignment_units_equal_whole_texts():
    with open(alignment.TOKENIZER_A, "rb") as f, open(alignment.TOKENIZER_B, "rb") as g:
        al = alignment.Aligner(f.read(), g.read())
    assert al.parts_at_spaces
    rnd = random.Random(5)
    alphabet = "ab Z  \n\t.,'!é漢🙂▁  \x1c019s"
    for _ in range(1500):
        text = "".join(rnd.choices(alphabet, k=rnd.randint(1, 40)))
        units = al.units(text)
        assert " ".join(units) == text
        for t in (al.a, al.b):
            assert [i for x in t.encode(units) for i in x] == t.encode([text])[0], text


def test_alignment_bound_holds(sp):
    with open(alignment.TOKENIZER_A, "rb") as f, open(alignment.TOKENIZER_B, "rb") as g:
        al = alignment.Aligner(f.read(), g.read())
    most = al.most_pairs()
    pairs = alignment.pair_counts(alignment.aligned_documents(frame(sp, ODD))).collect()
    assert 0 < len(pairs) <= most <= alignment.MAX_PAIRS
    for r in pairs:
        x, y = al.a.pieces[r.pair >> 32], al.b.pieces[r.pair & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)


def test_alignment_empty_and_clashing(sp):
    assert alignment.alignment(frame(sp, []).where("false")).count() == 0
    clash = frame(sp, ["a b", None]).withColumn("pairs", F.lit(1)).withColumn("n_a", F.lit("x")).withColumn("times", F.lit(0))
    assert sorted(r.n_a for r in alignment.alignment(clash).collect()) == [0, 2]
    named = frame(sp, ["a b"]).withColumnsRenamed({"doc_id": "k", "text": "body"}).withColumn("text", F.lit("other"))
    assert alignment.alignment(named, doc_id="k", text="body").first().n_a == 2


# --- SimHash groups --------------------------------------------------------

def brute_print(text):
    from xxhash import xxh64_intdigest
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    k = min(3, len(w))
    h = [xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (doc_id, fp) with doc_id not null -> {fp: smallest doc_id}"""
    fps = sorted({p for _, p in prints})
    low = {p: min(d for d, q in prints if q == p) for p in fps}
    at = {p: p for p in fps}

    def find(p):
        while at[p] != p:
            p = at[p]
        return p
    v = np.array(fps, np.uint64)
    for i, p in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 3):
            a, b = find(p), find(fps[j])
            if a != b:
                at[max(a, b)] = min(a, b)
    best = {}
    for p in fps:
        best[find(p)] = min(best.get(find(p), low[p]), low[p])
    return {p: best[find(p)] for p in fps}


def test_simhash_fingerprints_equal_spark_hashes(sp):
    docs = frame(sp, ODD)
    one = [r for r in docs.collect() if r.text and len(r.text.split()) == 3]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect()}
    for r in one:   # one shingle: the fingerprint is its hash
        w = " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(LOW)))
        if len(w.split(" ")) == 3:
            assert got[r.doc_id] == sp.range(1).select(F.xxhash64(F.lit(w)).alias("h")).first().h


def near_copies(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Ñu"]
    out = list(ODD)
    for _ in range(25):
        t = rnd.choices(vocab, k=rnd.choice((2, 30, 400, 900)))
        out.append(" ".join(t))
        for _ in range(rnd.randint(0, 5)):
            u = list(t)
            u[rnd.randrange(len(u))] = "changed"
            out += [" ".join(u), " ".join(u).upper()]
    return out


def check_simhash(sp, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [(d, brute_print(t)) for d, t in rows]
    comp = brute_components([x for x in prints if x[0] is not None])
    want = Counter((d, f"{p:016x}", None if d is None else comp[p]) for d, p in prints)
    got = simhash.simhash_groups(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == want
    return want


def test_simhash_groups(sp):
    docs = frame(sp, near_copies(), [(5, ODD[5], "x", "y", None), (5, "another text of id five", "x", "y", None), (None, "no id", "x", "y", None)])
    want = check_simhash(sp, docs)
    assert sum(1 for d, _, c in want if c is not None and d != c) > 20


def test_simhash_documents(spark):
    common.prepare(spark)
    check_simhash(spark, spark.read.parquet(SF))


def brute_labels(fps):
    return brute_components(list(enumerate(fps)))


def labels_of(sp, fps):
    signed = [int(np.uint64(p).astype(np.int64)) for p in fps]
    prints = sp.createDataFrame([(p,) for p in sorted(set(signed))], "fp bigint").repartition(4)
    links = simhash.close_links(prints)
    comp = {r.id: r.component for r in common.connected_components(links).collect()}
    groups = defaultdict(list)
    for i, p in enumerate(signed):
        groups[comp.get(p, p)].append(i)
    return {fps[i]: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("shape", ["hot root", "dense cluster", "chain", "mixed"])
def test_simhash_index_against_brute_force(sp, monkeypatch, shape):
    """Small blocks and fans, so that one root has several levels of nodes."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "LEAF", 4)
    rnd = random.Random(shape)
    if shape == "hot root":       # all in one root, few links
        fps = [0xABCD << 48 | rnd.getrandbits(48) for _ in range(500)]
        fps += [p ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for p in fps[:80]]
    elif shape == "dense cluster":
        base = rnd.getrandbits(64)
        fps = [base ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for _ in range(400)]
    elif shape == "chain":
        fps = [rnd.getrandbits(64)]
        for _ in range(120):
            fps.append(fps[-1] ^ 7 << rnd.randrange(60))
    else:
        fps = [0, (1 << 64) - 1, 1 << 63, 7, 15] + [rnd.getrandbits(64) for _ in range(200)]
        fps += [p ^ (1 << 15 | 1 << 31 | 1 << 47) for p in fps[:50]] + [p ^ (15 << 14) for p in fps[50:90]]
    fps = list(dict.fromkeys(fps))
    real = simhash.block_pairs
    monkeypatch.setattr(simhash, "block_pairs", lambda b: real(b, fan=3))
    assert labels_of(sp, fps) == brute_labels(fps)


def test_simhash_rank_and_rotation(sp):
    v = [0, 1, -1, 5, 1 << 62, -(1 << 63), 123456789123]
    df = sp.createDataFrame([(x,) for x in v], "c bigint")
    for r in df.select("c", simhash.gray_rank(F.col("c")).alias("g"), simhash.rotated(F.col("c"), 16).alias("t")).collect():
        c, g = r.c % 2**64, r.g % 2**64
        assert g ^ g >> 1 == c          # the g-th Gray code is c
        assert r.t % 2**64 == ((c << 16) | (c >> 48)) % 2**64


def test_simhash_pairs_inside_and_between():
    rnd = random.Random(2)
    x = sorted(rnd.getrandbits(64) for _ in range(150))
    x += [p ^ 5 for p in x[:70]]
    y = [p ^ 3 for p in x[::3]]
    a, b = np.array(x, np.uint64), np.array(y, np.uint64)
    i, j = simhash.close_pairs(a)
    assert set(zip(i.tolist(), j.tolist())) == {(p, q) for p in range(len(x)) for q in range(p + 1, len(x)) if (x[p] ^ x[q]).bit_count() <= 3}
    i, j = simhash.close_pairs(a, b)
    assert set(zip(i.tolist(), j.tolist())) == {(p, q) for p in range(len(x)) for q in range(len(y)) if (x[p] ^ y[q]).bit_count() <= 3}


def test_simhash_empty_and_clashing(sp):
    assert simhash.simhash_groups(frame(sp, []).where("false")).count() == 0
    clash = frame(sp, ["a b c", "a b c", None, ""]).withColumn("fp", F.lit(1)).withColumn("low", F.lit("x")).withColumn("component", F.lit(0))
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(clash).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


# --- spelling groups -------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, least=5, times=3, every=97):
    n = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if every and h % every == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            n[r] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= times}


def brute_groups(n):
    cut = defaultdict(set)
    for w in n:
        cut[w].add(w)
        for i in range(len(w)):
            cut[w[:i] + w[i + 1:]].add(w)
    links = defaultdict(set)
    for words in cut.values():
        for a in words:
            links[a] |= {b for b in words if near(a, b)}
    form = {}
    for w in n:
        best = min(links[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = Counter()
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out[(w, form[w], r, n[w], len(links[w]), n[form[w]] if form[w] else None)] += 1
    return out


SPELLED = ["word", "form", "root", "n", "n_near", "form_n"]


def spelled(df):
    assert df.columns == SPELLED
    return Counter(tuple(r[c] for c in SPELLED) for r in df.collect())


def misspelt(seed=4, n=300):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcéÿ", k=rnd.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "abababab", "babababa", "Ünder×word"]
    out = [None, "", "12 34", "ABCDE abcde ÀBCDE àbcde", "x" * 3000 + " " + "abcab " * 500]
    for _ in range(n):
        words = []
        for w in rnd.choices(base, k=30, weights=[1 / (i + 1) for i in range(len(base))]):
            if rnd.random() < 0.2:
                i = rnd.randrange(len(w))
                w = rnd.choice((w[:i] + w[i + 1:], w[:i] + rnd.choice("abcé") + w[i:], w[:i] + rnd.choice("abc") + w[i + 1:]))
            words.append(w.upper() if rnd.random() < 0.1 else w)
        out.append(rnd.choice((" ", "-", "_1")).join(words))
    return out


@pytest.mark.parametrize("part, buffer", [(2048, 8192), (5, 16)])
def test_spelling_groups(sp, monkeypatch, part, buffer):
    """With parts of five words every key is hot and cut into many parts."""
    monkeypatch.setattr(spelling, "BUFFER", buffer)
    monkeypatch.setattr(spelling, "STRIP", 128 if part > 5 else 4)
    docs = frame(sp, misspelt(), [(9, misspelt()[9], "e", "s", 1), (None, "abcab abcab abcab ababab", "e", "s", 1)])
    want = brute_groups(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert spelled(spelling.spelling_groups(docs, part=part)) == want
    assert sum(1 for w in want if w[1] is not None) > 50 and sum(1 for w in want if w[1] != w[2] and w[1]) > 0


def test_spelling_documents(spark):
    common.prepare(spark)
    docs = spark.read.parquet(SF)
    want = brute_groups(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert spelled(spelling.spelling_groups(docs)) == want


def test_spelling_near_rows_exact():
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choices("ab", k=rnd.randint(5, 7))) for _ in range(120)})
    # all words filed under one key of each kind, as if every hash collided: each pair still counts once
    found = Counter()
    for longer in (5, 6, 7):
        for last in (False, True):
            some = [w for w in words if longer - 1 <= len(w) <= longer]
            z = np.zeros(len(some), np.int64)
            x, y = spelling.near_rows(some, z, z + 2, z + longer, np.full(len(some), last))
            found.update(tuple(sorted((some[i], some[j]))) for i, j in zip(x, y))
    assert found == Counter((a, b) for i, a in enumerate(words) for b in words[i + 1:] if near(a, b))


def test_spelling_ties_and_chains(sp):
    # ties in n go to the smallest word; a chain of doublings leads to the last word
    text = "plane " * 3 + "plant " * 6 + "plans " * 6 + "slant " * 12 + "slantx " * 24 + "zzzzz " * 2
    docs = frame(sp, [text])
    got = {r.word: r for r in spelling.spelling_groups(docs, delete_every=None).collect()}
    assert (got["plane"].form, got["plane"].root, got["plane"].n_near) == ("plans", "plans", 2)
    assert got["plant"].root == got["slant"].root == "slantx" and "zzzzz" not in got
    assert got["plans"].form is None and got["plans"].form_n is None


def test_spelling_empty_and_clashing(sp):
    assert spelling.spelling_groups(frame(sp, []).where("false")).count() == 0
    assert spelling.spelling_groups(frame(sp, [None, "", "aa"])).count() == 0
    clash = frame(sp, ["abcdef abcdef abcdef"] * 3).withColumn("word", F.lit("w")).withColumn("n", F.lit(0)).withColumn("run", F.lit(0))
    assert spelled(spelling.spelling_groups(clash, delete_every=None)) == Counter({("abcdef", None, "abcdef", 9, 0, None): 1})
    with pytest.raises(ValueError):
        spelling.spelling_groups(clash, min_length=1)
