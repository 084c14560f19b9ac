import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, negatives, variants

PATH = public_tokenizers.path(byte_bpe.RANKS)


# --- byte-level BPE ---------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, public_tokenizers.PATTERN)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab the in'sé \n01"), st.characters(exclude_categories=("Cs",))), max_size=120), max_size=30))
def test_ids_are_those_of_the_library(plain, codec, texts):
    texts = [*texts, "a" * 1001, "abab" * 200, "<|endoftext|>", "  \n\n  x's 'S"]
    ids = list(codec.encode(texts))
    assert [x.tolist() for x in ids] == [plain.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in ids] == [t.encode() for t in texts]
    assert [codec.decimals(x) for x in ids] == [" ".join(map(str, x.tolist())).encode() for x in ids]


def test_every_letter_and_long_runs(plain, codec):
    points = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    texts = ["a ".join(points[i : i + 500]) for i in range(0, len(points), 500)] + [" " * 5000, "x" * 100_000, "".join(random.Random(1).choices("etaoin", k=60_000))]
    assert [x.tolist() for x in codec.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_merges_of_lower_rank_come_first():
    # "ab" makes "abc" possible, which ranks below "ab": the second "ab" of a word waits for it.
    ranks = {bytes([b]): 10 + b for b in range(256)} | {b"abc": 1, b"ab": 2, b"cab": 3}
    merges = byte_bpe.Merges(ranks)
    plain = tiktoken.Encoding("own", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    words = ["abcab", "cabcab", "abab", *("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(400))]
    ids, length = merges.replay([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(length)[:-1])] == [plain.encode_ordinary(w) for w in words]


def test_digests_of_odd_rows(spark, plain):
    texts = [None, "", "ab", "ab", "é\x00ü 日本", "word " * 30_000]
    rows = [(None if i == 2 else i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter((i, len(plain.encode_ordinary(t or "")), sha(" ".join(map(str, plain.encode_ordinary(t or ""))).encode()), sha((t or "").encode())) for i, t, _ in rows)
    assert Counter(map(tuple, byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN, window=10).collect())) == want
    assert byte_bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    ids = byte_bpe.encoded(docs, PATH, public_tokenizers.PATTERN)
    back = byte_bpe.decoded(ids.union(spark.createDataFrame([(9, None)], ids.schema)), PATH).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter([(i, (t or "").encode()) for i, t, _ in rows] + [(9, b"")])
    with pytest.raises(Exception, match="no token"):
        byte_bpe.decoded(spark.createDataFrame([(1, [10**6])], ids.schema), PATH).collect()


# --- hard negatives ---------------------------------------------------------


def plain_negatives(rows, k_positives=5, k=5, low=80, high=100):
    """Rows (vec_id, vector, label) that take part, in any order of equal ids."""
    out = Counter()
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for n, (a, v, label) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = [(b, sum(x * y for x, y in zip(v, w)), other) for m, (b, w, other) in enumerate(rows) if m != n and len(v) == len(w)]
        for p, score, _ in sorted((r for r in scored if r[2] == label), key=order)[:k_positives]:
            near = [r for r in scored if r[2] != label and low * score <= 100 * r[1] <= high * score]
            out.update((a, p, i, r[0], score, r[1]) for i, r in enumerate(sorted(near, key=order)[:k], 1))
    return out


@pytest.mark.parametrize("blocks", [(4, 16), (4096, 16_384)])
def test_negatives_against_plain_code(spark, blocks):
    rng = np.random.default_rng(2)
    rows = [(i * 10, v.tolist(), int(rng.integers(4))) for i, v in enumerate(rng.normal(size=(160, 3)).round(1) + 0.4)]
    rows += [(5, [1.0, 1.0, 1.0], 2), (5, [1.0, 1.0, 1.0], 2), (None, [1.0, 1.0, 1.0], 1), (200, [0.5, 0.25, 1.0], 0), (1700, [1.0, 2.0], 0), (1701, [1.0, 2.5], 0), (1702, [1.0, 1.9], 1), (1800, [], 0)]
    rows += [(1900, None, 0), (2000, [1.0, None, 2.0], 0), (2100, [float("nan")] * 3, 0), (2200, [float("inf")] * 3, 1), (2300, [1.0, 1.0, 1.0], None)]
    table = spark.createDataFrame([(*r, 1.5) for r in rows], "vec_id long, embedding array<double>, label int, score double")
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = negatives.hard_negatives(negatives.prepared(table), F.col("vec_id") % 100 == 0, anchor_block=blocks[0], row_block=blocks[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == plain_negatives(good) and got.count() > 100


def test_negatives_at_other_limits_and_of_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 20, rng.integers(0, 3, 2).tolist(), i % 3) for i in range(60)]
    table = negatives.prepared(spark.createDataFrame([(i, [x / 256 for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int"))
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, k_positives=3, k=2, low=50, high=95)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, 3, 2, 50, 95)
    assert negatives.hard_negatives(table, F.lit(False)).count() == 0
    assert negatives.hard_negatives(table.where("label = 1"), F.lit(True)).count() == 0


def test_products_beyond_floating_point():
    a, x = np.array([[2**30, 3]]), np.array([[2**31, 1], [-(2**30), 7]])
    assert negatives._products(a, x).tolist() == [[2**61 + 3, -(2**60) + 21]]


# --- spelling variants ------------------------------------------------------


def near(a, b):
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, slip=97, least_letters=5, least_n=3, ratio=2):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if slip and key is not None and h % slip == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_letters and c >= least_n}
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    beside = {w: [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if near(w, x)] for w in n}
    form = {w: min(x, key=lambda o: (-n[o], o)) for w, x in beside.items() if x}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (w, form.get(w), root(w), n[w], len(beside[w]), n.get(form.get(w))) for w in n}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), unique=True, max_size=20), st.text("abé", min_size=1, max_size=8))
def test_position_index(words, word):
    found = variants.PositionIndex(words).near(word)
    assert {w for i, w in enumerate(words) if found >> i & 1} == {w for w in words if near(w, word)}


@pytest.mark.parametrize("block", [3, 16_384])
def test_variants_against_plain_code(spark, block):
    rng = random.Random(6)
    stems = ["colour", "Größe", "straße", "NAÏVE", "banana", "aaaaaa", "thé×÷Þ"]
    def spelled():
        w = list(rng.choice(stems))
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2, 3))):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(("", "a", "n", "u", "é"))
        return "".join(w)
    rows = [(i, " ".join(spelled() for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(None, "banana bananaa bananaa bananaa"), (500, None), (501, ""), (501, "colour," * 3000), (502, "z" * 20_000 + " " + "z" * 19_999 + "y ")] + [(503, "z" * 20_000)] * 3
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = {r.word: tuple(r) for r in variants.spelling_variants(docs, block=block).collect()}
    assert got == plain_variants(rows) and sum(x[1] is not None for x in got.values()) > 50
    assert max(len(w) for w in got) == 20_000


def test_variants_of_short_words_chains_and_nothing(spark):
    words = [("a", 1), ("b", 2), ("ab", 4), ("abc", 8), ("abcd", 16), ("abcde", 32), ("xbcde", 31), ("q", 1)]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: tuple(r) for r in variants.spelling_variants(docs, least_letters=1, least_n=1, slip=0).collect()}
    assert got == plain_variants(rows, slip=0, least_letters=1, least_n=1)
    assert {got[w][2] for w in ("a", "ab", "abc", "abcd", "abcde")} == {"abcde"} and got["xbcde"][2] == "xbcde"
    assert variants.spelling_variants(docs.limit(0)).count() == 0
