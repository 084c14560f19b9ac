import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import kneser_ney, topk, toxicity

SF = "/root/testdata/sf0.01"


# --- toxicity ---------------------------------------------------------------


def test_misspellings_share_subwords():
    rng = random.Random(3)
    plain = ["and", "the", "river", "stone", "walk", "green", "quiet", "table", "window", "paper", "seven", "cloud"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["blargidiot", "blargidiots", "Blargidiot,", "grumpoloser"]))
        texts.append(" ".join(words).encode())
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels)
    scores = toxicity._WordScores(model.word_logits())
    scores.learn([[b"blargidioth", b"xblargidiot", b"river"]])
    assert min(scores[b"blargidioth"], scores[b"xblargidiot"]) > 5 * abs(scores[b"river"]) > 0


def test_gradient_steps_lower_the_loss():
    texts, labels = [b"aa bb", b"cc dd", b"aa dd", b"cc bb"] * 8, [1, 0, 1, 0] * 8
    model = toxicity.train(texts, labels, epochs=(60, 0))
    logits = toxicity._WordScores(model.word_logits())
    logits.learn([[b"aa", b"bb", b"cc", b"dd"]])
    odds = [np.mean([logits[w] for w in t.split()]) + model.base for t in texts[:4]]
    assert min(odds[0], odds[2]) > 0 > max(odds[1], odds[3])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    judged = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert len(judged) > 40 and (judged["predicted"] == judged["toxic"]).mean() > 0.9


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (2, ""), (3, "x" * 100_000), (4, "bad bad")], "doc_id long, text string").selectExpr("*", "'s' AS score", "1 AS predicted")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (4, 1), (99, 1), (4, 7)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


# --- language model ---------------------------------------------------------


def brute(texts, train):
    words = lambda t: ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), "</s>"]
    pairs = Counter(p for t in train for p in zip(words(t), words(t)[1:]))
    total, count, after, before = Counter(), Counter(), defaultdict(list), Counter()
    for (a, w), c in pairs.items():
        total[a] += c
        count[w] += c
        after[a].append(c)
        before[w] += 1
    of = lambda values: [sum(v == i for v in values) for i in (1, 2, 3, 4)]
    d2, d1 = kneser_ney.discounts(*of(pairs.values())), kneser_ney.discounts(*of(before.values()))
    spare = sum(d1[min(n, 3)] for n in before.values()) / len(pairs) if pairs else 1.0

    def low(w):
        return max(before[w] - d1[min(before[w], 3)], 0) / max(1, len(pairs)) + spare / (len(count) + 1)

    def p(a, w):
        if not total[a]:
            return low(w)
        kept = sum(d2[min(c, 3)] for c in after[a])
        return (max(pairs[a, w] - d2[min(pairs[a, w], 3)], 0) + kept * low(w)) / total[a]

    n = sum(count.values())
    out = []
    for t in texts:
        s = words(t)
        out.append((len(s) - 1, sum(count[w] > 0 for w in s[1:]), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in s[1:]), sum(math.log10(p(a, w)) for a, w in zip(s, s[1:]))))
    return out, n, p, list(count)


def test_scores_against_plain_code(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "the", "THE"]
    texts = [" ".join(rng.choices(vocabulary, weights=range(63, 0, -1), k=rng.randint(0, 120))) for _ in range(90)] + [None, "", "zzz unseen the", "the " * 3000, "a\x85b c\xa0d"]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    want, n, p, known = brute(texts, [t for t, h in zip(texts, held) if not h])
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()), shard_bytes=500)
    assert model.bits >= 5 and model.sums["tokens"] == n
    rows = {r.doc_id: r for r in kneser_ney.scored(docs, model).collect()}
    for i, (tokens, seen, base, score) in enumerate(want):
        assert (rows[i].n_tokens, rows[i].n_known) == (tokens, seen)
        assert math.isclose(rows[i].base_score, base, rel_tol=1e-9) and math.isclose(rows[i].score, score, rel_tol=1e-9)
    # a distribution: over all known words and one unknown
    assert all(math.isclose(sum(p(a, w) for w in known) + p(a, "?"), 1) for a in ("<s>", "the", "never"))
    full = {r.doc_id: r for r in kneser_ney.language_model_scores(docs).collect()}
    assert all(full[i].held_out == h and full[i].train_tokens == n and math.isclose(full[i].score, want[i][3], rel_tol=1e-9) for i, h in enumerate(held))


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), (0, "a a")], "doc_id long, text string")
    assert kneser_ney.language_model_scores(docs.limit(0)).count() == 0
    rows = kneser_ney.scored(docs, kneser_ney.train(docs.limit(0))).collect()
    assert len(rows) == 2 and all(r.score == 0 and r.n_known == 0 for r in rows)


# --- top k ------------------------------------------------------------------


def test_top_k_against_plain_code(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(130, 6)).round(1)
    x[40:80] = x[3]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(200, None, 0), (250, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (300, [float("nan")] * 6, 0), (350, [float("inf")] * 6, 0), (400, [1.0, 2.0], 0), (401, [0.5, -1.0], 0), (450, [9.0], 0), (None, [1.0] * 6, 0)]
    table = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    got = defaultdict(list)
    for r in topk.top_k(table, table.where("vec_id % 50 = 0"), block=32, pivots=8).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = {i: [math.floor(256 * c) for c in v] for i, v, _ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    want = {}
    for q in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
            if scored:
                want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert {q: sorted(v) for q, v in got.items()} == want and len(want[400]) == 1 and 450 not in got
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_bounds_are_exact_in_blocks_of_clusters(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 20, (500, 4)) + 1000 * k for k in range(1, 9)]).astype(np.int64)
    pivots = x[::500].astype(float)
    frame = lambda v, ids: pd.DataFrame({"vec_id": ids, "ints": [r.tobytes() for r in v], "dist": [np.sqrt(((pivots - r) ** 2).sum(axis=1)).tobytes() for r in v]})
    evaluated = []
    monkeypatch.setattr(topk, "_STEP", 50)
    monkeypatch.setattr(topk, "sorted", lambda rows: evaluated.append(len(rows)) or sorted(rows), raising=False)
    got = topk._search(frame(x[-1:], [10_000]), frame(x, np.arange(len(x))), 5)
    assert sorted(got["score"], reverse=True) == sorted((x @ x[-1]).tolist(), reverse=True)[:5]
    assert 0 < sum(evaluated) < 1500  # of 4,000: clusters that the pivots place too far are never scored
