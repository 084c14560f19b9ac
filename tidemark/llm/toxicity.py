"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained jointly by gradient steps in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, mixed, slices, text_rows

#: Labelled documents that training uses at most, toxic and other, drawn by the hash of their id, and their characters.
SAMPLE = (2000, 4000)
SAMPLE_CHARS = 40_000_000
#: Words of one window.  A text's score is that of its most toxic window, so long texts dilute nothing.
WINDOW = 12
BUCKETS = 1 << 17
#: Gradient steps at least: few texts are gone through more often.
STEPS = 480
#: What embeddings keep at each step: subwords that nothing teaches any more fade.
DECAY = 0.995
DIM = 8
_EDGE = b".,;:!?\"'()[]{}<>*#$%&/-"


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character 3- to 6-grams, ends marked, and of the words themselves, word by word; and how many each has."""
    marked = ["<" + w.strip(_EDGE).decode("utf-8", "replace").lower() + ">" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    size = np.array([len(w) for w in marked], dtype=np.int64)
    start = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(start, size)
    left = np.repeat(size, size) - place  # letters from here to the word's end
    word = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(mixed(letters + (place.astype(np.uint64) << np.uint64(32))), start)
    owners, hashes = [np.arange(len(words))], [mixed(whole)]
    gram = letters
    for n in range(2, 7):
        gram = mixed(gram[:-1]) ^ letters[n - 1 :] if len(gram) > 1 else gram[:0]
        if n > 2:
            there = left[: len(gram)] >= n
            owners.append(word[: len(gram)][there])
            hashes.append(gram[there] + np.uint64(n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mixed(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)[order], np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    """``embedding`` (buckets, dim), ``weight`` (dim, 2), ``bias`` (2): softmax of the mean subword vector of a window's words."""

    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def word_logits(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1; the mean over a bag is linear, so this is exact."""
        return (self.embedding @ (self.weight[:, 1] - self.weight[:, 0])).astype(np.float64)

    @property
    def base(self) -> float:
        return float(self.bias[1] - self.bias[0])


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.steps = rate, {}, 0

    def step(self, name: str, x: np.ndarray, g: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
        m *= 0.9
        m += 0.1 * g
        v *= 0.999
        v += 0.001 * g * g
        t = self.steps
        x -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


class _Corpus:
    """Texts as word numbers, and each word's buckets, flattened."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in t.split()] or [number.setdefault(b"", len(number))], dtype=np.int32) for t in texts]
        words = list(number)
        parts = [subwords(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
        self.flat, self.size = (np.concatenate(x) for x in zip(*((f.astype(np.int32), n) for f, n in parts)))
        self.start = np.cumsum(self.size) - self.size

    def batch(self, bags: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Distinct words of some bags: their buckets and sizes, and the bags as positions among them."""
        words, at = np.unique(np.concatenate(bags), return_inverse=True)
        n = self.size[words]
        first = np.cumsum(n) - n
        return np.repeat(self.start[words] - first, n) + np.arange(n.sum()), n, first, at, np.array([len(b) for b in bags])


def _step(model: Model, adam: _Adam, corpus: _Corpus, bags: list[np.ndarray], y: np.ndarray) -> None:
    pos, n, first, at, lengths = corpus.batch(bags)
    buckets = corpus.flat[pos]
    words = np.add.reduceat(model.embedding[buckets], first) / n[:, None]
    starts = np.cumsum(lengths) - lengths
    mean = np.add.reduceat(words[at], starts) / lengths[:, None]
    z = mean @ model.weight + model.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    g = p / len(y)
    back = (g @ model.weight.T) / lengths[:, None]
    per_word, per_bucket = np.repeat(back, lengths, axis=0), np.zeros_like(model.embedding)
    for k in range(back.shape[1]):
        gw = np.bincount(at, weights=per_word[:, k], minlength=len(n)) / n
        per_bucket[:, k] = np.bincount(buckets, weights=np.repeat(gw, n), minlength=len(model.embedding))
    adam.steps += 1
    adam.step("weight", model.weight, (mean.T @ g).astype(np.float32))
    adam.step("bias", model.bias, g.sum(axis=0).astype(np.float32))
    adam.step("embedding", model.embedding, per_bucket)
    model.embedding *= DECAY


def _worst(scores: np.ndarray, window: int) -> tuple[int, float]:
    """Start and mean of the highest window of a text's word scores; a shorter text is one window."""
    if len(scores) <= window:
        return 0, float(scores.mean())
    total = np.concatenate(([0.0], np.cumsum(scores)))
    means = (total[window:] - total[:-window]) / window
    i = int(means.argmax())
    return i, float(means[i])


def train(texts: list[bytes], labels: list[int], window: int = WINDOW, epochs: tuple[int, int] = (2, 4), rate: float = 0.02, seed: int = 7) -> Model:
    """Fits embeddings and softmax: first on whole texts, then on each text's highest-scoring window under the model so far.

    With no texts, or one label only, the model says 0 for every text, or that label.
    """
    rng = np.random.default_rng(seed)
    model = Model((rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32), (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32), np.zeros(2, dtype=np.float32))
    y = np.asarray(labels, dtype=np.int64)
    if len(set(y.tolist())) < 2:
        model.embedding[:] = 0
        model.bias[:] = (0, 20) if y.any() else (20, 0)
        return model
    corpus, adam = _Corpus(texts), _Adam(rate)
    again = max(1, STEPS // (sum(epochs) * -(-len(y) // 64)))
    epochs = (epochs[0] * again, epochs[1] * again)
    for epoch in range(sum(epochs)):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            bags = [corpus.docs[i] for i in part]
            if epoch >= epochs[0]:
                logits = model.word_logits()
                pos, n, first, at, lengths = corpus.batch(bags)
                scores = (np.add.reduceat(logits[corpus.flat[pos]], first) / n)[at]
                ends = np.cumsum(lengths)
                bags = [b[i : i + window] for b, s, e in zip(bags, ends - lengths, ends) for i in [_worst(scores[s:e], window)[0]]]
            _step(model, adam, corpus, bags, y[part])
    return model


class _WordScores(dict):
    """Words to the mean logit of their subwords; words seen are kept up to a bound."""

    def __init__(self, logits: np.ndarray, most: int = 200_000):
        super().__init__()
        self._logits, self._most = logits, most

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self) >= self._most:
            self.clear()
        new = list(set().union(*texts) - self.keys())
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            buckets, size = subwords(part)
            self.update(zip(part, (np.add.reduceat(self._logits[buckets], np.cumsum(size) - size) / size).tolist()))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: bool = False) -> DataFrame:
    """(id, score) of every whole text, or with ``keep`` all columns and, last, ``toxic_score`` under a name that is free; null and empty texts score as a bag of one empty word.

    The model, of fixed size, travels with the task.
    """
    logits, base = model.word_logits().astype(np.float32), model.base
    columns = docs.columns if keep else [id_col, text_col]
    at = columns.index(text_col)
    out, name = [c for c in columns if keep or c == id_col], "toxic_score" if keep else "score"
    while name.lower() in (c.lower() for c in out):
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordScores(logits)
        for batch in slices(batches):
            z = []
            texts = [text.split() or [b""] for text in text_rows(batch, at)]
            known.learn(texts)
            for words in texts:
                s = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
                z.append(_worst(s, window)[1])
            p = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64) + base, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in out] + [pa.array(p, pa.float64())], names=[*out, name])

    schema = docs.select(*out).withColumn(name, F.lit(0.0)).schema
    return docs.select(*columns).mapInArrow(frugal(run), schema)


def fitted(docs: DataFrame, labels: DataFrame, held_out: Column, sample: tuple[int, int] = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Trains on a bounded sample of the labelled rows that are not held out.

    ``held_out`` is a condition on doc_id.  Labels that are null, neither 0 nor
    1, or of no document teach nothing; a document labelled twice is there
    twice.  Ids are drawn first, by hash, so only the texts drawn are moved.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out)
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    draw = lambda label, n: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    drawn = draw(1, sample[0]).unionByName(draw(0, sample[1]))
    # At most sum(sample) short rows.
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    by_hash = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = texts.select("doc_id", "toxic", F.length("text").alias("n")).withColumn("sum", F.sum("n").over(by_hash)).where(F.col("sum") <= chars).select("doc_id").distinct()
    rows = texts.join(F.broadcast(kept), "doc_id").select("doc_id", "toxic", F.col("text").cast("binary").alias("text")).toPandas()
    rows = rows.sort_values(["doc_id", "toxic"], kind="stable")
    examples, answers = [bytes(x) for x in rows["text"]], rows["toxic"].tolist()
    del rows
    return train(examples, answers)


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """True where the CRC-32 of the id as text leaves no remainder; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; rows with a null id count as not held out and teach nothing."""
    model = fitted(docs, labels, fold())
    return scored(docs, model).select("doc_id", fold().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
