"""Language-model scores: an interpolated modified Kneser-Ney bigram model in sorted, memory-mapped hash arrays."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, mixed, shared_folder, slices, text_rows

_U = np.uint64
#: Words are 56-bit hashes; these two stand for the start and the end of a text.
START, END = 0, 1
#: Text bytes for each shard of the model, and tokens that a task counts before it sends them on.
SHARD_BYTES, FLUSH = 12_000_000, 1_200_000


class _Words(dict):
    """Words to 56-bit hashes; words seen are kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = (xxhash.xxh3_64_intdigest(word) >> 8) | 2
        return h

    def tokens(self, text: bytes) -> np.ndarray:
        """START, the words, END."""
        words = text.lower().split()
        out = np.empty(len(words) + 2, dtype=_U)
        out[0], out[-1] = START, END
        out[1:-1] = np.fromiter(map(self.__getitem__, words), dtype=_U, count=len(words))
        return out


def _pair(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) ^ w)


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def _word_bits(bits: int) -> int:
    """Words are far fewer than pairs of them, so an eighth of the shards, 8 at least, holds them, and a pair's shard addresses fewer."""
    return min(bits, max(3, bits - 3))


def _seven(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _from_seven(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    return out.view("<u8").reshape(-1).astype(_U)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, dtype=np.int64)


# --- counting ---------------------------------------------------------------


def _counter(bits: int):
    """A task's bigrams, summed, as one packed row per shard: contexts, how many bigrams each has, words, counts."""

    def emit(texts: list[np.ndarray]) -> pa.RecordBatch:
        a, w = np.concatenate([t[:-1] for t in texts]), np.concatenate([t[1:] for t in texts])
        p = _pair(a, w)
        order = np.argsort(p)
        p = p[order]
        first = _runs(p)
        count = np.diff(np.append(first, len(p))).astype("<u4")
        a, w, shard = a[order[first]], w[order[first]], _shard(p[first], bits)
        cuts = np.append(_runs(shard), len(shard))
        rows: list[list] = [[], [], [], [], []]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            by_a = lo + np.argsort(a[lo:hi], kind="stable")
            runs = _runs(a[by_a])
            for column, x in zip(rows, (int(shard[lo]), _seven(a[by_a][runs]), np.diff(np.append(runs, hi - lo)).astype("<u4").tobytes(), _seven(w[by_a]), count[by_a].tobytes())):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["shard", "contexts", "runs", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _Words(), [], 0
        for batch in slices(batches):
            for text in text_rows(batch, 0):
                held.append(known.tokens(text))
                size += len(held[-1])
                if size >= FLUSH:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return run


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, complete or absent: written aside and renamed, so a repeated task does no harm."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    where.create_dir(path, recursive=True)
    aside = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(aside) as out:
        for x in arrays.values():
            out.write(np.array([len(x)], dtype="<u8").tobytes())
            out.write(np.ascontiguousarray(x).tobytes())
            out.write(b"\0" * (-x.nbytes % 8))
    where.move(aside, f"{path}/{name}")


def _bigram_merger(folder: str, bits: int):
    """A shard's counts summed and written; what its contexts and words get from it goes on, packed by their own shard."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([np.repeat(_from_seven(c), np.frombuffer(r, "<u4")) for c, r in zip(rows["contexts"], rows["runs"])])
        w = np.concatenate([_from_seven(x) for x in rows["words"]])
        c = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]]).astype(np.int64)
        p = _pair(a, w)
        order = np.argsort(p)
        p = p[order]
        first = _runs(p)
        a, w, c, p = a[order[first]], w[order[first]], np.add.reduceat(c[order], first), p[first]
        depth = max(1, int(math.log2(max(2, len(p)) / 16)) if len(p) > 32 else 1)
        rest = p << _U(bits)
        bucket = (rest >> _U(64 - depth)).astype(np.int64)
        large = np.flatnonzero(c > 255)
        _write(folder, f"bigrams-{int(key[0])}", {
            "depth": np.array([depth], dtype="<u8"), "starts": np.searchsorted(bucket, np.arange((1 << depth) + 1)).astype("<u4"),
            "keys": ((rest << _U(depth)) >> _U(32)).astype("<u4"), "counts": np.minimum(c, 255).astype("u1"), "large": large.astype("<u8"), "large_counts": c[large].astype("<u8")})
        out = []
        stats = np.array([(c == i).sum() for i in (1, 2, 3, 4)] + [len(c)], dtype="<i8").tobytes()
        for what, of in (("context", a), ("word", w)):
            by = np.argsort(of, kind="stable")
            runs = _runs(of[by])
            of, cc = of[by][runs], c[by]
            home = _shard(mixed(of), _word_bits(bits))
            if what == "context":
                columns = [np.add.reduceat(x.astype(np.int64), runs) for x in (cc == 1, cc == 2, cc > 2)]
            else:
                columns = [np.diff(np.append(runs, len(cc))), np.add.reduceat(cc, runs)]
            for u in np.unique(home):
                at = home == u
                out.append((int(u), what == "context", _seven(of[at]), b"".join(x[at].astype("<i8").tobytes() for x in columns), stats))
                stats = None
        return pd.DataFrame(out, columns=["shard", "context", "words", "numbers", "stats"])

    return run


def _word_merger(folder: str):
    """A shard's words with their counts, the contexts they follow, and their own successors by count; returns sums."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        def summed(part: pd.DataFrame, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
            if not len(part):
                return np.zeros(0, dtype=_U), [np.zeros(0, dtype=np.int64)] * columns
            h = np.concatenate([_from_seven(x) for x in part["words"]])
            n = np.concatenate([np.frombuffer(x, "<i8").reshape(columns, -1) for x in part["numbers"]], axis=1)
            order = np.argsort(h, kind="stable")
            first = _runs(h[order])
            return h[order][first], [np.add.reduceat(x[order], first) for x in n]

        contexts, (n1, n2, n3) = summed(rows[rows["context"]], 3)
        words, (follows, count) = summed(rows[~rows["context"]], 2)
        both = np.union1d(contexts, words)
        spread = lambda keys, x: np.bincount(np.searchsorted(both, keys), weights=x, minlength=len(both)).astype(np.int64)
        table = [spread(words, count), spread(words, follows), *[spread(contexts, x) for x in (n1, n2, n3)]]
        wide = any(x.max(initial=0) >= 2**32 for x in table)
        _write(folder, f"words-{int(key[0])}", {"wide": np.array([wide], dtype="<u8"), "words": both.astype("<u8"), **{str(i): x.astype("<u8" if wide else "<u4") for i, x in enumerate(table)}})
        known = sum((np.frombuffer(x, "<i8") for x in rows["stats"] if x is not None), np.zeros(5, dtype=np.int64))
        return pd.DataFrame([[*known.tolist(), *[int((follows == i).sum()) for i in (1, 2, 3, 4)], len(words), int(count.sum()), int(count[words == END].sum())]], columns=_SUMS)

    return run


_SUMS = ["b1", "b2", "b3", "b4", "bigrams", "u1", "u2", "u3", "u4", "words", "tokens", "texts"]


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, how many bits name a shard, and the corpus sums."""

    folder: str
    bits: int
    sums: dict[str, int]


def train(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts all texts (null: empty) and writes the model's arrays into the shared folder; one Spark job, sums alone reach the driver."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / shard_bytes))))
    folder = shared_folder(docs.sparkSession, "language_model")
    counted = texts.mapInArrow(frugal(_counter(bits)), "shard long, contexts binary, runs binary, words binary, counts binary")
    partial = counted.groupBy("shard").applyInPandas(_bigram_merger(folder, bits), "shard long, context boolean, words binary, numbers binary, stats binary")
    sums = partial.groupBy("shard").applyInPandas(_word_merger(folder), ", ".join(f"{x} long" for x in _SUMS))
    row = sums.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in _SUMS]).first()
    return Model(folder, bits, row.asDict())


# --- scoring ----------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more; where a count of counts is missing, half of the count below it stays."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.array([0.0] + [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)])


class _Arrays:
    """A worker's view of the model: files memory-mapped on first use, from the shared folder or a local copy of it."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}
        s = model.sums
        self.d2, self.d1 = discounts(s["b1"], s["b2"], s["b3"], s["b4"]), discounts(s["u1"], s["u2"], s["u3"], s["u4"])
        rest = s["words"] - s["u1"] - s["u2"]
        self.spare = (self.d1[1] * s["u1"] + self.d1[2] * s["u2"] + self.d1[3] * rest) / s["bigrams"] if s["bigrams"] else 1.0

    def _file(self, name: str, kinds: tuple[str, ...]) -> list[np.ndarray] | None:
        if name not in self.maps:
            path = f"{self.model.folder}/{name}"
            if "://" in path and not path.startswith("file:"):
                path = self._fetched(path)
            else:
                path = path.removeprefix("file://").replace("file:", "", 1)
            if path is None or not os.path.exists(path):
                self.maps[name] = None
            else:
                data, at, out = np.memmap(path, dtype=np.uint8, mode="r"), 0, []
                for kind in kinds:
                    n = int(data[at : at + 8].view("<u8")[0])
                    if kind == "n":  # a column as wide as the file's first number says
                        kind = "<u8" if out[0][0] else "<u4"
                    size = n * np.dtype(kind).itemsize
                    out.append(data[at + 8 : at + 8 + size].view(kind))
                    at += 8 + size + (-size % 8)
                self.maps[name] = out
        return self.maps[name]

    @staticmethod
    def _fetched(uri: str) -> str | None:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        if where.get_file_info(path).type == fs.FileType.NotFound:
            return None
        local = os.path.join(tempfile.gettempdir(), xxhash.xxh3_64_hexdigest(uri))
        if not os.path.exists(local):
            fs.copy_files(path, f"{local}.{os.getpid()}", source_filesystem=where, destination_filesystem=fs.LocalFileSystem())
            os.replace(f"{local}.{os.getpid()}", local)
        return local

    def words(self, h: np.ndarray) -> list[np.ndarray]:
        """count, follows, n1, n2, n3 of each word; zeros for unknown ones."""
        out = [np.zeros(len(h), dtype=np.int64) for _ in range(5)]
        home = _shard(mixed(h), _word_bits(self.model.bits))
        for u in np.unique(home):
            if (f := self._file(f"words-{u}", ("<u8", "<u8", "n", "n", "n", "n", "n"))) is None:
                continue
            at = np.flatnonzero(home == u)
            i = np.minimum(np.searchsorted(f[1], h[at]), len(f[1]) - 1)
            hit = f[1][i] == h[at]
            for o, x in zip(out, f[2:]):
                o[at[hit]] = x[i[hit]]
        return out

    def bigrams(self, p: np.ndarray) -> np.ndarray:
        """Counts of pairs by binary search inside the bucket that the leading bits name."""
        out = np.zeros(len(p), dtype=np.int64)
        home = _shard(p, self.model.bits)
        order = np.argsort(p)
        cuts = np.append(_runs(home[order]), len(p))
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            if (f := self._file(f"bigrams-{home[at[0]]}", ("<u8", "<u4", "<u4", "u1", "<u8", "<u8"))) is None:
                continue
            (depth,), starts, keys, counts, large, large_counts = f
            rest = p[at] << _U(self.model.bits)
            bucket = (rest >> _U(64 - int(depth))).astype(np.int64)
            want = ((rest << depth) >> _U(32)).astype(np.uint32)
            lo, hi = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
            end = hi.copy()
            while (lo < hi).any():
                mid = (lo + hi) // 2
                less = (keys[np.minimum(mid, len(keys) - 1)] < want) & (lo < hi)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
            i = np.minimum(lo, len(keys) - 1)
            hit = (lo < end) & (keys[i] == want)
            c = np.where(hit, counts[i], 0).astype(np.int64)
            if len(large):
                k = np.minimum(np.searchsorted(large, i), len(large) - 1)
                c = np.where(hit & (large[k] == i), large_counts[k].astype(np.int64), c)
            out[at] = c
        return out

    def scores(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known ones, the unigram base and the model's log10 probability."""
        s = self.model.sums
        distinct, back = np.unique(np.concatenate(texts), return_inverse=True)
        count, follows, n1, n2, n3 = self.words(distinct)
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size)
        every = np.concatenate(texts)
        inner = np.ones(len(every), dtype=bool)
        inner[ends - 1] = False  # contexts: all but the last token of each text
        a = np.flatnonzero(inner)
        w = a + 1
        total = np.where(distinct == START, s["texts"], count)[back[a]].astype(np.float64)
        c = self.bigrams(_pair(every[a], every[w]))
        low = (np.maximum(follows - self.d1[np.minimum(follows, 3)], 0) / max(1, s["bigrams"]) + self.spare / (s["words"] + 1))[back[w]]
        kept = (self.d2[1] * n1 + self.d2[2] * n2 + self.d2[3] * n3)[back[a]]
        seen = total > 0
        p = np.where(seen, (np.maximum(c - self.d2[np.minimum(c, 3)], 0) + kept * low) / np.maximum(total, 1), low)
        base = np.log10((count + 0.1) / (s["tokens"] + 0.1 * (s["words"] + 1)))[back[w]]
        first = np.cumsum(size - 1) - (size - 1)
        sums = lambda x: np.add.reduceat(x, first)
        return size - 1, sums((count > 0)[back[w]].astype(np.int64)), sums(base), sums(np.log10(p))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text; null and empty texts are the end token alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, arrays = _Words(), _Arrays(model)
        for batch in slices(batches):
            columns = arrays.scores([known.tokens(t) for t in text_rows(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.astype(k)) for x, k in zip(columns, ("i8", "i8", "f8", "f8"))]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(column: str = "doc_id", folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Trains on the rows not held out and scores all: one row per row; a null id is not held out; no rows give none.

    A text's perplexity is 10 ** (-score / n_tokens).
    """
    model = train(docs.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
