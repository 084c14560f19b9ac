"""Best-fit packing of documents into token sequences, improved by a swap-based local search."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, slices, stage, text_rows

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
#: Sequences that one task packs at once.
BLOCK_BINS = 512
#: Sequences filled to less than this share go into the next round, with those of other blocks.
LOOSE = 0.97


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _WordIds(dict):
    """White-space separated words to their token ids as bytes; words seen are kept up to a bound.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its words in order.  A word of Latin letters is one unit to it:
    such words skip the pattern search and go to the merges at once.  Other
    ASCII words without an apostrophe are runs of letters, single digits and runs
    of the rest, and a final ``,`` or the like after a letter is one by itself:
    these are looked up apart.
    """

    _LETTERS = _byte_letters()
    _MARKS = frozenset(b",.;:!?")
    _UNITS = staticmethod(re.compile(rb"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+").findall)

    def __init__(self, path: str, most: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(path)
        self._encode, self._merge = whole.encode, whole.model.tokenize
        self._half, self._older = most // 2, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(self) >= self._half:  # words in use come back from the older half
            self._older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return array("I", [x.id for x in self._merge(word.decode().lower())]).tobytes()
        if word.isascii() and b"'" not in word and b"<|" not in word and len(units := self._UNITS(word)) > 1:
            return b"".join(map(self.__getitem__, units))
        text = word.decode("utf-8", "replace")
        if len(word) > 1 and word[-1] in self._MARKS and text[-2].isalpha() and text[-2] < "\u0180" and text[-2] != "\u0130":
            return self[word[:-1]] + self[word[-1:]]
        if text.isalpha() and max(text) < "\u0180" and "\u0130" not in text:  # such letters are in normal form
            return array("I", [x.id for x in self._merge(text.lower().encode().decode("latin-1").translate(self._LETTERS))]).tobytes()
        return array("I", self._encode(text, add_special_tokens=False).ids).tobytes()

    def stream(self, text: bytes) -> bytes:
        """The ids of a text.  A-Z fold first, where that can't make one of the tokenizer's own marks."""
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (id, piece, start, length, ids_crc32[, ids]).

    A document is the ids of its text followed by ``end_id``; only longer ones
    are cut.  A null or empty text is that one id.  Repeated rows are documents
    of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordIds(tokenizer_path)
        for batch in slices(batches):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(text_rows(batch)):
                stream = known.stream(text) + end
                for k, i in enumerate(range(0, len(stream), 4 * capacity)):
                    part = stream[i : i + 4 * capacity]
                    at.append(row)
                    piece.append(k)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest item first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: a bin with a gap of g is there
    for item in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[item])
        fits = open_gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if gap > n:
            by_gap[gap - n].append(b)
            open_gaps |= 1 << (gap - n)
    return bins


def _sums(sizes: Counter) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sizes of a bin, and the sums of two items as (sum, one, other)."""
    one = np.array(sorted(sizes), dtype=np.int64)
    i, j = np.triu_indices(len(one))
    apart = (i != j) | (np.array([sizes[int(x)] for x in one])[i] > 1)
    return one, np.stack([one[i] + one[j], one[i], one[j]])[:, apart]


def _exchange(src: tuple[np.ndarray, np.ndarray], dst: tuple[np.ndarray, np.ndarray], gap: int) -> tuple[int, tuple, tuple] | None:
    """What to give and take so that ``dst`` gains most without passing its gap: one or two sizes for none, one or two.  Both bins are given by their ``_sums``."""
    (xs, x2), (ys, y2) = src, dst
    single = np.concatenate(([0], ys))
    best: tuple[int, tuple, tuple] | None = None
    for gives, takes, kind in ((xs, single, 0), (x2[0], ys, 1), (xs, y2[0], 2)):
        if not len(gives) or not len(takes):
            continue
        # the most that fits: for each take, the largest give up to take + gap
        order = np.argsort(gives, kind="stable")
        at = np.searchsorted(gives[order], takes + gap, side="right") - 1
        gain = np.where(at >= 0, gives[order][np.maximum(at, 0)] - takes, 0)
        j = int(gain.argmax())
        if gain[j] > (best[0] if best else 0):
            i = int(order[at[j]])
            give = (int(x2[1, i]), int(x2[2, i])) if kind == 1 else (int(xs[i]),)
            take = (int(y2[1, j]), int(y2[2, j])) if kind == 2 else (int(single[j]),) * bool(single[j]) if kind == 0 else (int(ys[j]),)
            best = (int(gain[j]), give, take)
            if best[0] == gap:
                break
    return best


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty underfull bins into others by moves, one-for-one, two-for-one and one-for-two exchanges.

    Every exchange takes from the emptier bin to the fuller, so the sum of
    squared fills, a whole number with a bound, grows by each: the search ends.
    The emptiest bin that was not tried since the last change is tried next,
    against the others from the fullest down, and a bin that becomes empty
    goes.  It stops when no fewer bins are possible or no bin gains; pairs
    that did not gain are asked again only after one of them changed.
    """
    least = -(-int(sizes.sum()) // capacity)
    held = [Counter(sizes[b].tolist()) for b in bins]
    items: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable").tolist():
        items.setdefault(int(sizes[i]), []).append(i)
    fill = [sum(n * c for n, c in h.items()) for h in held]
    sums = [None if f == capacity else _sums(h) for h, f in zip(held, fill)]
    version, failed = [0] * len(held), {}
    live = {i for i, h in enumerate(held) if h}
    tried: set[int] = set()
    while len(live) > max(1, least):
        s = min((i for i in live - tried if fill[i] < capacity), key=lambda i: (fill[i], i), default=None)
        if s is None:
            break
        tried.add(s)
        for t in sorted((i for i in live if i != s and fill[s] <= fill[i] < capacity), key=lambda i: (-fill[i], i)):
            while held[s] and fill[s] <= fill[t] < capacity and failed.get((s, t)) != (version[s], version[t]):
                x = _exchange(sums[s], sums[t], capacity - fill[t])
                if not x:
                    failed[s, t] = (version[s], version[t])
                    break
                gain, give, take = x
                for n in give:
                    held[s][n] -= 1
                    held[t][n] += 1
                for n in take:
                    held[t][n] -= 1
                    held[s][n] += 1
                for i in (s, t):
                    held[i] = +held[i]
                    sums[i] = _sums(held[i]) if held[i] else None
                    version[i] += 1
                fill[s], fill[t] = fill[s] - gain, fill[t] + gain
                tried.clear()
            if not held[s]:
                live.discard(s)
                break
    # Items of one size are alike: each bin takes as many as it holds.
    return [[items[n].pop() for n, c in sorted(h.items(), reverse=True) for _ in range(c)] for h in sorted((h for h in held if h), key=lambda h: sum(n * c for n, c in h.items()) < capacity)]


def _block_packer(capacity: int, base: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_block").sort_values([c for c in ("length", "doc_id", "piece") if c in rows.columns], kind="stable", ignore_index=True)
        sizes = rows["length"].to_numpy(dtype=np.int64)
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        seq, offset, fill = (np.zeros(len(rows), dtype=np.int64) for _ in range(3))
        for b, items in enumerate(bins):
            n = sizes[items]
            seq[items] = base + (int(key[0]) << 20) + b
            offset[items] = np.cumsum(n) - n
            fill[items] = n.sum()
        return rows.assign(sequence_id=seq, offset=offset, fill=fill)

    return pack


def packed(pieces: DataFrame, capacity: int = CAPACITY, block_bins: int = BLOCK_BINS, loose: float = LOOSE) -> DataFrame:
    """Pieces with sequence_id and offset added; ``length`` from 0 to ``capacity`` is the size, other columns stay.

    Pieces are dealt by hash into blocks of about ``block_bins`` sequences; each
    is packed by best fit and the local search.  What the blocks leave underfull
    is dealt anew into fewer blocks, round by round, so no task ever holds more
    than a block and the rounds grow with the logarithm of the input.  Places
    are per row, so repeated rows and ids are packed like any other; no rows
    give no sequences.
    """
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, fill long"
    rest, done, tier, before = pieces, None, 0, None
    while True:
        total = rest.agg(F.sum("length")).first()[0] or 0
        blocks = max(1, -(-int(total) // (capacity * block_bins)))
        keys = [c for c in columns if c != "ids"]
        placed = rest.withColumn("_block", F.pmod(F.xxhash64(*keys, F.lit(tier)), F.lit(blocks))).groupBy("_block").applyInPandas(_block_packer(capacity, tier << 56), schema)
        placed = stage(placed, f"packed_{tier}")
        if blocks == 1 or (before is not None and blocks >= before):
            done = placed if done is None else done.unionByName(placed)
            return done.select(*columns, "sequence_id", "offset")
        full = placed.where(F.col("fill") >= capacity * loose)
        done = full if done is None else done.unionByName(full)
        rest, tier, before = placed.where(F.col("fill") < capacity * loose).select(*columns), tier + 1, blocks


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Documents to placed pieces: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    ``keep_ids`` adds each piece's ids, from which a sequence is the pieces of
    its sequence_id by offset.
    """
    return packed(stage(tokenized(docs, tokenizer_path, id_col, text_col, capacity, keep_ids=keep_ids), "pieces"), capacity)
