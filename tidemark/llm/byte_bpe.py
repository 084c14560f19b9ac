"""Byte-level BPE by merge replay: an inverted index from token pairs to places applies merges in rank order over many words at once."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, frugal, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text whose words are merged together: about what a task reads.
WINDOW = 24_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Up to so many places of a merge go one by one, more at once.
_FEW = 24


class Merges:
    """The ranks as merges of two tokens, and their replay over a list of words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {rank: token for token, rank in ranks.items()}
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._shift = max(ranks.values()).bit_length()
        #: (left id << shift | right id) -> id of the merged token; any two tokens whose bytes joined are a token may merge.
        self._merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self._merged[left << self._shift | right] = rank
        keys = np.fromiter(self._merged, dtype=np.int64, count=len(self._merged))
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.fromiter(self._merged.values(), dtype=np.int64, count=len(keys))[order]
        #: Tokens that can be part of one of lower rank: their merges may call for an earlier one.
        self._early = {part for key, rank in self._merged.items() for part in (key >> self._shift, key & (1 << self._shift) - 1) if rank < part}

    def _lookup(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The ranks of pairs, -1 for those that do not merge or have a gap."""
        keys = np.left_shift(left, self._shift, dtype=np.int64) | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has, as if each were merged alone: the lowest rank first, the leftmost pair of it first.

        All words lie in one row of places, a gap between them.  The inverted
        index holds, for each merge, the places where its pair begins.  Ranks
        come in ascending order, each over all its places from left to right;
        a merge touches its two neighbours only, and the pairs that it makes go
        to the index under their own rank.  If one of these ranks lower than
        the merge at hand, the rest of its places wait until that is done, so
        each word's merges keep their own order.
        """
        length = np.array([len(word) for word in words], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), length)
        size = int(length.sum()) + len(words) + 1
        ids, words_at = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        place = np.arange(len(owner)) + owner + 1
        words_at[place] = owner
        ids[place] = self._byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        index: dict[int, list[int]] = defaultdict(list)
        rank = self._lookup(ids[:-1], ids[1:]) if size > 1 else np.zeros(0, np.int64)
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cuts) if len(at) else ():
            index[int(rank[part[0]])] = part.tolist()
        ranks = list(index)
        heapq.heapify(ranks)
        views = memoryview(ids), memoryview(after), memoryview(before)
        while ranks:
            rank = heapq.heappop(ranks)
            places = sorted(set(index.pop(rank)))
            if len(places) > _FEW:
                made = self._at_once(rank, np.array(places), ids, after, before, words_at)
            else:
                made = self._one_by_one(rank, places, *views)
            for at, of in made:
                if of not in index:
                    heapq.heappush(ranks, of)
                index[of].append(at)
        kept = ids[place] >= 0
        return ids[place[kept]], np.bincount(owner[kept], minlength=len(words))

    def _one_by_one(self, rank: int, places: list[int], ids: memoryview, after: memoryview, before: memoryview) -> list[tuple[int, int]]:
        """Merges a rank's places in turn; returns the pairs that this makes as (place, rank), and the places that must wait."""
        shift, merged, made = self._shift, self._merged.get, []
        for done, at in enumerate(places, 1):
            left, right = ids[at], after[at]
            if left < 0 or ids[right] < 0 or merged(left << shift | ids[right]) != rank:
                continue
            ids[at], ids[right] = rank, -2
            after[at] = right = after[right]
            before[right] = at
            lower = False
            if (x := ids[right]) >= 0 and (of := merged(rank << shift | x)) is not None:
                made.append((at, of))
                lower = of < rank
            if (x := ids[left := before[at]]) >= 0 and (of := merged(x << shift | rank)) is not None:
                made.append((left, of))
                lower = lower or of < rank
            if lower:
                return made + [(p, rank) for p in places[done:]]
        return made

    def _at_once(self, rank: int, places: np.ndarray, ids: np.ndarray, after: np.ndarray, before: np.ndarray, words_at: np.ndarray) -> Iterator[tuple[int, int]]:
        """The same for many places; of a token that can be part of one of lower rank, only each word's first goes and the others wait."""
        right = after[places]
        good = self._lookup(ids[places], ids[right]) == rank
        places, right = places[good], right[good]
        if not len(places):
            return iter(())
        wait = places[:0]
        if rank in self._early:
            word = words_at[places]
            first = np.concatenate(([True], word[1:] != word[:-1]))
            wait, places, right = places[~first], places[first], right[first]
        chained = np.concatenate(([False], right[:-1] == places[1:]))
        if chained.any():  # a place that the one before it takes is gone: every other one of a chain
            n = np.arange(len(places))
            keep = (n - np.maximum.accumulate(np.where(chained, 0, n))) % 2 == 0
            places, right = places[keep], right[keep]
        ids[places], ids[right] = rank, -2
        right = after[right]
        after[places], before[right] = right, places
        left = before[places]
        at, of = np.concatenate((places, left, wait)), np.concatenate((self._lookup(rank, ids[right]), self._lookup(ids[left], rank), np.full(len(wait), rank)))
        made = of >= 0
        return zip(at[made].tolist(), of[made].tolist())


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that ``which`` names, in a row."""
    n = length[which]
    end = np.cumsum(n)
    return flat[np.repeat(start[which] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


class _Strings:
    """Byte strings by id, joined without a Python object for each."""

    def __init__(self, of: dict[int, bytes]):
        self._length = np.full(max(of) + 1, -1, dtype=np.int64)
        self._length[list(of)] = [len(x) for x in of.values()]
        self._start = np.zeros(len(self._length), dtype=np.int64)
        size = np.array([len(x) for x in of.values()])
        self._start[list(of)] = np.cumsum(size) - size
        self._flat = np.frombuffer(b"".join(of.values()), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._length) or self._length[ids].min() < 0):
            raise ValueError("an id that is no token")
        return _gathered(self._flat, self._start, self._length, ids).tobytes()


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    """Read once in a worker."""
    return Merges(read_ranks(path))


class Codec:
    """Texts to ids and back."""

    def __init__(self, path: str, pattern: str):
        import regex

        self._merges = _merges(path)
        self._words = regex.compile(pattern).findall
        self._tokens = _Strings(self._merges.token)
        self._decimals = _Strings({rank: b"%d " % rank for rank in self._merges.token})

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text; the distinct words of all are merged together."""
        number: dict[str, int] = defaultdict(lambda: len(number))
        split = [array("I", map(number.__getitem__, self._words(text))) for text in texts]
        ids, length = self._merges.replay([word.encode("utf-8", "surrogatepass") for word in number])
        start = np.cumsum(length) - length
        for words in split:
            yield _gathered(ids, start, length, np.frombuffer(words, dtype=np.uintc))

    def decode(self, ids: np.ndarray) -> bytes:
        return self._tokens.joined(ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimals, a space between each."""
        return self._decimals.joined(ids)[:-1]


def _windows(batches: Batches, most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of as many rows as hold about ``most`` characters; null is empty."""
    keys, texts, size = [], [], 0
    for batch in slices(batches, 64):
        keys.append(batch.column(0))
        part = ["" if x is None else x for x in batch.column(1).to_pylist()]
        texts += part
        size += sum(map(len, part))
        if size >= most:
            yield pa.concat_arrays(keys), texts
            keys, texts, size = [], [], 0
    if keys:
        yield pa.concat_arrays(keys), texts


def _encoder(path: str, pattern: str, columns: Callable[[Codec, np.ndarray], tuple], names: list[str], kinds: list[pa.DataType], window: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        codec = Codec(path, pattern)
        for keys, texts in _windows(batches, window):
            found = codec.encode(texts)
            for lo in range(0, len(texts), 256):
                rows = [columns(codec, ids) for ids in islice(found, 256)]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, 256), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=["doc_id", *names])

    return frugal(run)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), f"doc_id {docs.schema[id_col].dataType.simpleString()}"


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, one row per row; a null or empty text has no ids.

    ``pattern`` cuts a text into words, each merged by itself; special tokens
    are ordinary text.  Tasks need nothing of each other: a task takes the
    texts of a window at a time, and replays the merges over all their distinct
    words at once.
    """
    texts, key = _texts(docs, id_col, text_col)
    return texts.mapInArrow(_encoder(path, pattern, lambda codec, ids: (ids.astype(np.int32),), ["ids"], [pa.list_(pa.int32())], window), f"{key}, ids array<int>")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) of each array of ids; null is empty, an id that is no token an error."""

    def run(batches: Batches) -> Batches:
        tokens = _Strings(_merges(path).token)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens.joined(np.array(ids or (), dtype=np.int64)) for ids in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(frugal(run), f"doc_id {rows.schema[id_col].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, and both hashed in the task that holds them.

    One row per row, repeated and null ids too; a null or empty text has no
    tokens and the digests of nothing.
    """

    def columns(codec: Codec, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(codec.decimals(ids)).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    texts, key = _texts(docs, id_col, text_col)
    return texts.mapInArrow(_encoder(path, pattern, columns, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], window), f"{key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
