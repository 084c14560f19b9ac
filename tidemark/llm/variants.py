"""Spelling variants: words one edit apart by a bit-sliced position index, and the common form that each leads to."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, frugal, slices, stage

#: Words of one block of a bucket, and distinct words that a task counts before it sends them on.
BLOCK, FLUSH = 16_384, 300_000
#: Words of Latin letters, after A-Z are lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 97) -> DataFrame:
    """(word, n): how often each run of Latin letters occurs in all whole texts; only A-Z are lower-cased.

    Where ``slip`` divides the unsigned crc32 h of ``<id>:<run>``, the run's
    code point h % length is left out before it is counted; ``slip=0`` leaves
    runs as they are, and so does a null id.  A null text has no words; a run
    of one letter that slips is no word.
    """

    def run(batches: Batches) -> Batches:
        held: Counter[str] = Counter()
        for batch in slices(batches, 64):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                words = Counter(_RUN.findall(text.lower().decode("utf-8", "replace")))
                if slip and key is not None:
                    start, moved = zlib.crc32(f"{key}:".encode()), []
                    for word in words:
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            moved.append((word, h % len(word)))
                    counts = [words.pop(word) for word, _ in moved]
                    for (word, at), n in zip(moved, counts):
                        held[word[:at] + word[at + 1 :]] += n
                held.update(words)
            if len(held) >= FLUSH:
                yield _counted(held)
                held.clear()
        if held:
            yield _counted(held)

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(frugal(run), "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


class PositionIndex:
    """A vocabulary as one bit set per (position, letter), and those of its words that are a given word's neighbours."""

    def __init__(self, words: list[str]):
        self._at: list[dict[str, int]] = [{} for _ in range(max(map(len, words), default=0) + 1)]
        self._length: dict[int, int] = defaultdict(int)
        for i, word in enumerate(words):
            bit = 1 << i
            self._length[len(word)] |= bit
            for at, letter in zip(self._at, word):
                at[letter] = at.get(letter, 0) | bit
        self._all = (1 << len(words)) - 1

    def near(self, word: str) -> int:
        """The words exactly one insertion, deletion or replacement away, as a bit set.

        ``same`` are the words that agree with all letters so far; the others
        have one error behind them, and go on one place later where the word of
        the vocabulary has a letter more, one earlier where it has one less.
        """
        same, replaced, longer, shorter = self._all, 0, 0, 0
        last = len(self._at) - 1
        for i, letter in enumerate(word):
            here = self._at[i].get(letter, 0) if i <= last else 0
            after = self._at[i + 1].get(letter, 0) if i < last else 0
            before = self._at[i - 1].get(letter, 0) if 0 < i <= last + 1 else 0
            # An extra letter of the vocabulary's word stands before this one, or this letter is the extra one.
            replaced, longer, shorter, same = (replaced & here) | (same & ~here), (longer | same) & after, (shorter & before) | same, same & here
            if not (replaced or longer or shorter):
                return 0
        longer |= same  # the extra letter is the last
        n, length = len(word), self._length.get
        return (replaced & length(n, 0)) | (longer & length(n + 1, 0)) | (shorter & length(n - 1, 0))


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _matcher(batches: Batches) -> Batches:
    """Rows (bucket, qb, vb, m, front, part, word, n, asks, told), those of a block pair together: the neighbours of each word that asks among those told."""
    out: list[list] = [[], [], [], []]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])
        for c in out:
            c.clear()
        return batch

    for (_, _, _, m, front, part), group in groupby(rows(), key=lambda r: r[:6]):
        members = list(group)
        told = [(word, n) for *_, word, n, _, is_told in members if is_told]
        if not told or len(members) == 1:
            continue
        # What the bucket shares needs no comparing: the rest goes on from it, read backwards where the ends are shared.
        known, half = len(part), m // 2
        rest = (lambda w: w[known:]) if front else (lambda w: w[: len(w) - known][::-1])
        index = PositionIndex([rest(word) for word, _ in told])
        for *_, word, n, asks, _ in members:
            if not asks:
                continue
            best: tuple[int, str] | None = None
            count = 0
            for i in _bits(index.near(rest(word))):
                other, k = told[i]
                # A pair meets in the buckets of its shorter length, at the back only if not in front.
                if min(len(other), len(word)) == m and (front or other[:half] != word[:half]):
                    count += 1
                    if best is None or (-k, other) < best:
                        best = (-k, other)
            if best:
                for column, value in zip(out, (word, count, -best[0], best[1])):
                    column.append(value)
        if len(out[0]) >= 10_000:
            yield flushed()
    if out[0]:
        yield flushed()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, nearest): for each word with neighbours their number, and the one of largest n, ties to the smaller in code-point order.

    ``words`` is (word, n) with distinct words.  Two words one edit apart, the
    shorter of m letters, share their first m // 2 letters or their last
    m - m // 2: words meet in buckets of these, and a bucket of more than
    ``block`` words in pairs of blocks, each compared by bits.  Only counts
    and the best neighbour leave a task, never pairs.
    """
    length = F.length("word")
    keys = []
    for less in (0, 1):
        m = length - less
        half = F.floor(m / 2).cast("int")
        for front in (True, False):
            part = F.substring("word", F.lit(1), half) if front else F.substring("word", length - (m - half) + 1, m - half)
            keys.append(F.struct(m.alias("m"), F.lit(front).alias("front"), part.alias("part")))
    bucket = ["m", "front", "part"]
    rows = stage(words.where("word <> ''").select("word", "n", F.explode(F.array(*keys)).alias("k")).where("k.m > 0").select("k.*", "word", "n"), "keys")
    size = rows.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    size = stage(size.select(*bucket, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "buckets")
    met = rows.join(size, bucket).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asked = F.transform(every, lambda x: F.struct(F.col("mine").alias("qb"), x.alias("vb"), F.lit(True).alias("asks"), (x == F.col("mine")).alias("told")))
    told = F.transform(F.filter(every, lambda x: x != F.col("mine")), lambda x: F.struct(x.alias("qb"), F.col("mine").alias("vb"), F.lit(False).alias("asks"), F.lit(True).alias("told")))
    dealt = met.select(F.xxhash64(*bucket).alias("bucket"), F.explode(F.concat(asked, told)).alias("p"), *bucket, "word", "n").select("bucket", "p.qb", "p.vb", *bucket, "word", "n", "p.asks", "p.told")
    dealt = dealt.repartition("bucket", "qb", "vb").sortWithinPartitions("bucket", "qb", "vb", *bucket)
    found = dealt.mapInArrow(frugal(_matcher), "word string, near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("below"), "best")).alias("b")).select("word", "n_near", (-F.col("b.below")).alias("near_n"), F.col("b.best").alias("nearest"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer jumping; as a form is always commoner than its word, no chain closes.

    The rounds grow with the logarithm of the longest chain.
    """
    jump = stage(forms.select("word", F.col("form").alias("root")), "jump")
    while True:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = stage(jump.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jump")
        if jump.where("moved").isEmpty():
            return jump.select("word", "root")
        jump = jump.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_n: int = 3, ratio: int = 2, slip: int = 97, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least_letters`` letters and ``least_n`` occurrences in all texts.

    ``form`` is the nearest word of largest n, if that is ``ratio`` (2 or more)
    times the word's own n; ``root`` ends the chain of forms.  A word without
    neighbours has n_near 0, one without form is its own root.  Null and empty
    texts have no words; no words give no rows.
    """
    words = stage(word_counts(docs, id_col, text_col, slip).where((F.length("word") >= least_letters) & (F.col("n") >= least_n)), "words")
    near = stage(words.join(near_words(words, block), "word", "left"), "near")
    has = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("nearest")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
