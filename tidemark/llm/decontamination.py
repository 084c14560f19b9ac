"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, mixed, slices, stage, text_rows

#: Words of a seed, and the share of a test's words that tiles must cover.
MIN_MATCH, COVERAGE = 5, 0.8
#: Words of benchmark text that one pass over the documents looks for.
BLOCK_WORDS = 4_000_000

#: Bytes of texts that are searched together.
CHUNK = 1 << 19

_U = np.uint64
_EDGE = b".,;:!?\"'()[]{}<>*"
#: A byte between words (0), a mark (1) or any other (2).
_KINDS = bytes(0 if c in b" \t\n\r\x0b\x0c" else 1 if c in _EDGE else 2 for c in range(256))
#: The lowest 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
_BASE = 0xD6E8FEB86659FD93


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in an array that begins and ends with False."""
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return turns[0::2].copy(), turns[1::2].copy()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in turn, and the places where each text's begin, with the end.

    Words are cut at white space, A-Z lower-cased, marks at their ends dropped;
    words of marks alone are none.  All words are cut and hashed at once: from
    their first and last eight bytes and their length, longer ones by themselves.
    """
    from xxhash import xxh3_64_intdigest

    data = b"\n" + b"\n".join(texts).lower() + b"\n" * 8
    kinds = np.frombuffer(data.translate(_KINDS), dtype=np.uint8)
    a, b = _runs(kinds != 0)
    cut = np.flatnonzero((kinds[a] == 1) | (kinds[b - 1] == 1))
    if len(cut):
        first, last = _runs(kinds == 2)
        i, j = np.searchsorted(first, a[cut]), np.searchsorted(last, b[cut], side="right")
        bare = j > i
        a[cut[bare]], b[cut[bare]] = first[i[bare]], last[j[bare] - 1]
        a, b = np.delete(a, cut[~bare]), np.delete(b, cut[~bare])
    size = b - a
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = mixed((eight[a] & _LOW[np.minimum(size, 8)]) + size.astype(_U) * _U(_BASE))
    more = np.flatnonzero(size > 8)
    h[more] = mixed(h[more] ^ eight[b[more] - 8])
    for k in more[size[more] > 16].tolist():
        h[k] = xxh3_64_intdigest(data[a[k] : b[k]])
    return h, np.searchsorted(a, np.cumsum([1, *(len(t) + 1 for t in texts)]))


def _powers(n: int, known: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next call."""
    if not known or len(known[0]) < n:
        factors = np.full((2, max(n, 1 << 16)), [[_BASE], [pow(_BASE, -1, 1 << 64)]], dtype=_U)
        factors[:, 0] = 1
        known[:] = np.cumprod(factors, axis=1, dtype=_U)
    return known[0][:n], known[1][:n]


def sums(h: np.ndarray) -> np.ndarray:
    """The rolling sum before every word and at the end."""
    return np.concatenate((np.zeros(1, dtype=_U), np.cumsum(h * _powers(len(h))[0], dtype=_U)))


def grams(rolling: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` words, whatever the width at the price of one difference of the sums."""
    n = max(len(rolling) - width, 0)
    return (rolling[width:] - rolling[:n]) * _powers(n)[1] if n else np.zeros(0, dtype=_U)


def _free_runs(marked: np.ndarray, width: int) -> np.ndarray:
    """Starts at which the next ``width`` words are all unmarked."""
    used = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(used[width:] == used[:-width]) if len(marked) >= width else np.zeros(0, dtype=np.int64)


def _shared(own: np.ndarray, other: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in runs of ``width`` that the other has too, a marked place behind each stretch, and the marks."""
    turns = np.zeros(len(own) + 1, dtype=np.int64)
    i = np.flatnonzero(np.isin(grams(sums(own), width), grams(sums(other), width)))
    turns[i] += 1
    turns[i + width] -= 1
    inside = np.cumsum(turns) > 0
    shown = inside[:-1].copy()
    shown[1:] |= inside[:-2]
    place = np.flatnonzero(shown)
    return place, ~inside[place]


def tiles(doc: np.ndarray, test: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in test, words) of non-overlapping matches, the longest first.

    Only words in runs of ``min_match`` that both have can be part of a match;
    the others are left out first.  Each round finds by Karp-Rabin the longest
    length at which unmarked runs of both agree: a length that matches implies
    all shorter ones, so it is found by bisection over hash joins.  All matches
    of that length are marked, leftmost in the test first, each compared word
    by word, and the next round looks for shorter ones.
    """
    if min(len(doc), len(test)) < min_match:
        return []
    (in_doc, at_doc), (in_test, at_test) = _shared(doc, test, min_match), _shared(test, doc, min_match)
    doc, test = doc[in_doc], test[in_test]
    doc_sums, test_sums = sums(doc), sums(test)
    most, out = min(len(doc), len(test)), []

    def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = _free_runs(at_doc, width), _free_runs(at_test, width)
        a, b = grams(doc_sums, width)[i], grams(test_sums, width)[j]
        both = np.isin(a, b)
        return i[both], a[both], j, b

    while (most := min(most, np.count_nonzero(~at_doc), np.count_nonzero(~at_test))) >= min_match:
        lo, hi = min_match - 1, most
        mid = hi
        while lo < hi:
            if len(common(mid)[0]):
                lo = mid
            else:
                hi = mid - 1
            mid = (lo + hi + 1) // 2
        if lo < min_match:
            break
        i, a, j, b = common(lo)
        places: dict[int, list[int]] = {}
        for s, h in zip(i.tolist(), a.tolist()):
            places.setdefault(h, []).append(s)
        for t, h in zip(j.tolist(), b.tolist()):
            if h not in places or at_test[t : t + lo].any():
                continue
            for s in places[h]:
                if not at_doc[s : s + lo].any() and np.array_equal(doc[s : s + lo], test[t : t + lo]):
                    at_doc[s : s + lo], at_test[t : t + lo] = True, True
                    out.append((int(in_doc[s]), int(in_test[t]), lo))
                    break
        most = lo - 1
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark in blocks of bounded size, streamed through the driver one partition at a time."""
    held, words = [], 0
    for item, text in benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        held.append((item, text.encode("utf-8", "replace")))
        words += len(text) // 4
        if words >= block_words:
            yield held
            held, words = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, covered, test_words, n_tiles, starts, lengths) of documents whose tiles cover enough of a test.

    A document meets a test only where they share a run of ``min_match`` words,
    by a search in the block's sorted runs; tests shorter than that are looked
    for as a whole.  Whole texts are read, once for each block of benchmark
    text.  Null, empty and wordless texts and tests match nothing; repeated
    rows and tests, and those with a null id, give rows of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, covered long, test_words long, n_tiles long, starts array<int>, lengths array<int>"
    table = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out: DataFrame | None = None
    for block in _blocks(benchmark, block_words):
        found = table.mapInArrow(frugal(_tiler(block, min_match, coverage)), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in pieces of about ``size`` bytes or one text, each with the place of its first."""
    lo, held = 0, 0
    for at, text in enumerate(texts):
        if at > lo and held + len(text) > size:
            yield lo, texts[lo:at]
            lo, held = at, 0
        held += len(text)
    if texts:
        yield lo, texts[lo:]


def _searcher(block: list[tuple[int | None, bytes]], min_match: int, coverage: float):
    """A function from texts to their matches in the block, one by one: (place of the text, item_id, covered, test_words, tiles in order)."""
    tests = []
    for base, chunk in _chunks([t for _, t in block]):
        words, ends = tokens(chunk)
        tests += [(i, words[a:b]) for (i, _), a, b in zip(block[base:], ends.tolist(), ends[1:].tolist()) if b > a]
    seeds = []
    for width in sorted({min(min_match, len(t)) for _, t in tests}):
        mine = [n for n, (_, t) in enumerate(tests) if min(min_match, len(t)) == width]
        keys = np.concatenate([grams(sums(tests[n][1]), width) for n in mine])
        # A place counts the words of all these tests, so that runs of two tests never overlap.
        first = np.cumsum([0, *(len(tests[n][1]) for n in mine)])
        place = np.concatenate([np.arange(len(tests[n][1]) - width + 1) + lo for n, lo in zip(mine, first.tolist())])
        order = np.argsort(keys, kind="stable")
        bits = min(24, max(16, (8 * len(keys)).bit_length()))
        maybe = np.zeros(1 << bits, dtype=bool)
        maybe[(keys >> _U(64 - bits)).view(np.int64)] = True
        seeds.append((width, _U(64 - bits), maybe, keys[order], place[order], first, np.array(mine)))

    def near(spans: list[tuple[int, int]], width: int, place: np.ndarray, first: np.ndarray, mine: np.ndarray) -> list[int]:
        """Tests of which the runs found could cover enough."""
        p = np.sort(np.concatenate([place[lo:hi] for lo, hi in spans]))
        owner = np.searchsorted(first, p, side="right") - 1
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        most = np.add.reduceat(np.minimum(np.diff(p, append=p[-1] + width), width), begins)
        owner = owner[begins]
        return mine[owner[most >= coverage * np.diff(first)[owner]]].tolist()

    def search(texts: list[bytes], once: bool = False) -> Iterator[tuple[int, int | None, int, int, list[tuple[int, int, int]]]]:
        for base, chunk in _chunks(texts):
            h, ends = tokens(chunk)
            rolling = sums(h)
            found: dict[int, list[int]] = {}
            for width, shift, maybe, keys, *tests_of in seeds:
                g = grams(rolling, width)
                i = np.flatnonzero(maybe[(g >> shift).view(np.int64)])
                row = np.searchsorted(ends, i, side="right") - 1
                i, row = (x[i + width <= ends[row + 1]] for x in (i, row))
                lo, hi = np.searchsorted(keys, g[i]), np.searchsorted(keys, g[i], side="right")
                spans: dict[int, dict[tuple[int, int], None]] = {}
                for r, a, b in zip(*(x[lo < hi].tolist() for x in (row, lo, hi))):
                    spans.setdefault(r, {})[a, b] = None
                for r, some in spans.items():
                    found.setdefault(r, []).extend(near(list(some), width, *tests_of))
            for r in sorted(found):
                for n in sorted(found[r]):
                    item, test = tests[n]
                    parts = tiles(h[ends[r] : ends[r + 1]], test, min(min_match, len(test)))
                    covered = sum(x[2] for x in parts)
                    if covered >= coverage * len(test):
                        yield base + r, item, covered, len(test), sorted(parts)
                        if once:
                            break

    return search


def _tiler(block: list[tuple[int | None, bytes]], min_match: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(block, min_match, coverage)
        for batch in slices(batches):
            rows = [(at, item, covered, n, len(parts), [x[0] for x in parts], [x[2] for x in parts]) for at, item, covered, n, parts in search(text_rows(batch))]
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names=["doc_id", "item_id", "covered", "test_words", "n_tiles", "starts", "lengths"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose texts hold no test; rows with a null id stay."""
    leaks = stage(matches(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` whose own texts hold no test, whatever their ids: each is judged where it stands, without a join."""
    at = docs.columns.index(text_col)

    def keeper(block: list[tuple[int | None, bytes]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _searcher(block, min_match, coverage)
            for batch in slices(batches):
                leaks = {row for row, *_ in search(text_rows(batch, at), once=True)}
                yield batch.filter(pa.array([row not in leaks for row in range(batch.num_rows)], pa.bool_()))

        return run

    for block in _blocks(benchmark, block_words):
        docs = docs.mapInArrow(frugal(keeper(block)), docs.schema)
    return docs
