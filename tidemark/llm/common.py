"""Helpers of the pipeline operators: staged tables, byte words, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_folder, stage

__all__ = ["components", "contracted", "frugal", "mixed", "shared_folder", "slices", "stage", "text_rows", "word_hashes"]

Batches = Iterator[pa.RecordBatch]
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_U = np.uint64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; ``session.drop_staged`` deletes it with the staged tables."""
    return new_folder(spark, name)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task over short batches, whose memory goes back to the system at its end: workers live on, beside the executor's heap.

    The batch length is set where the session has Spark's default.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def slices(batches: Batches, rows: int = 256) -> Batches:
    """The same rows in short batches, so that only few texts at a time are turned into Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def text_rows(batch: pa.RecordBatch, column: int = 1) -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64's finisher), so that sums and products of hashes spread well."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class word_hashes(dict):
    """Words to 64-bit hashes.  Words seen are kept up to a bound, then forgotten: only speed depends on it."""

    def __init__(self, most: int = 150_000):
        import xxhash

        super().__init__()
        self._hash, self._most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        h = self[word] = self._hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components: (node, component), component being the smallest node reachable.

    Large-star and small-star rounds in turn, each staged in the shared folder.
    A round's size is that of the edges, a hub's edges are aggregated before the
    shuffle and its join is split by adaptive execution, and the number of
    rounds grows with the logarithm of the longest path.  Nulls and self-loops
    link nothing; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    e = stage(e, "edges")
    seen = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large.where("a <> b"), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = stage(small.select("x.a", "x.b").where("a <> b").distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's long edges (src, dst) reduced to a spanning star per group by union-find with path halving.

    Memory follows the nodes of one task's edges, not of the graph.
    """

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["src", "dst"])

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).dropna().mapInArrow(frugal(union), "src long, dst long")
