"""Exact top-k inner products: bounds from distances to many pivots order the candidates and stop the search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, stage

#: Pivots of the table, and vectors of one block on either side.
PIVOTS, BLOCK = 32, 4096
_STEP = 128


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, dim, ints): floor(scale * x) of each component as 8-byte integers; null vectors, and those with null or non-finite components, are left out."""
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    table = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & good)
    return table.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("ints"))


def _pivot_table(table: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """A few vectors of each dimension, drawn by the hash of their id; ``pivots`` rows each at most."""
    out = {}
    for (dim,) in table.select("dim").distinct().collect():  # dimensions, not vectors
        rows = table.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("ints").collect()
        out[dim] = np.array([r[0] for r in rows], dtype=np.float64)
    return out


def _with_distances(table: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the distance to each pivot of the vector's dimension, computed once; vectors and distances as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints, dist = [], []
            for dim, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v = np.array(v, dtype=np.int64)
                ints.append(v.tobytes())
                dist.append(np.sqrt(((pivots[dim] - v) ** 2).sum(axis=1)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ints, pa.binary()), pa.array(dist, pa.binary())], names=["vec_id", "dim", "ints", "dist"])

    return table.mapInArrow(frugal(run), "vec_id long, dim int, ints binary, dist binary")


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of one candidate block for each query of one query block."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    right = right.sort_values("vec_id", kind="stable")
    ids = right["vec_id"].to_numpy(np.int64)
    x = np.frombuffer(b"".join(right["ints"]), dtype=np.int64).reshape(len(right), -1)
    dx = np.frombuffer(b"".join(right["dist"]), dtype=np.float64).reshape(len(right), -1)
    norm = (x.astype(np.float64) ** 2).sum(axis=1)
    out = []
    for qid, q, dq in zip(left["vec_id"], left["ints"], left["dist"]):
        q, dq = np.frombuffer(q, dtype=np.int64), np.frombuffer(dq, dtype=np.float64)
        low = np.abs(dx - dq).max(axis=1)  # the triangle inequality at the best pivot
        # q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2; rounding gets room of one part in 1e9 and a unit
        high = (float((q.astype(np.float64) ** 2).sum()) + norm - low * low) / 2
        high += np.abs(high) * 1e-9 + 1
        order = np.argsort(-high, kind="stable")
        best: list[tuple[int, int]] = []
        for lo in range(0, len(order), _STEP):
            if len(best) == k and high[order[lo]] < -best[-1][0]:
                break
            part = order[lo : lo + _STEP]
            part = part[ids[part] != qid]
            best = sorted(best + [(-s, i) for s, i in zip((x[part] @ q).tolist(), ids[part].tolist())])[:k]
        out += [(qid, i, -s) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with the vectors of its dimension, ties to the smaller id.

    Both sides are (vec_id, dim, ints) as ``quantized`` makes them.  Blocks of
    bounded size meet by an equi join of block numbers, so a task holds one
    query block and one candidate block; each keeps k rows a query, which are
    merged.  A query's own id is no candidate; repeated ids are rows of their
    own, and of equal (score, id) each takes a rank.  Fewer candidates give
    fewer rows; no queries none.  Products must fit 63 bits.
    """
    table = stage(vectors, "vectors")
    asked = stage(queries, "queries")
    pivot_rows = _pivot_table(table, pivots)
    parts = lambda t: max(1, -(-t.count() // block))
    nx, nq = parts(table), parts(asked)
    deal = lambda t, n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(t)
    each = lambda t, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(t)
    right = _with_distances(table, pivot_rows).select("*", deal("xb", nx), each("qb", nq))
    left = _with_distances(asked, pivot_rows).select("*", deal("qb", nq), each("xb", nx))
    keys = ["dim", "qb", "xb"]

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search(a, b, k)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    # Spark keeps the first k rows of a query in each task before the shuffle.
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (SELECT vec_id, unnest(ints) AS x, generate_subscripts(ints, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
