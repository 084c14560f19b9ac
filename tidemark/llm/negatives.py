"""Hard negatives: positives' scores cut the score axis into disjoint slots, whose best rows answer all overlapping windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Anchors and rows of one block; a task holds one block of each and scores of ``_AT_ONCE`` anchors.
ANCHOR_BLOCK, ROW_BLOCK, _AT_ONCE = 4096, 16_384, 128
_BEST = "anchor long, slot int, score long, no_id boolean, vec_id long, row long"


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(row, vec_id, label, dim, ints), staged: floor(scale * x) of each component, and a key that tells rows apart whatever their ids.

    Rows with a null label, a null vector, or a null or non-finite component are left out.
    """
    good = F.col("v").isNotNull() & F.col("label").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    table = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    return stage(table.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("ints")), "rows")


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where every sum stays a whole number below 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if top < 2**53 else a @ x.T


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].fill_null(0).to_numpy()


def _searcher(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best k rows of a block for each anchor of another, in each slot of the anchor.

    An anchor's ``limits`` are descending: slot j holds the scores up to
    limits[j] that are above limits[j + 1], the last one those from ``floor``
    on.  Null limits ask for the rows of the anchor's label, all in one slot.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if left.num_rows and right.num_rows:
            vec_id, row, label = _numbers(right, "vec_id"), _numbers(right, "row"), _numbers(right, "label")
            no_id = right["vec_id"].is_null().to_numpy()
            place = np.lexsort((row, vec_id, no_id))  # equal scores: the smaller id first, none last
            vec_id, row, label, no_id = vec_id[place], row[place], label[place], no_id[place]
            x, q = _matrix(right["ints"], right.num_rows)[place], _matrix(left["ints"], left.num_rows)
            anchors, labels, limits, floors = (left[c].to_pylist() for c in ("row", "label", "limits", "floor"))
            for lo in range(0, len(anchors), _AT_ONCE):
                scores = _products(q[lo : lo + _AT_ONCE], x)
                for i, s in enumerate(scores, lo):
                    if limits[i] is None:
                        slots = [np.flatnonzero((label == labels[i]) & (row != anchors[i]))]
                    else:
                        at = np.flatnonzero((s >= floors[i]) & (s <= limits[i][0]) & (label != labels[i]))
                        slot = np.searchsorted(-np.array(limits[i]), -s[at], side="right") - 1
                        slots = [at[slot == j] for j in range(len(limits[i]))]
                    for j, at in enumerate(slots):
                        if len(at) > k:  # all that are as good as the k-th, then by place
                            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                        at = at[np.argsort(-s[at], kind="stable")[:k]]
                        for column, values in zip(out, ([anchors[i]] * len(at), [j] * len(at), s[at], no_id[at], vec_id[at], row[at])):
                            column.extend(values)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["anchor", "slot", "score", "no_id", "vec_id", "row"])

    return run


def _best(anchors: DataFrame, rows: DataFrame, keys: list[str], k: int, blocks: tuple[int, int]) -> DataFrame:
    """The best k rows for each anchor and slot: blocks of anchors and rows with equal ``keys`` meet by an equi join of their numbers."""
    size = rows.groupBy(*keys).agg(F.count("*").alias("rows")).join(anchors.groupBy(*keys).agg(F.count("*").alias("anchors")), keys)
    size = stage(size.select(*keys, F.ceil(F.col("anchors") / blocks[0]).cast("int").alias("na"), F.ceil(F.col("rows") / blocks[1]).cast("int").alias("nx")), "sizes")
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(size, keys).select(*anchors.columns, deal("na").alias("_a"), each("nx").alias("_x"))
    right = rows.join(size, keys).select(*rows.columns, deal("nx").alias("_x"), each("na").alias("_a"))
    found = left.groupBy(*keys, "_a", "_x").cogroup(right.groupBy(*keys, "_a", "_x")).applyInArrow(_searcher(k), _BEST)
    # Spark keeps the first k rows of a slot in each task before the shuffle.
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "no_id", F.when(~F.col("no_id"), F.col("vec_id")), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, anchors: Column, k_positives: int = 5, k: int = 5, low: int = 80, high: int = 100, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over a ``prepared`` table.

    The rows for which ``anchors`` holds are anchors; a score is the integer
    inner product, which must fit 63 bits; rows of another dimension are not
    compared.  An anchor's positives are its best ``k_positives`` other rows of
    the same label.  For each, the best k rows of other labels are returned
    whose 100-fold score lies within ``low`` and ``high`` times the positive's,
    that is, for low < high, nothing for a negative positive score.  Ties go to
    the smaller id, a null id comes last; rows that repeat an id are rows of
    their own, as anchors too.  Without positives or negatives an anchor has no
    row; an empty table gives none.

    The upper limits of an anchor's windows are its slots' ends.  Slots are
    disjoint, so tasks keep the best k of each; the best k below a limit are
    those of its slot followed by what the lower slots have, merged from the
    lowest up, and only then cut at the window's lower end.
    """
    asked = stage(table.where(anchors), "anchors")
    none = asked.select("*", F.lit(None).cast("array<long>").alias("limits"), F.lit(0).cast("long").alias("floor"))
    positives = stage(_best(none, table, ["dim", "label"], k_positives, (anchor_block, row_block)), "positives")
    # Scores are whole, so the ends of a window are too.
    top = F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100")
    least = F.expr(f"-((-score * {low} - pmod(-score * {low}, 100)) div 100)")
    windows = positives.select("anchor", F.when(~F.col("no_id"), F.col("vec_id")).alias("positive_id"), F.col("row").alias("positive"), F.col("score").alias("positive_score"), top.alias("limit"), least.alias("least"))
    windows = stage(windows.where("least <= limit"), "windows")
    limits = windows.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_set("limit"), asc=False).alias("limits"), F.min("least").alias("floor"))
    slotted = _best(stage(asked.join(limits, "row"), "slotted"), table, ["dim"], k, (anchor_block, row_block))
    return _answers(asked, windows, slotted, limits, k)


def _answers(asked: DataFrame, windows: DataFrame, slotted: DataFrame, limits: DataFrame, k: int) -> DataFrame:
    """Each window's rows out of its anchor's slots: at most k rows for each of a few slots, so an anchor's row stays short."""
    found = F.struct(F.col("slot"), (-F.col("score")).alias("below"), "no_id", F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "row")
    tops = slotted.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(found)).alias("tops"))
    # suffixes[j]: the best k of slots j, j + 1, ...; slots are disjoint and each is in order, so merging is appending.
    merged = lambda acc, j: F.concat(F.array(F.slice(F.concat(F.filter("tops", lambda t: t["slot"] == j), F.coalesce(F.get(acc, F.lit(0)), F.slice("tops", 1, 0))), 1, k)), acc)
    down = F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1))
    suffixes = F.reduce(down, F.slice(F.array("tops"), 1, 0), merged)
    table = limits.join(tops, "row").select("row", "limits", suffixes.alias("suffixes"))
    own = asked.select("row", F.col("vec_id").alias("anchor_id"))
    mine = windows.withColumnRenamed("anchor", "row").join(table, "row").join(own, "row")
    mine = mine.withColumn("answer", F.filter(F.get("suffixes", F.array_position("limits", F.col("limit")).cast("int") - 1), lambda t: -t["below"] >= F.col("least")))
    rows = mine.select("anchor_id", "positive_id", "positive_score", F.posexplode("answer").alias("at", "t"))
    return rows.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("negative_id"), "positive_score", (-F.col("t.below")).alias("negative_score"))


def relabelled(vectors: DataFrame, step: int = 7, labels: int = 10) -> DataFrame:
    """Every ``step``-th row's label moves on by one, so that labels and vectors disagree there."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % step == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (SELECT r, unnest(ints) AS x, generate_subscripts(ints, 1) AS i FROM v),
s AS (
  SELECT q.r AS a, c.r AS r, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM c AS q JOIN c ON q.i = c.i AND q.r <> c.r
  WHERE q.r IN (SELECT r FROM v WHERE vec_id % 100 = 0) GROUP BY 1, 2
), t AS (SELECT s.a, s.r, s.score, x.vec_id AS anchor_id, y.vec_id, x.label = y.label AS same FROM s JOIN v AS x ON x.r = s.a JOIN v AS y ON y.r = s.r),
p AS (SELECT * FROM t WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, t.vec_id AS negative_id, p.score AS positive_score, t.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.r ORDER BY t.score DESC, t.vec_id) AS rank
  FROM p JOIN t ON p.a = t.a AND NOT t.same AND 80 * p.score <= 100 * t.score AND 100 * t.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
