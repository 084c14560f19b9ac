"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, contracted, frugal, mixed, slices, stage, text_rows, word_hashes

SHINGLE = 5
#: 30 bands of 5 registers: a pair at 0.85 shares no band once in 4e7, at 0.8 once in 1.5e5.
BANDS, ROWS = 30, 5
#: Members of a bucket that meet at once.
BLOCK = 256

_U = np.uint64


def shingle_sets(texts: list[bytes], hashes: word_hashes, width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes: words are lower-cased in A-Z; a shorter text is one shingle, one without words none."""
    words = [t.lower().split() for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    out = [np.zeros(0, dtype=_U)] * len(texts)
    for i in np.flatnonzero((size > 0) & (size < width)):
        out[i] = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i]), seed=int(size[i]))], dtype=_U)
    long = np.flatnonzero(size >= width)
    if len(long):
        h = np.concatenate([hashes.of(words[i]) for i in long])
        acc = mixed(h)
        for _ in range(1, width):
            acc = acc[:-1]
            h = h[1:]
            acc = mixed(acc ^ h)
        ends = np.cumsum(size[long])
        for i, start, end in zip(long, ends - size[long], ends):
            out[i] = np.unique(acc[start : end - width + 1])
    return out


def super_minhash(sets: list[np.ndarray], registers: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures, a row per non-empty set, as 32-bit step and 24-bit draw.

    An element's step j draws a number in [j, j+1) for the register that a
    Fisher-Yates shuffle of the element's own puts at place j; a register keeps
    its least.  A set is done once no register is above the steps taken, which
    large sets reach after two or three.
    """
    m, n = registers, len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    e = np.concatenate(sets) if n else np.zeros(0, dtype=_U)
    sig = np.full(n * m, np.uint32(0xFFFFFFFF), dtype=np.uint32)
    swaps: list[np.ndarray] = []  # place drawn at each step
    moved: list[np.ndarray] = []  # what stood at place i before step i
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(e):
            break
        draw = mixed(e + _U(0xD1B54A32D192ED03 * (j + 1) % 2**64)) if j else mixed(e)
        place = (j + (draw & _U(0xFFFFFFFF)) % _U(m - j)).astype(np.int64)
        value = (_U(j) << _U(24) | draw >> _U(40)).astype(np.uint32)
        if perm is None and j == 6:  # few elements are left: their shuffles are kept whole
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(e), 1))
            rows = np.arange(len(e))
            for i, k in enumerate(swaps):
                perm[rows, i], perm[rows, k] = perm[rows, k], perm[rows, i].copy()
        if perm is None:
            register, here = place, np.full(len(e), j)
            for i, (k, v) in enumerate(zip(swaps, moved)):
                register, here = np.where(k == place, v, register), np.where(k == j, v, here)
            register = np.where(place == j, here, register)
        else:
            rows = np.arange(len(e))
            register = perm[rows, place].astype(np.int64)
            perm[rows, place] = perm[rows, j]
        np.minimum.at(sig, owner * m + register, value)
        if perm is None:
            swaps.append(place)
            moved.append(here)
        go = (sig.reshape(n, m).max(axis=1) >= np.uint32((j + 1) << 24))[owner] if j + 1 < 256 else np.zeros(len(e), dtype=bool)
        if not go.all():
            e, owner = e[go], owner[go]
            swaps, moved = [x[go] for x in swaps], [x[go] for x in moved]
            perm = perm[go] if perm is not None else None
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per set and band; the band is part of it."""
    keys = np.tile(np.arange(1, bands + 1, dtype=_U), (len(sig), 1))
    for r in range(rows):
        keys = mixed(keys ^ mixed(sig[:, r::rows][:, :bands].astype(_U) + _U(r << 40)))
    return keys


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, same, bands): ``same`` names the whole set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for whole in batches:
            for batch in slices([whole]):
                sets = shingle_sets(text_rows(batch), hashes)
                same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    sig = super_minhash([sets[i] for i in full], bands * rows)
                    for i, x in zip(full, band_keys(sig, bands, rows).view(np.int64)):
                        keys[i] = x
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "same", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, n_shingles long, same binary, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles) as sorted 8-byte hashes, for the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for whole in batches:
            for batch in slices([whole]):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(text_rows(batch), hashes)], pa.binary())], names=["doc_id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(ids, "doc_id", "left_semi").mapInArrow(frugal(run), "doc_id long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = [_linked(np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U), percent) for x, y in pairs]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(frugal(run), "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _block_links(percent: int):
    """Links between components among the members of one block, or between two blocks, of a bucket.

    A pair is looked at in the first band it shares only, pairs that share most
    bands first; once a link joins two components their other pairs are skipped.
    What comes out is at most a link a member.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bands = np.array(rows["bands"].tolist(), dtype=np.int64)
        ids, size, comp, block = (rows[c].to_numpy() for c in ("rep", "n_shingles", "component", "block"))
        here = int((bands[0] == key[0]).argmax())
        up = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        left, right = (np.flatnonzero(block == key[i]) for i in (1, 2))
        pairs = []
        for i in left.tolist():
            same = bands[right] == bands[i]
            ok = (same.argmax(axis=1) == here) & (comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))
            if key[1] == key[2]:
                ok &= right > i
            pairs += [(-n, i, j) for n, j in zip(same[ok].sum(axis=1).tolist(), right[ok].tolist())]
        sets = [np.frombuffer(x, dtype=_U) for x in rows["shingles"]]
        out = []
        for _, i, j in sorted(pairs):
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b and _linked(sets[i], sets[j], percent):
                up[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row.

    Documents with equal sets are one class at once; only a class's smallest id
    goes on.  Classes that share a band meet in its bucket.  First every member
    is verified against the bucket's smallest id, on full sets, and links become
    components.  Buckets whose members are then one component are done; in the
    others all members of different components are compared, in blocks of
    bounded size that meet pairwise, and only links leave a task.  So a bucket
    of copies costs a row a member, no pairs are listed, and no link between two
    components that share a band is left out.

    Null and empty texts have empty sets and stand alone; rows with a null id
    are linked with nothing and kept; rows that repeat an id are one node, each
    with its own count.  No rows give none.
    """
    sketch = stage(sketches(docs, id_col, text_col, bands, rows), "sketches")
    known = sketch.where("doc_id IS NOT NULL AND same IS NOT NULL")
    classes = known.groupBy("same").agg(F.min("doc_id").alias("rep"))
    member = stage(known.select("doc_id", "same", "n_shingles").distinct().join(classes, "same").select("doc_id", "n_shingles", "rep"), "members")
    reps = known.join(classes.withColumnRenamed("rep", "doc_id"), ["same", "doc_id"], "left_semi")
    banded = stage(reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("key")).distinct(), "bands")
    shared = banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    buckets = stage(banded.join(shared.select("key"), "key", "left_semi"), "buckets")
    labels = stage(buckets.select("rep", F.col("rep").alias("component")).distinct(), "labels")
    sets = stage(_sets(docs, labels.select(F.col("rep").alias("doc_id")), id_col, text_col), "sets")

    def joined(links: DataFrame) -> DataFrame:
        """The labels after these links (a, b)."""
        side = lambda c: labels.select(F.col("rep").alias(c), F.col("component").alias(f"{c}_component"))
        edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_component").alias("src"), F.col("b_component").alias("dst"))
        found = components(contracted(edges))
        return stage(labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("rep", F.coalesce("root", "component").alias("component")), "labels")

    lead = shared.select("key", F.col("lo").alias("other")).join(labels.select(F.col("rep").alias("other")), "other")
    sizes = buckets.select(F.col("rep").alias("other"), F.col("n_shingles").alias("m")).distinct()
    stars = buckets.join(lead, "key").where("rep <> other").select("rep", "other", "n_shingles").distinct().join(sizes, "other")
    stars = stars.where(100 * F.least("n_shingles", "m") >= percent * F.greatest("n_shingles", "m")).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    labels = joined(_verified(stage(stars, "stars"), sets, percent))

    mine = buckets.join(labels, "rep")
    divided = mine.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("lo < hi")
    dealt = mine.join(divided.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = stage(dealt, "open")
    if not dealt.isEmpty():
        meets = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "rep", "n_shingles", "component", "block")
        full = sets.join(reps.select("doc_id", "bands"), "doc_id").withColumnRenamed("doc_id", "rep")
        links = meets.join(full, "rep").groupBy("key", "x", "y").applyInPandas(_block_links(percent), "a long, b long")
        labels = joined(links)
    grouped = stage(member.select("doc_id", "rep").join(labels, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component")).distinct(), "grouped")
    least = grouped.groupBy("doc_id").agg(F.min("component").alias("component_id"), F.max("component").alias("most"))
    twofold = grouped.join(least.where("component_id < most"), "doc_id").where("component > component_id").select(F.col("component").alias("src"), F.col("component_id").alias("dst"))
    found = components(twofold)  # texts under one id link their groups
    least = least.join(found, F.col("component_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles").join(least, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
