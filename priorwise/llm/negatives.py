"""Hard negatives of anchor vectors by Fagin's threshold algorithm.

Vectors are taken as whole numbers, so scores (inner products) are exact. Candidates are dealt to blocks, and
each block meets the anchors in blocks. A block keeps a list of its candidates for each dimension, sorted by
component. For an anchor the lists are read in step, from the end that its component's sign makes the better
one; a candidate that shows up for the first time is scored from its whole vector. What no list has shown yet
scores at most the sum of the anchor's components times the last ones read, the threshold. Reading stops once
the threshold is strictly below the k-th best score of every window (a tie could still have a smaller id), or
below the least score that a window admits.

Positives come first: an anchor meets the blocks of its own label, and the best of all blocks are its positives.
Each of them opens a window of scores for the negatives, and the anchor meets the blocks of all rows with its
windows. A block gives at most k rows for each window, which are ranked over all blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.llm.common import Batches, stored

SCALE = 256  # a component x becomes floor(SCALE * x)
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score that a negative's may have
CANDIDATES, ANCHORS, BLOCK_BYTES = 4096, 2048, 64 << 20  # rows of a block at most, and bytes of its numbers
FIRST = 16  # entries read from each list at first; doubled from step to step
EXACT = 1 << 53  # whole numbers that doubles hold
LONGEST = 1 << 63


def saturated(scores):
    """Scores within 64 bits; doubles are, where they are used."""
    if isinstance(scores, int):
        return min(max(scores, -LONGEST), LONGEST - 1)
    if scores.dtype == object:
        scores[:] = [saturated(s) for s in scores.tolist()]
    return scores


class Lists:
    """A block's vectors, and its candidates sorted by each component."""

    def __init__(self, vectors: np.ndarray, ties: np.ndarray):
        self.vectors, self.ties = vectors, ties
        order = np.argsort(vectors, axis=0, kind="stable")
        self.order, self.values = order.T, np.take_along_axis(vectors, order, axis=0).T

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the k best candidates with low <= 100 * score <= high, and their scores."""
        n = len(self.vectors)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = ~allowed
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=self.vectors.dtype)) for _ in windows]
        open_ = list(range(len(windows)))
        read, step = 0, FIRST
        while open_ and read < n:
            to = n if len(up) + len(down) == 0 else min(n, read + step)  # an anchor of zeros has no lists: all scores are equal
            shown = np.zeros(n, dtype=bool)
            shown[self.order[up, n - to : n - read].ravel()] = True
            shown[self.order[down, read:to].ravel()] = True
            new = np.flatnonzero(shown & ~seen) if to < n else np.flatnonzero(~seen)
            seen |= shown
            scores = saturated(self.vectors[new] @ anchor)
            threshold = saturated((anchor[up] * self.values[up, n - to]).sum() + (anchor[down] * self.values[down, to - 1]).sum())
            still = []
            for w in open_:
                low, high = windows[w]
                fit = (100 * scores >= low) & (100 * scores <= high)
                at, have = np.concatenate((found[w][0], new[fit])), np.concatenate((found[w][1], scores[fit]))
                top = np.lexsort((self.ties[at], -have))[:k]
                found[w] = at[top], have[top]
                if not (100 * threshold < low or len(top) == k and have[top[-1]] > threshold):
                    still.append(w)
            open_, read, step = still, to, 2 * step
        return found


def whole_numbers(vectors: list[np.ndarray]) -> np.ndarray:
    """One row for each vector, floor(SCALE * x) as doubles; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = np.floor(SCALE * v.astype(np.float64))
    return out


def exactly(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both at one width, and as Python numbers if doubles can't hold a hundred times any score."""
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, anchors))
    if 100.0 * max(width, 1) * max(np.abs(rows).max(initial=0), 1) * max(np.abs(anchors).max(initial=0), 1) < EXACT:
        return rows, anchors
    return tuple(np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape) for x in (rows, anchors))


def _mine(batches: Batches, same: bool, k: int) -> Batches:
    """Blocks of candidates, each followed by a block of anchors: the best candidates of each anchor's windows."""
    block, candidates, anchors = None, [], []

    def done() -> Batches:
        if not candidates or not anchors:
            return
        rows, asked = exactly(whole_numbers([c["vec"] for c in candidates]), whole_numbers([a["vec"] for a in anchors]))
        ids = [(c["vec_id"] is None, c["vec_id"] or 0, c["row"]) for c in candidates]
        ties = np.empty(len(ids), dtype=np.int64)
        ties[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        lists = Lists(rows, ties)
        labels, row_ids = np.array([c["label"] for c in candidates]), np.array([c["row"] for c in candidates])
        out: list[tuple] = []
        for a, vector in zip(anchors, asked, strict=True):
            allowed = (labels == a["label"]) & (row_ids != a["row"]) if same else labels != a["label"]
            windows = [(-np.inf, np.inf)] if same else [(LOW * s, HIGH * s) for s in a["windows"]]
            for w, (at, scores) in enumerate(lists.best(vector, allowed, windows, k)):
                for x, s in zip(at.tolist(), scores.tolist(), strict=True):
                    out.append((a["row"], w, candidates[x]["vec_id"], candidates[x]["row"], int(s)))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "window", "vec_id", "row", "score"])

    for batch in batches:
        vectors = batch.column("vec")
        flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), (vectors.offsets.to_numpy() - vectors.offsets[0].as_py())
        for i, row in enumerate(batch.drop_columns(["vec"]).to_pylist()):
            row["vec"] = flat[ends[i] : ends[i + 1]]
            if (row["c"], row["a"]) != block:
                yield from done()
                block, candidates, anchors = (row["c"], row["a"]), [], []
            (anchors if row["asks"] else candidates).append(row)
    yield from done()


def _met(rows: DataFrame, anchors: DataFrame, key: Column, rows_of: int, anchors_of: int, same: bool, k: int) -> DataFrame:
    """(anchor, window, vec_id, row, score): the anchors meet the rows of their ``key``, in blocks of both."""
    rows, anchors = rows.withColumn("key", key), anchors.withColumn("key", key)
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / rows_of).alias("cs"))
    asks = anchors.groupBy("key").agg(F.ceil(F.count("*") / anchors_of).alias("as"))
    shape = sizes.join(asks, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    columns = ["row", "vec_id", "label", "vec", "windows"]
    given = rows.join(shape, "key").select("key", own("cs").alias("c0"), every("as").alias("a"), F.lit(False).alias("asks"), *columns)
    asked = anchors.join(shape, "key").select("key", every("cs").alias("c0"), own("as").alias("a"), F.lit(True).alias("asks"), *columns)
    tiles = given.unionByName(asked).withColumn("c", F.concat_ws(":", "key", "c0")).drop("key", "c0")
    dealt = tiles.repartition("c", "a").sortWithinPartitions("c", "a", "asks")
    return dealt.mapInArrow(partial(_mine, same=same, k=k), "anchor long, window int, vec_id long, row long, score long")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], relabel: Callable[[Column, Column], Column] = lambda i, label: label,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", candidates: int = CANDIDATES, anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, whole and exact.

    ``is_anchor`` tells anchors by id, ``relabel`` gives the label that holds by id and label. An anchor's positives
    are its ``POSITIVES`` best other rows of its label; for each of them the ``NEGATIVES`` best rows of another
    label whose score is from ``LOW`` to ``HIGH`` per cent of the positive's. Fewer are given if there are fewer,
    and none for a positive of negative score, where no score is in both bounds. Ties go to the smaller id, a null
    id being the greatest and no anchor. Rows with a null label or vector, or with a null or non-finite component,
    take no part. Repeated rows are rows of their own. Vectors of different lengths are as if shorter ones ended
    in zeros; an empty vector scores zero with all. A score beyond 64 bits is the nearest 64-bit number. Other columns take no part, whatever their names.
    """
    vec, vec_id = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`").cast("long")
    if vectors.select(vec.alias("v")).schema["v"].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = vectors.filter(F.col(f"`{label_col}`").isNotNull() & vec.isNotNull() & finite)
    label = relabel(vec_id, F.col(f"`{label_col}`").cast("long"))
    rows = usable.select(vec_id.alias("vec_id"), label.alias("label"), vec.alias("vec"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("windows", F.lit(None).cast("array<long>")))
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    fit = max(16, BLOCK_BYTES // (24 * longest))  # a component stands in the vectors, the lists and their order
    candidates, anchors = min(candidates, fit), min(anchors, fit)
    asking = rows.filter(F.coalesce(is_anchor(F.col("vec_id")), F.lit(False)))

    near = _met(rows, asking, F.col("label"), candidates, anchors, True, POSITIVES)
    positives = stored(_ranked(near, ["anchor"], POSITIVES).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"))
    with_windows = positives.filter("positive_score >= 0").groupBy(F.col("anchor").alias("row"))
    windows = with_windows.agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("of"))
    asking = asking.drop("windows").join(windows, "row").select("row", "vec_id", "label", "vec", F.col("of.positive_score").alias("windows"))

    far = _met(rows, asking, F.lit(0), candidates, anchors, False, NEGATIVES)
    found = _ranked(far, ["anchor", "window"], NEGATIVES).select("anchor", (F.col("window") + 1).alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.withColumnRenamed("rank", "of").join(asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    out = found.join(named, ["anchor", "of"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
