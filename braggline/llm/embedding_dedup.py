"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors within cosine ``t`` lie within ``epsilon = sqrt(2 - 2 t)`` of each other, also
in their leading principal coordinates.  Vectors are sorted by the cells of a grid of
that width on those coordinates and cut into sequence intervals.  Intervals are joined
recursively from the whole sequence down: a pair of intervals whose bounding boxes lie
further apart than epsilon is skipped with all it holds.  The blocks that are left are
compared in double precision, again by halves down to short runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tracks import connected_components
from ..session import checkpointed
from .common import dense_rank_rows
from .groups import Links, by_key

THRESHOLD = 0.95
LEADING = 8        # principal dimensions of the grid
BLOCK = 2048       # vectors of a leaf interval
FAN = 8            # intervals of one level in an interval of the next
RUN = 128          # vectors compared at once without looking further
CHUNK = 16         # partner blocks in one group of work


def unit_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of unit length in double precision, short ones filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.list_value_length(column).to_numpy()
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = pc.list_flatten(column).to_numpy()
    out /= np.abs(out).max(axis=1, keepdims=True)  # no square may overflow or vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def can_link(key: str, vector: str) -> Column:
    """Whether a row has an id and a vector without nulls, finite and not zero; never null."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(key).isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def principal_axes(folded: DataFrame, width: int, leading: int) -> np.ndarray:
    """The leading axes of the unit vectors; sums of ``width * width`` numbers per task are all that is gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        seen = 0
        for batch in batches:
            u = unit_rows(batch.column("v"), width)
            total += u.T @ u
            seen += len(u)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "value"])

    rows = folded.select("v").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    moment = np.zeros(width * width)
    for at, value in rows:
        moment[at] = value
    return np.linalg.eigh(moment.reshape(width, width))[1][:, ::-1][:, :leading].copy()


def in_grid_order(folded: DataFrame, width: int, epsilon: float, leading: int, block: int) -> DataFrame:
    """``rep, copies, v, p, block``: vectors numbered along the grid order and cut into intervals."""
    axes = principal_axes(folded, width, leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = unit_rows(batch.column("v"), width) @ axes
            cells = np.floor(place / epsilon).astype(np.int32)
            lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), t))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("v"), lists(place, pa.float64()), lists(cells, pa.int32())],
                                             ["rep", "copies", "v", "p", "cells"])

    placed = folded.mapInArrow(run, "rep bigint, copies bigint, v array<double>, p array<double>, cells array<int>")
    ranked = dense_rank_rows(placed, [F.col("cells"), F.col("rep")], "spot")
    return ranked.select("rep", "copies", "v", "p", F.floor(F.col("spot") / block).cast("bigint").alias("block"))


def interval_pairs(ordered: DataFrame, n_blocks: int, leading: int, epsilon: float, fan: int = FAN) -> DataFrame:
    """``a, b`` with ``a <= b``: leaf intervals that may hold a link, by descending from the whole sequence."""
    sides = [F.min(F.get("p", F.lit(i))).alias(f"lo{i}") for i in range(leading)] + [F.max(F.get("p", F.lit(i))).alias(f"hi{i}") for i in range(leading)]
    boxes = checkpointed(ordered.groupBy("block").agg(*sides).select(
        "block", F.array(*[f"lo{i}" for i in range(leading)]).alias("lo"), F.array(*[f"hi{i}" for i in range(leading)]).alias("hi")))

    def level(span: int) -> DataFrame:
        over = boxes.withColumn("at", F.floor(F.col("block") / span).cast("bigint")).groupBy("at")
        low = [F.min(F.get("lo", F.lit(i))) for i in range(leading)]
        high = [F.max(F.get("hi", F.lit(i))) for i in range(leading)]
        return over.agg(F.array(*low).alias("lo"), F.array(*high).alias("hi")).withColumn("parent", F.floor(F.col("at") / fan).cast("bigint"))

    span = 1
    while span < n_blocks:
        span *= fan
    pairs = boxes.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    while span > 1:
        span //= fan
        kids = level(span)
        left = kids.select(F.col("parent").alias("a"), F.col("at").alias("na"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        right = kids.select(F.col("parent").alias("b"), F.col("at").alias("nb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        gap = F.aggregate(F.arrays_zip("alo", "ahi", "blo", "bhi"), F.lit(0.0), lambda acc, s: acc + F.pow(
            F.greatest(s["alo"] - s["bhi"], s["blo"] - s["ahi"], F.lit(0.0)), F.lit(2.0)))
        pairs = pairs.join(left, "a").join(right, "b").where(F.col("na") <= F.col("nb")).where(gap <= epsilon * epsilon).select(
            F.col("na").alias("a"), F.col("nb").alias("b"))
    return pairs


class Work:
    """The recursive comparison of two sequence intervals of one group."""

    def __init__(self, unit: np.ndarray, place: np.ndarray, copies: np.ndarray, threshold: float, epsilon: float):
        self.unit, self.place, self.copies, self.threshold, self.epsilon = unit, place, copies, threshold, epsilon
        self.count = np.zeros(len(unit), np.int64)
        self.links = Links(len(unit))

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        """Rows ``a0:a1`` against ``b0:b1``; equal intervals are compared with themselves."""
        if a0 == a1 or b0 == b1:
            return
        if (a0, a1) != (b0, b1):
            pa_, pb = self.place[a0:a1], self.place[b0:b1]
            gap = np.maximum(0, np.maximum(pa_.min(0) - pb.max(0), pb.min(0) - pa_.max(0)))
            if (gap * gap).sum() > self.epsilon ** 2:
                return
        if a1 - a0 <= RUN and b1 - b0 <= RUN:
            self.compare(a0, a1, b0, b1)
            return
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        halves_a = [(a0, am), (am, a1)] if a1 - a0 > RUN else [(a0, a1)]
        halves_b = [(b0, bm), (bm, b1)] if b1 - b0 > RUN else [(b0, b1)]
        for i, x in enumerate(halves_a):
            for j, y in enumerate(halves_b):
                if (a0, a1) != (b0, b1) or i <= j:
                    self.join(*x, *y)

    def compare(self, a0: int, a1: int, b0: int, b1: int) -> None:
        cosine = self.unit[a0:a1] @ self.unit[b0:b1].T
        left, right = np.nonzero(cosine >= self.threshold - 1e-9)
        close = np.flatnonzero(np.abs(cosine[left, right] - self.threshold) < 1e-9)
        keep = np.ones(len(left), bool)
        for i in close:  # too near to tell from products of rounded vectors
            keep[i] = exact_cosine(self.unit[a0 + left[i]], self.unit[b0 + right[i]]) >= self.threshold
        left, right = left[keep] + a0, right[keep] + b0
        if (a0, a1) == (b0, b1):
            left, right = left[left < right], right[left < right]
        np.add.at(self.count, left, self.copies[right])
        np.add.at(self.count, right, self.copies[left])
        self.links.add(left, right)


def block_links(ordered: DataFrame, pairs: DataFrame, width: int, threshold: float, epsilon: float, chunk: int = CHUNK) -> DataFrame:
    """``rep, other, n``: partial link counts (``other`` null) and links that hold the components together."""
    wide = F.floor(F.col("b") / chunk).cast("bigint")
    home = ordered.join(pairs.select(F.col("a").alias("block"), wide.alias("chunk")).distinct(), "block")
    far = ordered.withColumnRenamed("block", "b").join(pairs.where("a < b"), "b")
    columns = ["rep", "copies", "v", "p"]
    groups = home.select(F.col("block").alias("a"), "chunk", F.lit(-1).cast("bigint").alias("b"), *columns).unionByName(
        far.select("a", wide.alias("chunk"), "b", *columns))
    own = pairs.where("a = b").select("a", wide.alias("chunk"), F.lit(1).alias("itself"))
    groups = groups.join(own, ["a", "chunk"], "left")
    keys = ["a", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches, keys):
            b = group.column("b").to_numpy()
            starts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            work = Work(unit_rows(group.column("v"), width), pc.list_flatten(group.column("p")).to_numpy().reshape(group.num_rows, -1), group.column("copies").to_numpy(), threshold, epsilon)
            home_end = starts[1] if b[0] == -1 else 0
            if group.column("itself")[0].as_py():
                work.join(0, home_end, 0, home_end)
            for s, e in zip(starts[1:], starts[2:]):
                work.join(0, home_end, s, e)
            rep = group.column("rep").to_numpy()
            hit = np.flatnonzero(work.count)
            one, two = work.links.forest()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((rep[hit], rep[one]))),
                                              pa.array([None] * len(hit) + rep[two].tolist(), pa.int64()),
                                              pa.array(np.concatenate((work.count[hit], np.zeros(len(one), np.int64))))], ["rep", "other", "n"])

    return groups.repartition(*keys).sortWithinPartitions(*keys, "b", "rep").mapInArrow(run, "rep bigint, other bigint, n bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors link when their cosine is at least ``threshold``, whatever other columns
    say.  Null, zero or non-finite vectors, and rows without an id, link with nothing; a
    shorter vector counts as filled up with zeros.  Equal vectors are one in the join and
    count as many as they are, so a crowd of copies costs no pairs.  ``component_id`` is
    the smallest id that links reach (a row's own if none; null without an id), and
    ``kept`` says that it is the row's own.  An empty table gives an empty result.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    epsilon = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    rows = checkpointed(vectors.where(can_link(key, vector)).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")))
    folded = checkpointed(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    size = folded.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    every = vectors.select(F.col(key).cast("bigint").alias("vec_id"))
    if not size["n"]:
        return every.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    leading = min(leading, size["width"])
    ordered = checkpointed(in_grid_order(folded.select("rep", "copies", "v"), size["width"], epsilon, leading, block))
    pairs = checkpointed(interval_pairs(ordered, -(-size["n"] // block), leading, epsilon))
    found = checkpointed(block_links(ordered, pairs, size["width"], threshold, epsilon))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    facts = (folded.select("rep", "copies", "v").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = rows.join(facts, "v").select("vec_id", "n_links", "component_id", F.expr("vec_id = component_id").alias("kept"))
    alone = vectors.where(~can_link(key, vector)).select(
        F.col(key).cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"),
        F.col(key).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
