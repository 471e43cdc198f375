"""Toxicity by a linear classifier over character n-grams scaled by naive-Bayes log-count ratios.

A text is the set of its hashed character n-grams (bytes of the lower-cased text with
runs of white space as one blank).  The training texts give every n-gram the log of how
much more often toxic texts hold it than others; a text's features are those ratios over
the square root of their number, and a logistic regression with an L2 penalty learns a
weight for each; its offset is set on texts it was not taught.  Learning uses a bounded, hash-drawn sample of both classes; scoring
reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_crc, slices, texts, unit_hash, written

GRAMS = (5, 7)
BUCKETS = 1 << 18
#: Bounds of the training sample: texts of each class, and n-grams of all texts together.
SAMPLE = 3000
SAMPLE_GRAMS = 25_000_000
ROUNDS = 60
PENALTY = 1e-5
MOMENTUM = 0.9
#: N-grams in fewer training texts have no ratio.
RARE = 10


def grams(text: str, mark: np.ndarray) -> np.ndarray:
    """The buckets of the distinct n-grams of a text; ``mark`` is scratch space and comes back clear."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    code = raw + np.uint64(1)
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        code = code[:len(raw) - n + 1] * np.uint64(257) + raw[n - 1:] + np.uint64(1)
        if n in GRAMS:
            mark[(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)] = True
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


def descend(features: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight per bucket, ratios included, and the offset, by gradient descent with momentum; both classes weigh the same.

    The step is as long as the curvature of the loss surely allows, so the scaling by
    the ratios decides how fast an n-gram is learned.  The n-grams of all texts lie one
    after another, eight bytes for the bucket and four for the value.
    """
    sizes = np.array([len(f) for f in features])
    starts = np.cumsum(sizes) - sizes
    at = np.concatenate(features).astype(np.intp)
    counts = [np.bincount(np.concatenate([f for f, y in zip(features, toxic) if y == c]), minlength=BUCKETS) for c in (1, 0)]
    p, q = counts
    ratio = np.log(((p + 1.0) / (p.sum() + BUCKETS)) / ((q + 1.0) / (q.sum() + BUCKETS)))
    ratio[p + q < min(RARE, max(1, len(toxic) // 50))] = 0.0
    value = ratio.astype(np.float32)[at]
    value *= np.repeat((1 / np.sqrt(sizes)).astype(np.float32), sizes)
    share = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    length = np.add.reduceat(value * value, starts, dtype=np.float64)
    step = 3 / (0.25 * ((length * share).sum() + 1) + PENALTY)
    weight, offset, run, run0 = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS):
        part = weight.astype(np.float32)[at]
        part *= value
        z = np.add.reduceat(part, starts, dtype=np.float64) + offset
        slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) * share
        np.multiply(value, np.repeat(slope.astype(np.float32), sizes), out=part)
        run = MOMENTUM * run + np.bincount(at, weights=part, minlength=BUCKETS) + PENALTY * weight
        run0 = MOMENTUM * run0 + slope.sum()
        weight, offset = weight - step * run, offset - step * run0
    return weight * ratio, float(offset)


def cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score from which calling texts toxic gives the best mean of precision and recall (F1)."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(toxic[order])
    best = int(np.argmax(2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())))
    return float(score[order[best:best + 2]].mean())


def fit(features: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight per bucket and offset; the offset is set where each half is told best by what the other half taught."""
    full = [i for i, f in enumerate(features) if len(f)]  # a text without n-grams teaches nothing
    features, toxic = [features[i] for i in full], toxic[full]
    if len(set(toxic.tolist())) < 2:  # one class or none
        share = toxic.mean() if len(toxic) else 0.0
        return np.zeros(BUCKETS), float(np.log((share + 1e-3) / (1 - share + 1e-3)))

    weight, offset = descend(features, toxic)
    half = np.zeros(len(toxic), np.int64)
    for y in (0, 1):
        own = np.flatnonzero(toxic == y)
        half[own] = np.arange(len(own)) % 2
    if min(toxic.sum(), (1 - toxic).sum()) >= 4:
        other = np.empty(len(toxic))
        for h in (0, 1):
            rest = np.flatnonzero(half != h)
            w, b = descend([features[i] for i in rest], toxic[rest])
            for i in np.flatnonzero(half == h):
                other[i] = b + w[features[i]].sum() / np.sqrt(len(features[i]))
        offset -= cut(other, toxic)
    return weight, offset


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE, sample_grams: int = SAMPLE_GRAMS) -> tuple[np.ndarray, float]:
    """Learn from labelled rows for which ``learn`` (a column over the id ``doc_id``) holds.

    Of each class the ``sample`` ids of smallest hash are used, as far as ``sample_grams``
    n-grams go; the classes take turns, so a bound that cuts leaves both alike.  The bound holds
    before anything meets in the learning task.  An id labelled more than once is toxic if one of its
    labels says so; null labels are none.  An id with several rows teaches once, by the text whose
    n-grams come first in byte order.
    """
    known = (labels.select(F.col(key).alias("doc_id"), F.col(label).alias("toxic")).where(learn).where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("draw", unit_hash("toxicity", F.col("doc_id").cast("string"))))
    chosen = known.where("toxic = 1").orderBy("draw", "doc_id").limit(sample).unionByName(known.where("toxic = 0").orderBy("draw", "doc_id").limit(sample))
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "doc_id"))).drop("draw")
    # At most 2 * sample rows of a few numbers are broadcast, whatever the tables hold.
    texts_of = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "place")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(BUCKETS, bool)
        for batch in slices(batches, "text"):
            found = [grams(t, mark).astype("<i4").tobytes() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("toxic"), batch.column("place")], ["grams", "toxic", "place"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, toxic = [], []
        for batch in batches:
            held += [np.frombuffer(raw, "<i4") for raw in batch.column("grams").to_pylist()]
            toxic += batch.column("toxic").to_pylist()
        weight, offset = fit(held, np.array(toxic, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weight.astype("<f4").tobytes()], pa.binary()), pa.array([offset])], ["weight", "offset"])

    # The repeats of an id are folded in their tasks, then one text of each is left.
    found = texts_of.mapInArrow(features, "grams binary, toxic int, place int").groupBy("toxic", "place").agg(F.min("grams").alias("grams"))
    found = written(found, "toxicity-features")
    # At most 2 * sample rows of three numbers stand in this window.
    turn = Window.orderBy("place", "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (found.select("toxic", "place", (F.octet_length("grams") / 4).cast("bigint").alias("size"))
            .withColumn("upto", F.sum("size").over(turn)).where(F.col("upto") <= sample_grams).select("toxic", "place"))
    model = (found.join(F.broadcast(fits), ["toxic", "place"]).select("grams", "toxic", "place").repartition(1).sortWithinPartitions("place", "toxic")
             .mapInArrow(learned, "weight binary, offset double")).first()
    if model is None:  # no labelled text at all
        return fit([], np.zeros(0, np.int64))
    return np.frombuffer(model["weight"], "<f4").astype(np.float64), model["offset"]


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row: the probability that a reader would label it toxic.

    Null and empty texts get what the offset and the n-grams of two blanks say; repeated
    rows give repeated results, an empty table an empty one; other columns are not read.
    """
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, offset = shared.value
        mark = np.zeros(BUCKETS, bool)
        for batch in slices(batches, "text"):
            out = np.empty(batch.num_rows)
            for i, t in enumerate(texts(batch.column("text"))):
                found = grams(t, mark)
                out[i] = offset + (weight[found].sum(dtype=np.float64) / np.sqrt(len(found)) if len(found) else 0.0)
            out = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return source.mapInArrow(run, "doc_id bigint, score double, predicted int")


def held_out(column: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether the id's checksum falls into the fold that learning leaves out."""
    return F.pmod(id_crc(column), F.lit(folds)) == fold
