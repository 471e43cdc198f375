"""Candidate ranking on a common d-grid and its scorecards."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import eos
from .background import DOUBLES, block_to_rows, rows_to_block
from .ordered import with_rank, with_running_sum_by_range

# The default d-grid in angstrom.
D_MIN, D_MAX, N_POINTS = 1.199, 8.853, 3501

#: Squared distance in half widths from which a Gaussian is zero in doubles.
GAUSS_REACH = 1080.0


def d_grid(d_min: float = D_MIN, d_max: float = D_MAX, n: int = N_POINTS) -> np.ndarray:
    return np.linspace(d_min, d_max, n)


def resample_to_d(values: Column, axis_d: Sequence[float], grid: Sequence[float], *, clip: bool = True,
                  normalize: bool = True) -> Column:
    """Pattern rows linearly interpolated onto a d-grid, zero outside their range."""
    d = np.asarray(axis_d, float)
    order = np.argsort(d)
    target = np.asarray(grid, float)

    @F.pandas_udf(DOUBLES)
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out: list = [None] * len(rows)
            for where, block in rows_to_block(rows):
                data = np.nan_to_num(block[:, order], nan=0.0)
                result = np.stack([np.interp(target, d[order], row, left=0.0, right=0.0) for row in data])
                if clip:
                    result = np.clip(result, 0, None)
                if normalize:
                    top = result.max(axis=1, keepdims=True)
                    result = result / np.where(top > 0, top, 1.0)
                block_to_rows(out, where, result)
            yield pd.Series(out, dtype=object)
    return kernel(values)


def candidate_pressures(pressure: Column, p_max: Column, movable: Column, grid: Sequence[float]) -> Column:
    """Pressures a candidate is tried at: the prior, else a clamped grid, else ambient."""
    scan = F.sort_array(F.array_distinct(F.transform(F.array(*[F.lit(float(g)) for g in grid]),
                                                     lambda g: eos.clamp_to_validity(g, p_max))))
    return (F.when(pressure.isNotNull(), F.array(eos.clamp_to_validity(pressure, p_max)))
            .when(movable, scan).otherwise(F.array(F.lit(0.0))))


def fwhm_on_grid(d: Column, fwhm_d: float = 0.03, fwhm_q: float | None = None) -> Column:
    return F.lit(fwhm_d) if fwhm_q is None else d * d * F.lit(fwhm_q) / (2 * math.pi)


def simulate(centers: np.ndarray, weights: np.ndarray, widths: np.ndarray, grid: np.ndarray, eta: float = 0.5,
             normalize: bool = True) -> np.ndarray:
    """Sum of pseudo-Voigt lines on the grid."""
    z = grid[:, None] - centers
    z *= 2
    z /= widths
    z *= z
    shape = eta / (1 + z)
    if eta != 1:
        # Further out the exponential is zero in doubles, and slow.
        close = z < GAUSS_REACH
        shape[close] += (1 - eta) * np.exp(-math.log(2) * z[close])
    shape *= weights
    y = shape.sum(axis=1)
    top = y.max(initial=0.0)
    return y / top if normalize and top > 0 else y


def simulated_patterns(states: DataFrame, grid: Sequence[float], *, fwhm_d: float = 0.03,
                       fwhm_q: float | None = None, eta: float = 0.5) -> DataFrame:
    """One simulated row per state; a state carries its predicted ``centers`` and ``weights``."""
    target = np.asarray(grid, float)

    @F.pandas_udf(DOUBLES)
    def kernel(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for centers, weights in batches:
            out = []
            for c, w in zip(centers, weights):
                c, w = np.asarray(c, float), np.asarray(w, float)
                good = np.isfinite(c) & (c > 0)
                width = np.full(good.sum(), fwhm_d) if fwhm_q is None else c[good] ** 2 * fwhm_q / (2 * math.pi)
                out.append(simulate(c[good], w[good], width, target, eta).tolist())
            yield pd.Series(out, dtype=object)
    return states.withColumn("simulated", kernel("centers", "weights"))


@F.pandas_udf(T.DoubleType())
def cosine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Cosine of two equal-length array columns, 0 when a norm is 0."""
    for left, right in batches:
        a, b = np.stack([np.asarray(v, float) for v in left]), np.stack([np.asarray(v, float) for v in right])
        norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        yield pd.Series(np.where(norm > 0, (a * b).sum(axis=1) / np.where(norm > 0, norm, 1.0), 0.0))


def pair_with_library(frames: DataFrame, library: DataFrame) -> DataFrame:
    """Every frame against every candidate of a library, as an equi-join on a slot number.

    The work of trying each candidate on each frame is the operator itself; the
    library side is a few rows, which adaptive execution broadcasts by its
    measured size and shuffles otherwise.
    """
    hashed = library.withColumn("_h", F.pmod(F.xxhash64("phase"), F.lit(64)))
    slots = with_rank(hashed, [], ["_h", "phase"], "_h", 1.0, "_slot").drop("_h")
    count = library.groupBy().count().scalar()
    return (frames.withColumn("_n", count).where(F.col("_n") > 0)
            .withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
            .join(slots, "_slot").drop("_slot"))


def best_scores(scored: DataFrame) -> DataFrame:
    """Best score and its pressure per frame and phase; the lowest pressure wins ties."""
    best = F.max_by(F.struct("score", "pressure"), F.struct("score", -F.col("pressure")))
    return scored.groupBy("frame", "phase").agg(best.alias("b")).select("frame", "phase", "b.score", "b.pressure")


def top_candidates(scores: DataFrame, k: int) -> DataFrame:
    """Top ``k`` phases per frame by score, name order on ties."""
    order = Window.partitionBy("frame").orderBy(F.desc("score"), "phase")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shortlist(top: DataFrame) -> DataFrame:
    return top.select("phase").distinct()


def rank_metrics(scores: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hit@1, hit@k and mean reciprocal rank over frames with a known label (one row)."""
    order = Window.partitionBy("frame").orderBy(F.desc("score"), "phase")
    ranked = scores.withColumn("rank", F.row_number().over(order)).join(truth, ["frame", "phase"], "left_semi")
    best = ranked.groupBy("frame").agg(F.min("rank").alias("rank"))
    return best.groupBy().agg(
        F.count(F.lit(1)).alias("n_scored"), F.avg((F.col("rank") == 1).cast("double")).alias("hit_at_1"),
        F.avg((F.col("rank") <= k).cast("double")).alias("hit_at_k"), F.avg(1 / F.col("rank")).alias("mrr"))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by the rank statistic, ties counted half (one row).

    Scores are first counted per distinct value, so ranks come from a running sum.
    """
    counted = rows.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(label) > 0.5).alias("p"), F.count_if(F.col(label) <= 0.5).alias("n"))
    below = with_running_sum_by_range(counted, [F.col(score)], F.col("n"), "_below")
    won = F.sum(F.col("p") * (F.col("_below") - F.col("n") / 2))
    return below.groupBy().agg(F.try_divide(won, F.sum("p") * F.sum("n")).alias("auc"),
                               F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))


def labelled_matrix(patterns: DataFrame, channels: Sequence[str], axis_d: Sequence[float], grid: Sequence[float], identified: DataFrame,
                    good: DataFrame, *, seen: float = 0.5, normalize: bool = True) -> DataFrame:
    """``frame, channel, x, labels, n_good``: every kept pattern on the d-grid with its weak labels.

    ``patterns`` is ``frame`` and a column per channel, and may have ``excluded``: such frames are left out.
    ``identified`` is ``frame, phase, confidence, pressure``; a frame's ``labels`` are its phases in name order as
    ``phase, present, pressure``, present from a confidence of ``seen`` on, as many as were judged on it.
    ``n_good`` counts the rows of ``good`` (``frame``).  Patterns stay where they are; only labels and counts are shuffled to them.
    """
    kept = patterns.where(~F.coalesce("excluded", F.lit(False))) if "excluded" in patterns.columns else patterns
    label = F.struct("phase", (F.col("confidence") >= seen).alias("present"), "pressure")
    labels = identified.groupBy("frame").agg(F.sort_array(F.collect_set(label)).alias("labels"))
    counts = good.groupBy("frame").agg(F.count(F.lit(1)).alias("n_good"))
    none = F.array().cast(labels.schema["labels"].dataType)
    rows = kept.select("frame", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("y")) for c in channels])).alias("c"))
    made = rows.select("frame", "c.channel", resample_to_d(F.col("c.y"), axis_d, grid, normalize=normalize).alias("x"))
    return made.join(labels, "frame", "left").join(counts, "frame", "left").select(
        "frame", "channel", "x", F.coalesce("labels", none).alias("labels"), F.coalesce("n_good", F.lit(0)).alias("n_good"))


def with_split(rows: DataFrame, shares: dict[str, float], key: str = "frame", seed: str = "split") -> DataFrame:
    """Add ``split``: a name of ``shares`` by a hash of the key, so all rows of a key and all reruns agree."""
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
    whole, until, split = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        until += share / whole
        split = F.when(spot < until, name) if split is None else split.when(spot < until, name)
    return rows.withColumn("split", F.coalesce(split, F.lit(name)))


def write_matrix(rows: DataFrame, path: str, shares: dict[str, float] | None = None) -> None:
    """Write a labelled matrix as Parquet, a folder per split and channel."""
    with_split(rows, shares or {"train": 0.8, "valid": 0.1, "test": 0.1}).write.partitionBy("split", "channel").parquet(path)
