"""Seeded simulated patterns: one generator per sample id, never per partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import spread, task_count
from .ranking import simulate

#: Salts per task that samples are dealt to.
SALTS = 8


@dataclass(frozen=True)
class Augment:
    """Ranges of the per-pattern variation (uniform unless noted)."""

    # Default ranges.
    fwhm_q: tuple = (0.008, 0.03)
    eta: tuple = (0.2, 0.8)
    drop: tuple = (0.0, 0.4)
    jitter: float = 0.3
    d_offset: float = 0.003
    spikes: tuple = (0, 3)
    spike_height: tuple = (0.2, 1.0)
    spike_width: tuple = (0.008, 0.02)
    humps: tuple = (1, 3)
    hump_height: tuple = (0.05, 0.35)
    hump_width: tuple = (0.06, 0.25)
    noise: tuple = (0.0, 0.05)
    truncate: tuple = (0.0, 0.3)


def textured(rng: np.random.Generator, grid, centers, weights, widths, eta: float, drop: float, jitter: float) -> np.ndarray:
    """Lines with some dropped and the rest scattered in intensity."""
    inside = (centers >= grid[0]) & (centers <= grid[-1])
    keep = np.ones(centers.size, bool)
    lost = int(round(drop * centers.size))
    if lost:
        keep[rng.permutation(centers.size)[:lost]] = False
    weights = weights * rng.lognormal(0.0, jitter, centers.size) if jitter > 0 else weights
    use = keep & inside
    return simulate(centers[use], weights[use], widths[use], grid, eta, normalize=False)


def with_humps(rng: np.random.Generator, y, grid, cfg: Augment) -> np.ndarray:
    n = int(rng.integers(cfg.humps[0], cfg.humps[1] + 1))
    middle = rng.uniform(grid[0], grid[-1], n)
    width = np.maximum(rng.uniform(*cfg.hump_width, n) * (grid[-1] - grid[0]), 1e-6)
    height = rng.uniform(*cfg.hump_height, n) * (y.max() or 1.0)
    return y + (height * np.exp(-0.5 * ((grid[:, None] - middle) / width) ** 2)).sum(axis=1)


def with_spikes(rng: np.random.Generator, y, grid, cfg: Augment) -> np.ndarray:
    n = int(rng.integers(cfg.spikes[0], cfg.spikes[1] + 1))
    middle = rng.uniform(grid[0], grid[-1], n)
    height = rng.uniform(*cfg.spike_height, n) * (y.max() or 1.0)
    return y + simulate(middle, height, rng.uniform(*cfg.spike_width, n), grid, 1.0, normalize=False)


def truncated(rng: np.random.Generator, y, cfg: Augment) -> np.ndarray:
    low, high = (rng.uniform(*cfg.truncate, 2) * y.size).astype(int)
    out = y.copy()
    out[:low] = 0
    out[y.size - high:] = 0
    return out


def with_noise(rng: np.random.Generator, y, cfg: Augment) -> np.ndarray:
    sigma = rng.uniform(*cfg.noise)
    return y + rng.normal(0.0, sigma * (y.max() or 1.0), y.size) if sigma > 0 else y


def augmented(rng: np.random.Generator, grid, centers, weights, cfg: Augment) -> np.ndarray:
    """One varied pattern of the lines ``centers, weights``, scaled to maximum 1."""
    fwhm_q, eta = rng.uniform(*cfg.fwhm_q), rng.uniform(*cfg.eta)
    shifted = grid / (1 + rng.uniform(-cfg.d_offset, cfg.d_offset))
    y = textured(rng, shifted, centers, weights, centers ** 2 * fwhm_q / (2 * np.pi), eta, rng.uniform(*cfg.drop), cfg.jitter)
    y = truncated(rng, with_spikes(rng, with_humps(rng, y, grid, cfg), grid, cfg), cfg)
    y = np.clip(with_noise(rng, y, cfg), 0, None)
    return y / y.max() if y.max() > 0 else y


def augmented_patterns(samples: DataFrame, shapes: DataFrame, grid: Sequence[float], seed: int = 0, cfg: Augment = Augment()) -> DataFrame:
    """``id, phase, pattern`` for rows of ``id, phase``; repeatable for any partitioning.

    ``shapes`` is ``phase, centers, weights``.  Samples are dealt to salts by a hash of their id, each of which gets the
    shapes once; a salt is streamed phase by phase with one shape in memory, so no lines travel with
    a sample and a phase that most samples share is spread over all tasks.
    """
    target = np.asarray(grid, float)
    salts = SALTS * task_count(samples.sparkSession)
    none = F.lit(None).cast("array<double>")
    rows = samples.select(F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_salt"), "phase", F.lit(1).alias("_kind"), "id", none.alias("centers"), none.alias("weights"))
    lines = shapes.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), "phase", F.lit(0).alias("_kind"),
                          F.lit(None).cast(samples.schema["id"].dataType).alias("id"), F.col("centers").cast("array<double>").alias("centers"), F.col("weights").cast("array<double>").alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = centers = weights = None
        for batch in batches:
            kept, made = [], []
            for i, (salt, phase, kind, one) in enumerate(zip(*[batch[c].to_pylist() for c in ("_salt", "phase", "_kind", "id")])):
                if kind == 0:
                    now, centers, weights = (salt, phase), *[np.asarray(batch[c][i].as_py(), float) for c in ("centers", "weights")]
                elif (salt, phase) == now:
                    kept.append(i)
                    made.append(augmented(np.random.default_rng([seed, one]), target, centers, weights, cfg))
            flat = np.concatenate(made) if made else np.zeros(0)
            places = pa.array(np.arange(len(made) + 1) * target.size, pa.int32())
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["phase"].take(at), pa.ListArray.from_arrays(places, pa.array(flat))], names=["id", "phase", "pattern"])

    schema = T.StructType([samples.schema["id"], samples.schema["phase"], T.StructField("pattern", T.ArrayType(T.DoubleType()))])
    return spread(rows.unionByName(lines), "_salt").sortWithinPartitions("_salt", "phase", "_kind").mapInArrow(run, schema)


def scoring_pairs(samples: DataFrame, library: DataFrame, wrong_offset: float = 10.0) -> DataFrame:
    """Positive, wrong-pressure and absent-phase candidates of each mixture.

    ``samples`` is ``id, phase, pressure`` (one row per present phase) and
    ``library`` is ``phase, p_max, slot`` with slots ``0..n-1``.  Choices are
    hashes of the sample id.
    """
    n = library.groupBy().count().scalar()
    ceiling = F.when(F.col("p_max") > 0, F.col("p_max")).otherwise(100.0)
    rows = samples.join(library, "phase")
    sign = F.when(F.pmod(F.xxhash64("id", F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    wrong = F.least(F.greatest(F.col("pressure") + sign * wrong_offset, F.lit(0.0)), ceiling)
    positive = rows.select("id", "phase", "pressure", F.lit(1).alias("label"), F.lit("present").alias("kind"))
    shifted = rows.where(F.abs(wrong - F.col("pressure")) >= wrong_offset / 2).select(
        "id", "phase", wrong.alias("pressure"), F.lit(0).alias("label"), F.lit("wrong_pressure").alias("kind"))
    first = rows.groupBy("id").agg(F.min("slot").alias("lowest"), F.count(F.lit(1)).alias("k"), F.min("pressure").alias("pressure"))
    guess = first.withColumn("_n", n).withColumn(
        "slot", F.pmod(F.col("lowest") + 1 + F.pmod(F.xxhash64("id", F.lit("absent")), F.col("_n") - 1), F.col("_n"))).drop("_n")
    absent = (guess.join(library, "slot").join(samples.select("id", "phase"), ["id", "phase"], "left_anti")
              .select("id", "phase", F.least("pressure", ceiling).alias("pressure"), F.lit(0).alias("label"), F.lit("absent").alias("kind")))
    return positive.unionByName(shifted).unionByName(absent)
