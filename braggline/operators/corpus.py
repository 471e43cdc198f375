"""Screening of structure entries: size limit and near-duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import sorted_stream
from .ordered import with_island


def screen(entries: DataFrame, *, max_sites: int = 200, tolerance: float = 0.005) -> DataFrame:
    """Add ``reason``: too many sites, or a volume within tolerance of an earlier kept entry.

    ``entries`` is ``file, formula, spacegroup, volume, n_sites``; earlier means
    by file name.  Entries whose volumes differ by more than the tolerance cannot
    affect each other, so each formula and space group is cut at such gaps along
    the logarithm of the volume; a piece is streamed in file order and remembers
    the kept volumes, which lie at least a tolerance apart.
    """
    big = F.col("n_sites") > max_sites
    usable = entries.where(~big).withColumn("_lv", F.log("volume"))
    pieces = with_island(usable, ["formula", "spacegroup"], ["_lv", "file"], "_lv", 0.25, tolerance * 1.01 + 1e-9, "_piece").drop("_lv")
    columns = [*pieces.columns, "reason"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for pdf in batches:
            reasons = []
            for key, v in zip(zip(pdf["formula"], pdf["spacegroup"], pdf["_piece"]), pdf["volume"]):
                if key != now:
                    now, kept = key, []
                near = any(abs(v - k) <= tolerance * max(v, k, 1e-9) for k in kept)
                if not near:
                    kept.append(v)
                reasons.append("duplicate" if near else None)
            yield pdf.assign(reason=reasons)[columns]

    schema = pieces.withColumn("reason", F.lit(None).cast("string")).schema
    done = sorted_stream(pieces, ["formula", "spacegroup", "_piece"], ["file"], step, schema).drop("_piece")
    return done.unionByName(entries.where(big).withColumn("reason", F.lit("too_big")))
