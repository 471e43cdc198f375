"""Refinement results mapped back onto frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import basename, name_key, stem

MIN_ALIAS = 4


def group_aliases(groups: DataFrame) -> DataFrame:
    """One row per ``group_id`` and usable alias of its label and pattern names."""
    raw = F.concat(
        F.array(F.coalesce(F.col("label"), F.lit(""))),
        F.flatten(F.transform(
            F.filter(F.coalesce(F.col("patterns"), F.array().cast("array<string>")),
                     lambda p: ~F.lower(stem(p)).endswith("_q")),
            lambda p: F.array(basename(p), stem(p)))))
    keys = F.array_distinct(F.filter(F.transform(raw, name_key), lambda k: F.length(k) >= MIN_ALIAS))
    return groups.select("group_id", F.explode(keys).alias("alias"))


def match_groups(histograms: DataFrame, groups: DataFrame) -> DataFrame:
    """Group whose longest alias occurs in the histogram name.

    Containment becomes an equi-join by spelling out the substrings of the
    (short) histogram key, of the lengths that aliases have.  Two groups tied at the
    longest alias set ``ambiguous``.  Names and groups grow with the series, so no side is broadcast.
    """
    aliases = group_aliases(groups)
    key = name_key(F.col("name"))
    lengths = aliases.select(F.length("alias").alias("n")).distinct().agg(F.collect_set("n")).scalar()
    pieces = (histograms.select("name").distinct().select("name", key.alias("_key"))
              .withColumn("_lens", lengths)
              .select("name", "_key", F.explode(F.filter("_lens", lambda n: n <= F.length("_key"))).alias("_len"))
              .select("name", "_key", "_len", F.explode(F.sequence(F.lit(1), F.length("_key") - F.col("_len") + 1)).alias("_at"))
              .select("name", F.substr("_key", "_at", "_len").alias("alias")))
    hits = pieces.join(aliases.hint("merge"), "alias").groupBy("name", "group_id").agg(F.max(F.length("alias")).alias("length"))
    ranked = hits.groupBy("name", "length").agg(F.max("group_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    best = ranked.groupBy("name").agg(F.max(F.struct("length", "group_id", "n")).alias("_best"))
    return best.select("name", F.col("_best.group_id").alias("group_id"), (F.col("_best.n") > 1).alias("ambiguous"))


def frame_results(histograms: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Replicate each histogram's result to the frames it stands for.

    ``members`` is ``group_id, frame``.  A name without a group falls back to the
    number behind the word frame.  A name tied between groups stands for no frame: it
    has one row with ``ambiguous`` set and a null frame.
    """
    mapped = match_groups(histograms, groups)
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    # Estimates of exploded and aggregated sides come out too small, so the joins are told not to broadcast.
    by_group = (histograms.join(mapped.where(~F.col("ambiguous")).hint("merge"), "name")
                .join(sizes.hint("merge"), "group_id").join(members.hint("merge"), "group_id").drop("ambiguous"))
    number = F.regexp_extract(F.col("name"), r"(?i)frame[^0-9]*(\d+)", 1).try_cast("long")
    rest = (histograms.join(mapped.select("name").hint("merge"), "name", "left_anti")
            .withColumn("frame", number).where(F.col("frame").isNotNull())
            .withColumn("group_size", F.lit(1).cast("long")))
    clear = by_group.drop("group_id").unionByName(rest).withColumn("ambiguous", F.lit(False))
    tied = histograms.join(mapped.where("ambiguous").select("name", "ambiguous").hint("merge"), "name")
    return clear.unionByName(tied, allowMissingColumns=True)


def explode_phases(results: DataFrame, phase_map: Mapping[str, str]) -> DataFrame:
    """One row per frame and phase out of the ``phases`` map, names translated."""
    name = F.col("_external")
    for external, internal in phase_map.items():
        name = F.when(F.col("_external") == external, F.lit(internal)).otherwise(name)
    return (results.select("*", F.explode("phases").alias("_external", "weight_fraction"))
            .withColumn("phase", F.trim(name)).drop("_external", "phases")
            .where(F.col("weight_fraction").isNotNull()))


def fraction_checks(exploded: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Frames whose fractions do not add up, or that name a phase twice."""
    return (exploded.groupBy("frame")
            .agg(F.sum("weight_fraction").alias("total"),
                 (F.count("phase") - F.count_distinct("phase")).alias("duplicates"))
            .where((F.abs(F.col("total") - 1) > tolerance) | (F.col("duplicates") > 0)))
