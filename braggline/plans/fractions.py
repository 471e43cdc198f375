"""Phase-fraction queries."""

from pyspark.sql import functions as F

from ..operators import fractions as op
from ..sources.tables import cte, view
from .registry import query

RIR = {"ECONOMY": 2.0, "PROMO": 4.0, "SMALL": -1.0}

SHARES = cte("peaks") + """
, sums as (select frame, phase, sum(area / {weight}) as area from peaks
  where flag = 0 and phase <> '' {gate} group by frame, phase)
, shares as (select frame, phase, area, area / sum(area) over (partition by frame) as fraction from sums)
"""


@query("phase_fractions", SHARES.format(weight="1", gate="") +
       "select frame, phase, round(area, 4) as area, round(fraction, 8) as fraction from shares")
def phase_fractions(spark, folder):
    return op.phase_fractions(view(spark, folder, "peaks")).select(
        "frame", "phase", F.round("area", 4).alias("area"), F.round("fraction", 8).alias("fraction"))


@query("phase_fractions_rir", SHARES.format(
    weight="case phase when 'ECONOMY' then 2.0e0 when 'PROMO' then 4.0e0 else 1.0e0 end", gate="") +
    "select frame, phase, round(fraction, 8) as fraction from shares")
def phase_fractions_rir(spark, folder):
    return op.phase_fractions(view(spark, folder, "peaks"), rir=RIR).select(
        "frame", "phase", F.round("fraction", 8).alias("fraction"))


@query("phase_fractions_gated", cte("peaks") + """
, conf as (select frame, phase, max(1 - fwhm * 8) as confidence from peaks where phase <> '' and phase <> 'PROMO' group by 1, 2)
, sums as (select p.frame, p.phase, sum(area) as area from peaks p left join conf c on p.frame = c.frame and p.phase = c.phase
  where flag = 0 and p.phase <> '' and (p.phase = 'PROMO' or c.confidence > 0.5) group by 1, 2)
select frame, phase, round(area / sum(area) over (partition by frame), 8) as fraction from sums""")
def phase_fractions_gated(spark, folder):
    peaks = view(spark, folder, "peaks")
    identified = (peaks.where((F.col("phase") != "") & (F.col("phase") != "PROMO"))
                  .groupBy("frame", "phase").agg(F.max(1 - F.col("fwhm") * 8).alias("confidence")))
    return op.phase_fractions(peaks, identified=identified, min_confidence=0.5).select(
        "frame", "phase", F.round("fraction", 8).alias("fraction"))


@query("phase_fractions_dense", (cte("frames", "peaks") + SHARES[len(cte("peaks")):]).format(weight="1", gate="") +
       "select f.frame, s.phase, round(s.fraction, 8) as fraction from frames f left join shares s on f.frame = s.frame")
def phase_fractions_dense(spark, folder):
    shares = op.phase_fractions(view(spark, folder, "peaks"))
    return op.dense(shares, view(spark, folder, "frames")).select(
        "frame", "phase", F.round("fraction", 8).alias("fraction"))


@query("fraction_summary", SHARES.format(weight="1", gate="") + """
select phase, round(avg(fraction), 8) as mean_fraction, round(max(fraction), 8) as max_fraction,
  count(*) filter (where fraction > 0.05) as n_present from shares group by phase""")
def fraction_summary(spark, folder):
    out = op.fraction_summary(op.phase_fractions(view(spark, folder, "peaks")))
    return out.select("phase", F.round("mean_fraction", 8).alias("mean_fraction"),
                      F.round("max_fraction", 8).alias("max_fraction"), "n_present")
