"""Pattern signal: background, robust statistics, channel algebra, inspection."""

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..operators import background as bg
from ..operators import review
from ..sources.tables import RADIAL_START, RADIAL_STEP, bins, cte, patterns, view
from .registry import query

B = cte("bins")


def exploded(df, channel, digits, name, *keep):
    return (df.select("frame", *keep, F.posexplode(channel).alias("bin", "_v"))
            .select("frame", *keep, "bin", F.round("_v", digits).alias(name)))


@query("mad_sigma", B + """
, m as (select frame, clean, median(clean) over (partition by frame) as md from bins)
select frame, round(1.4826 * median(abs(clean - md)), 8) as sigma from m group by frame""")
def mad_sigma(spark, folder):
    return patterns(spark, folder).select("frame", F.round(ar.array_mad_sigma(F.col("clean")), 8).alias("sigma"))


NOISE = """
, dif as (select frame, masked - lag(masked) over (partition by frame order by bin) as d from bins)
, dm as (select frame, d, median(d) over (partition by frame) as md from dif where d is not null)
, ns as (select frame, 1.4826 * median(abs(d - md)) / sqrt(2) as s from dm group by frame having count(*) >= 3)
"""


@query("noise_floor", B + NOISE + "select round(median(s), 8) as noise_floor, count(*) as n_frames from ns")
def noise_floor(spark, folder):
    rows = patterns(spark, folder).select(bg.first_difference_sigma(F.col("masked")).alias("s"))
    return bg.exact_quantiles(rows, "s", [0.5]).select(
        F.round("q0", 8).alias("noise_floor"), F.col("n").alias("n_frames"))


SIGNIFICANT = """
, st as (select frame, clean, mean - robust + clean as total, median(clean) over w as mc, median(mean - robust + clean) over w as mt from bins window w as (partition by frame))
, ms as (select frame, mc, mt, 1.4826 * median(abs(clean - mc)) as sc, 1.4826 * median(abs(total - mt)) as s2 from st group by frame, mc, mt)
, cn as (select st.frame, count(*) filter (where clean > st.mc + 3 * sc and sc > 0) as n_clean, count(*) filter (where total > st.mt + 3 * s2 and s2 > 0) as n_mean
  from st join ms on st.frame = ms.frame group by st.frame)
"""


@query("significant_bins", B + SIGNIFICANT + "select frame, n_clean, n_mean from cn")
def significant_bins(spark, folder):
    p = patterns(spark, folder).withColumn("spots", bg.spot_residual(F.col("mean"), F.col("robust")))
    total = F.zip_with("clean", "spots", lambda a, b: a + b)
    return p.select("frame", bg.significant_bins(F.col("clean"), 3.0).cast("long").alias("n_clean"),
                    bg.significant_bins(total, 3.0).cast("long").alias("n_mean"))


@query("signal_diagnosis", B + SIGNIFICANT + """
select round(median(n_clean / n_mean), 8) as signal_frac_clean, median(n_clean / n_mean) < 0.5 as spotty_sample,
 count(*) as n_frames_used from cn where n_mean >= 3""")
def signal_diagnosis(spark, folder):
    p = patterns(spark, folder).withColumn("spots", bg.spot_residual(F.col("mean"), F.col("robust")))
    out = bg.signal_diagnosis(p, F.col("clean"), F.col("spots"), 3.0)
    return out.withColumn("signal_frac_clean", F.round("signal_frac_clean", 8))


@query("contamination", B + "select frame, round(sum(greatest(mean - robust, 0)), 6) as contamination from bins group by frame")
def contamination(spark, folder):
    return patterns(spark, folder).select("frame", F.round(
        bg.contamination(bg.spot_residual(F.col("mean"), F.col("robust"))), 6).alias("contamination"))


SNIP = """
, lists as (select frame, list({value} order by bin) as w from bins group by frame)
, sweep as (select frame, 0 as m, w from lists
  union all select frame, m + 1, list_transform(w, lambda x, i: least(x, (w[greatest(i - m - 1, 1)] + w[least(i + m + 1, 64)]) / 2)) from sweep where m < {top})
, base as (select frame, unnest(range(0, 64)) as bin, unnest(w) as z from sweep where m = {top})
"""
LLS_VALUE = "ln(ln(sqrt(greatest(robust, 0) + 1) + 1) + 1)"


@query("snip_baseline", B.replace("with ", "with recursive ", 1) + SNIP.format(value=LLS_VALUE, top=40) + """
select b.frame, b.bin::int as bin, round(least(pow(exp(exp(z) - 1) - 1, 2) - 1, robust), 5) as baseline
from base b join bins s on b.frame = s.frame and b.bin = s.bin""")
def snip_baseline(spark, folder):
    p = patterns(spark, folder).withColumn("baseline", bg.snip_baseline(F.col("robust")))
    return exploded(p, "baseline", 5, "baseline")


@query("snip_baseline_linear", B.replace("with ", "with recursive ", 1) + SNIP.format(value="robust", top=12) + """
select b.frame, b.bin::int as bin, round(least(z, robust), 6) as baseline
from base b join bins s on b.frame = s.frame and b.bin = s.bin""")
def snip_baseline_linear(spark, folder):
    p = patterns(spark, folder).withColumn("baseline", bg.snip_baseline(F.col("robust"), 12, 1, False))
    return exploded(p, "baseline", 6, "baseline")


@query("separate_background", B.replace("with ", "with recursive ", 1) + SNIP.format(value=LLS_VALUE, top=40) + """
select s.frame, round(sum(robust - least(pow(exp(exp(z) - 1) - 1, 2) - 1, robust)), 4) as clean_sum,
  round(sum(greatest(mean - robust, 0)), 4) as contamination, sum(greatest(mean - robust, 0)) > 120 as flagged
from base b join bins s on b.frame = s.frame and b.bin = s.bin group by s.frame""")
def separate_background(spark, folder):
    out = bg.separate_background(patterns(spark, folder), threshold=120.0)
    return out.select("frame", F.round(ar.array_sum(F.col("clean")), 4).alias("clean_sum"),
                      F.round("contamination", 4).alias("contamination"), "flagged")


PARAMS = NOISE + """
, par as (select scale, nf, greatest(pow(nf / scale, 2), 1e-12) as eps from
  (select quantile_cont(masked, 0.995) as scale from bins where masked > 0) a, (select median(s) as nf from ns) b)
, z as (select frame, bin::int as bin, greatest({low}, least(1, masked / scale)) as z, eps, masked from bins, par)
, ls as (select frame, bin, case when masked is null then null when abs(z) >= 1 then 1 else greatest(0, least(1, ln(1 + z * z / eps) / ln(1 + 1 / eps))) end as v from z)
"""


@query("log_squared_parameters", B + PARAMS.format(low=0) +
       "select round(scale, 6) as scale, round(nf, 6) as noise_floor, round(eps, 9) as epsilon from par")
def log_squared_parameters(spark, folder):
    out = bg.transform_parameters(patterns(spark, folder), "masked")
    return out.select(F.round("scale", 6).alias("scale"), F.round("noise_floor", 6).alias("noise_floor"),
                      F.round("epsilon", 9).alias("epsilon"))


@query("log_squared", B + PARAMS.format(low=0) + "select frame, bin, round(v, 7) as value from ls")
def log_squared(spark, folder):
    p = patterns(spark, folder)
    return exploded(bg.log_squared(p, "masked", bg.transform_parameters(p, "masked")), "transformed", 7, "value")


@query("log_squared_signed", B + PARAMS.format(low=-1) + "select frame, bin, round(v, 7) as value from ls")
def log_squared_signed(spark, folder):
    p = patterns(spark, folder)
    out = bg.log_squared(p, "masked", bg.transform_parameters(p, "masked"), signed=True)
    return exploded(out, "transformed", 7, "value")


@query("frame_values_roi", B + """
select frame, round(sum(clean), 6) as total, round(max(clean), 6) as peak, round(sum(clean) filter (where radial between 1.5 and 2.52), 6) as roi_total,
  round(max(clean) filter (where radial between 1.5 and 2.52), 6) as roi_peak from bins group by frame""")
def frame_values_roi(spark, folder):
    low = F.lit(int((1.5 - RADIAL_START) / RADIAL_STEP + 1))
    roi = F.slice("clean", low, F.lit(int((2.52 - 1.5) / RADIAL_STEP) + 1))
    return patterns(spark, folder).select(
        "frame", F.round(ar.array_sum(F.col("clean")), 6).alias("total"), F.round(F.array_max("clean"), 6).alias("peak"),
        F.round(ar.array_sum(roi), 6).alias("roi_total"), F.round(F.array_max(roi), 6).alias("roi_peak"))


OPENING = """
, pos as (select frame, bin, clean, greatest(mean - robust + clean, 0) as p from bins)
, ero as (select *, min(p) over (partition by frame order by bin rows between 2 preceding and 2 following) as e from pos)
, ope as (select *, max(e) over (partition by frame order by bin rows between 2 preceding and 2 following) as o from ero)
"""


@query("winsorize_excess", B + OPENING + "select frame, bin::int as bin, round(o, 8) as excess from ope")
def winsorize_excess(spark, folder):
    p = patterns(spark, folder)
    spots = F.zip_with(bg.spot_residual(F.col("mean"), F.col("robust")), "clean", lambda a, b: a + b)
    return exploded(p.withColumn("x", bg.winsorize_excess(spots, 5)), "x", 8, "excess")


@query("fit_source_hybrid", B + OPENING + "select frame, bin::int as bin, round(clean + o, 8) as value, 'hybrid' as source from ope")
def fit_source_hybrid(spark, folder):
    p = patterns(spark, folder)
    spots = F.zip_with(bg.spot_residual(F.col("mean"), F.col("robust")), "clean", lambda a, b: a + b)
    channel, name = bg.fit_source("auto", F.col("clean"), spots)
    return exploded(p.withColumn("x", channel), "x", 8, "value").withColumn("source", F.lit(name))


@query("normalize_trace", B + """
, pad as (select frame, bin, coalesce(masked, 0) as y from bins union all select distinct frame, unnest([-2, -1, 64, 65]), 0 from bins)
, med as (select frame, bin, median(y) over (partition by frame order by bin rows between 2 preceding and 2 following) as f from pad)
, amp as (select frame, max(f) as a from med where bin between 0 and 63 group by frame)
, md as (select frame, masked, median(masked) over (partition by frame) as m from bins where masked is not null)
, noise as (select frame, 1.4826 * median(abs(masked - m)) as s from md group by frame)
select b.frame, b.bin::int as bin, round(greatest(masked, case when masked is null then null else 0 end) / greatest(a, 10 * s, 2.220446049250313e-16), 8) as value
from bins b join amp using (frame) join noise using (frame)""")
def normalize_trace(spark, folder):
    p = patterns(spark, folder).withColumn("x", F.transform(
        bg.normalize_trace(F.col("masked")), lambda x: x))
    zipped = p.withColumn("x", F.zip_with("x", "masked", lambda x, y: F.when(y.isNotNull(), x)))
    return exploded(zipped, "x", 8, "value")


@query("normalize_rows", B + "select frame, bin::int as bin, round(clean / max(clean) over (partition by frame), 8) as value from bins")
def normalize_rows(spark, folder):
    return exploded(patterns(spark, folder).withColumn("x", bg.normalize_rows(F.col("clean"))), "x", 8, "value")


@query("bin_medians", B + "select bin::int as bin, round(median(clean), 8) as median, count(*) as n from bins group by bin")
def bin_medians(spark, folder):
    return bg.bin_medians(bins(spark, folder, "clean"), "clean", ("bin",)).select(
        "bin", F.round("median", 8).alias("median"), "n")


@query("auto_fit_range")
def auto_fit_range(spark, folder):
    return bg.auto_fit_range(bg.bin_medians(bins(spark, folder, "robust"), "robust"))


@query("automatic_mask", cte("pixels") + """
select frame, count(*) as n_pixels, count(*) filter (where intensity - 30000 < 0 or intensity - 30000 = 0 or intensity - 30000 >= 50000) as n_masked from pixels group by frame""")
def automatic_mask(spark, folder):
    pixels = view(spark, folder, "pixels").withColumn("v", F.col("intensity") - 30000)
    return pixels.groupBy("frame").agg(F.count(F.lit(1)).alias("n_pixels"),
                                       F.count_if(bg.automatic_mask(F.col("v"), 50000.0)).alias("n_masked"))


@query("pixel_statistics", cte("pixels") + """
select count(*) as n, min(intensity) as min, round(quantile_cont(intensity, 0.01), 6) as p1, round(median(intensity), 6) as median,
 round(quantile_cont(intensity, 0.99), 6) as p99, max(intensity) as max, 0.0e0 as zeros, 0.0e0 as negatives from pixels""")
def pixel_statistics(spark, folder):
    out = review.pixel_statistics(view(spark, folder, "pixels"))
    return out.select("n", "min", F.round("p1", 6).alias("p1"), F.round("median", 6).alias("median"),
                      F.round("p99", 6).alias("p99"), "max", "zeros", "negatives")


@query("pattern_anomalies", B + """
, st as (select frame, count(masked) as f, count(*) as n, max(case when frame % 3 = 0 then masked - 30 else masked end) as mx from bins group by frame)
select frame, case when f = 0 then 'all-missing' when mx <= 0 then 'no-signal' when f / n < 0.5 then 'mostly-missing' end as anomaly from st""")
def pattern_anomalies(spark, folder):
    shift = F.when(F.col("frame") % 3 == 0, F.transform("masked", lambda x: x - 30)).otherwise(F.col("masked"))
    return patterns(spark, folder).select("frame", review.pattern_anomaly(shift).alias("anomaly"))


@query("inspection_sample", cte("frames") + """
, live as (select frame, row_number() over (order by frame) - 1 as position, count(*) over () as n from frames where not excluded)
select position, frame from live where position in (select floor(i * (n - 1) / 15)::bigint from (select unnest(range(0, 16)) as i, any_value(n) as n from live))""")
def inspection_sample(spark, folder):
    return review.spread_sample(view(spark, folder, "frames"), 16)


@query("contamination_outliers", cte("peaks") + """
, c as (select frame, sum(area) as v from peaks group by frame)
, m as (select median(v) as md from c), d as (select median(abs(v - md)) as mad from c, m)
select count(*) filter (where v > md + 5 * mad) as n_outliers from c, m, d""")
def contamination_outliers(spark, folder):
    frames = view(spark, folder, "peaks").groupBy("frame").agg(F.sum("area").alias("v"))
    return review.outlier_frames(frames, "v")


@query("analysis_summary", cte("peaks") + """
select count(*) as n_peaks, count(*) filter (where flag = 0) as n_good, count(*) filter (where flag <> 0) as n_flagged, count(distinct frame) as n_frames from peaks""")
def analysis_summary(spark, folder):
    return review.analysis_summary(view(spark, folder, "peaks"))


@query("good_peak_counts", cte("frames", "peaks") + """
select f.frame, count(p.frame) as n_good from frames f left join peaks p on p.frame = f.frame and p.flag = 0 group by f.frame""")
def good_peak_counts(spark, folder):
    return review.good_peak_counts(view(spark, folder, "frames"), view(spark, folder, "peaks"))


POLYGON = [(3.5, 2.25), (30.25, 5.5), (24.75, 40.5), (10.5, 30.25)]


@query("polygon_mask", cte("pixels") + """
, ed as (select * from (values (3.5e0, 2.25e0, 30.25e0, 5.5e0), (30.25e0, 5.5e0, 24.75e0, 40.5e0), (24.75e0, 40.5e0, 10.5e0, 30.25e0), (10.5e0, 30.25e0, 3.5e0, 2.25e0)) t(x0, y0, x1, y1))
, c as (select abin, rbin, sum(case when rbin >= least(y0, y1) and rbin < greatest(y0, y1) and abin < x0 + (rbin - y0) * ((x1 - x0) / (y1 - y0)) then 1 else 0 end) % 2 = 1 as inside from (select distinct abin, rbin from pixels), ed group by 1, 2)
select frame, count(*) filter (where inside) as n_masked, count(*) as n_pixels from pixels p join c on p.abin = c.abin and p.rbin = c.rbin group by frame""")
def polygon_mask(spark, folder):
    inside = bg.in_polygon(F.col("abin"), F.col("rbin"), POLYGON)
    return view(spark, folder, "pixels").groupBy("frame").agg(
        F.count_if(inside).alias("n_masked"), F.count(F.lit(1)).alias("n_pixels"))
