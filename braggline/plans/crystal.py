"""Axis conversions, equations of state, profiles and line lists."""

from pyspark.sql import functions as F

from ..functions import axis, eos, profiles as pf
from ..operators import matching
from ..sources.tables import base, cte, view
from .registry import query

WL = 0.4066


def rounded(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("radial_to_d", cte("peaks") + f"""
select peak_id, center, round(2 * pi() / center, 9) as d_q, round(2 * pi() / (center * 0.1), 7) as d_nm,
  round({WL} / (2 * sin(radians(center) / 2)), 7) as d_deg, round({WL} / (2 * sin(center / 20)), 8) as d_rad from peaks""")
def radial_to_d(spark, folder):
    c = F.col("center")
    return view(spark, folder, "peaks").select(
        "peak_id", "center", F.round(axis.radial_to_d(c, "q_A^-1"), 9).alias("d_q"),
        F.round(axis.radial_to_d(c, "q_nm^-1"), 7).alias("d_nm"),
        F.round(axis.radial_to_d(c, "2th_deg", WL), 7).alias("d_deg"),
        F.round(axis.radial_to_d(c / 10, "2th_rad", WL), 8).alias("d_rad"))


@query("radial_err_to_d_err", cte("peaks") + f"""
select peak_id, center, fwhm_err, round(2 * pi() / center * fwhm_err / center, 9) as err_q,
  round({WL} / (2 * sin(radians(center) / 2)) / tan(radians(center) / 2) * radians(fwhm_err) / 2, 7) as err_deg,
  case when rel_misfit > 0 then round(2 * pi() / center * rel_misfit / center, 9) end as err_zero from peaks""")
def radial_err_to_d_err(spark, folder):
    c = F.col("center")
    return view(spark, folder, "peaks").select(
        "peak_id", "center", "fwhm_err",
        F.round(axis.radial_error_to_d_error(c, F.col("fwhm_err"), "q"), 9).alias("err_q"),
        F.round(axis.radial_error_to_d_error(c, F.col("fwhm_err"), "2th_deg", WL), 7).alias("err_deg"),
        F.round(axis.radial_error_to_d_error(c, F.col("rel_misfit"), "q"), 9).alias("err_zero"))


@query("d_to_radial", cte("reflections") + f"""
select phase, ord, round(2 * pi() / d, 9) as q, round(20 * pi() / d, 8) as q_nm,
  round(degrees(2 * asin(least(1, {WL} / (2 * d)))), 8) as tth, round(degrees(2 * asin({WL} * d / (4 * pi()))), 8) as tth_from_q from reflections""")
def d_to_radial(spark, folder):
    d = F.col("d")
    return view(spark, folder, "reflections").select(
        "phase", "ord", F.round(axis.d_to_radial(d, "q"), 9).alias("q"), F.round(axis.d_to_radial(d, "q_nm"), 8).alias("q_nm"),
        F.round(axis.d_to_radial(d, "2th_deg", WL), 8).alias("tth"),
        F.round(axis.radial_to_two_theta(d, "q", WL), 8).alias("tth_from_q"))


@query("peaks_in_q", cte("peaks") + f"""
select peak_id, frame, center, fwhm, round(4 * pi() / {WL} * sin(radians(center) / 2), 8) as q,
 round(2 * pi() / {WL} * cos(radians(center) / 2) * radians(fwhm), 8) as dq from peaks where flag = 0 and fwhm > 0""")
def peaks_in_q(spark, folder):
    c, w = F.col("center"), F.col("fwhm")
    return view(spark, folder, "peaks").where("flag = 0 and fwhm > 0").select(
        "peak_id", "frame", "center", "fwhm", F.round(axis.to_q(c, "2th_deg", WL), 8).alias("q"),
        F.round(axis.width_to_q(c, w, "2th_deg", WL), 8).alias("dq"))


LATTICE_SQL = """
, lat as (select *, 3.0e0 + k0 / 100 as a, 3.5e0 + k0 / 120 as b, 4.0e0 + k0 / 90 as c, radians(85.0e0) as al, radians(95.0e0 + k0p) as be, radians(100.0e0) as ga from phases)
, g as (select *, 1 - cos(al)**2 - cos(be)**2 - cos(ga)**2 + 2 * cos(al) * cos(be) * cos(ga) as v from lat)
, ds as (select r.phase, r.ord, (h*h*sin(al)**2/(a*a) + k*k*sin(be)**2/(b*b) + l*l*sin(ga)**2/(c*c) + 2*h*k*(cos(al)*cos(be)-cos(ga))/(a*b)
  + 2*k*l*(cos(be)*cos(ga)-cos(al))/(b*c) + 2*h*l*(cos(al)*cos(ga)-cos(be))/(a*c)) / v as s from reflections r join g on r.phase = g.phase)
"""


def lattice_of(k0, k0p):
    return F.struct((3.0 + k0 / 100).alias("a"), (3.5 + k0 / 120).alias("b"), (4.0 + k0 / 90).alias("c"),
                    F.lit(85.0).alias("alpha"), (95.0 + k0p).alias("beta"), F.lit(100.0).alias("gamma"))


@query("d_from_lattice", cte("phases", "reflections") + LATTICE_SQL + """
select phase, ord, case when s > 0 then round(1 / sqrt(s), 8) end as d from ds""")
def d_from_lattice(spark, folder):
    phases = view(spark, folder, "phases").withColumn("lattice", lattice_of(F.col("k0"), F.col("k0p")))
    lines = view(spark, folder, "reflections").join(phases, "phase")
    return lines.select("phase", "ord", F.round(axis.d_from_lattice(
        F.col("h"), F.col("k"), F.col("l"), F.col("lattice")), 8).alias("d"))


EOS_SQL = """
, rows0 as (select peak_id, p.phase, k0, k0p, k0pp, p_max, alpha_v, 1.0e0 - fwhm as r,
   case when lower(eos_type) = 'vinet' then 'Vinet' when lower(eos_type) = 'bm2' then 'BM2' when eos_type = 'murn' then 'Murnaghan' when eos_type = 'BM4' then 'BM4' else 'BM3' end as kind
   from peaks p join phases h on p.phase = h.phase)
, strain as (select *, 0.5 * (pow(1 / r, 2.0/3) - 1) as f, pow(r, 1.0/3) as x from rows0)
, pres as (select *, case kind when 'Murnaghan' then k0 / k0p * (pow(1 / r, k0p) - 1) when 'Vinet' then 3 * k0 * (1 - x) / (x * x) * exp(1.5 * (k0p - 1) * (1 - x))
   when 'BM2' then 3 * k0 * f * pow(1 + 2 * f, 2.5) when 'BM3' then 3 * k0 * f * pow(1 + 2 * f, 2.5) * (1 + 1.5 * (k0p - 4) * f)
   else 3 * k0 * f * pow(1 + 2 * f, 2.5) * (1 + 1.5 * (k0p - 4) * f + 1.5 * (k0 * k0pp + (k0p - 4) * (k0p - 3) + 35.0/9) * f * f) end as p from strain)
"""


def compressed(spark, folder):
    # The label is settled once per phase, before it meets the peaks.
    phases = view(spark, folder, "phases").withColumn("eos_type", eos.normal_type(F.col("eos_type")))
    df = view(spark, folder, "peaks").join(phases, "phase").withColumn("r", 1.0 - F.col("fwhm"))
    return df.withColumn("p", eos.pressure(F.col("eos_type"), F.col("k0"), F.col("k0p"), F.col("k0pp"), F.col("r")))


@query("eos_pressure", cte("phases", "peaks") + EOS_SQL + "select peak_id, kind, r, round(p, 6) as p from pres")
def eos_pressure(spark, folder):
    return compressed(spark, folder).select(
        "peak_id", eos.normal_type(F.col("eos_type")).alias("kind"), "r", F.round("p", 6).alias("p"))


@query("eos_compression", cte("phases", "peaks") + EOS_SQL +
       "select peak_id, kind, round(r, 7) as r, round(pow(r, 1.0/3), 7) as scale from pres")
def eos_compression(spark, folder):
    df = compressed(spark, folder)
    law = F.struct(F.col("eos_type").alias("type"), F.col("k0").alias("K0"), F.col("k0p").alias("K0p"), F.col("k0pp").alias("K0pp"))
    df = df.withColumn("_r", eos.compression(F.col("eos_type"), F.col("k0"), F.col("k0p"), F.col("k0pp"), F.col("p")))
    return df.select("peak_id", eos.normal_type(F.col("eos_type")).alias("kind"), F.round("_r", 7).alias("r"),
                     F.round(eos.scale_of(F.col("_r"), law, F.col("p")), 7).alias("scale"))


@query("thermal_and_validity", cte("phases", "peaks", "frames") + """
select peak_id, round(pow(greatest(1 + alpha_v * (temperature - 298), 1e-6), 1.0/3), 10) as scale,
  case when pressure is not null then least(greatest(pressure - 1, 0), case when p_max > 0 then p_max else 'infinity'::double end) end as clamped
from peaks p join phases h on p.phase = h.phase join frames f on f.frame = p.frame""")
def thermal_and_validity(spark, folder):
    df = (view(spark, folder, "peaks").select("peak_id", "frame", "phase").join(view(spark, folder, "phases"), "phase")
          .join(view(spark, folder, "frames").select("frame", "temperature", "pressure"), "frame"))
    clamp = F.when(F.col("pressure").isNotNull(), eos.clamp_to_validity(F.col("pressure") - 1, F.col("p_max")))
    scale = eos.thermal_scale(F.col("alpha_v"), F.lit(None).cast("double"), F.col("temperature"))
    return df.select("peak_id", F.round(scale, 10).alias("scale"), clamp.alias("clamped"))


@query("axial_scales", cte("phases", "frames") + """
, ax as (select f.frame, f.pressure as p, h.phase, h.alpha_v from frames f join phases h on h.phase = case f.frame % 3 when 0 then 'ECONOMY' when 1 then 'PROMO' else 'SMALL' end where f.pressure is not null)
select frame, phase, round(case when p > 0 then exp(-1e-3 * p) else 1 end, 9) as a, round(case when p > 0 then exp(-1e-3 * p) else 1 end, 9) as b,
  round(case when p > 0 then exp(alpha_v * p) else 1 end, 9) as c, 'axial_eos' as model, 'eos_based' as assumption from ax""")
def axial_scales(spark, folder):
    def axis_of(beta):
        return F.struct(F.lit("BM3").alias("type"), F.lit(None).cast("double").alias("K0"), F.lit(None).cast("double").alias("K0p"),
                        F.lit(None).cast("double").alias("K0pp"), beta.alias("beta"))
    frames = view(spark, folder, "frames").where("pressure is not null").withColumn(
        "phase", F.element_at(F.array(F.lit("ECONOMY"), F.lit("PROMO"), F.lit("SMALL")), (F.col("frame") % 3 + 1).cast("int")))
    df = frames.join(view(spark, folder, "phases"), "phase")
    law = F.struct(F.col("eos_type").alias("type"), F.lit(None).cast("double").alias("K0"), F.col("k0p").alias("K0p"), F.col("k0pp").alias("K0pp"))
    axial = F.struct(axis_of(F.lit(-1e-3)).alias("a"), axis_of(F.lit(None).cast("double")).alias("b"), axis_of(F.col("alpha_v")).alias("c"))
    cell = F.struct(F.lit(3.0).alias("a"), F.lit(3.0).alias("b"), F.lit(5.0).alias("c"))
    model = eos.pressure_model(law, axial)
    df = df.withColumn("s", eos.axial_scales(law, axial, cell, F.col("pressure")))
    return df.select("frame", "phase", *[F.round(F.col("s")[k], 9).alias(k) for k in "abc"], model.alias("model"),
                     eos.pressure_assumption(F.lit("auto"), model).alias("assumption"))


@query("compress_lattice", cte("phases", "peaks") + EOS_SQL + """
select peak_id, round(3 * pow(r, 1.0/3), 6) as a, round(4 * pow(r, 1.0/3), 6) as b, round(case when p > 0 then 5 * exp(-1e-3 * p) else 5 end, 6) as c, 90.0::double as alpha from pres""")
def compress_lattice(spark, folder):
    # The a axis carries the modulus of the phase itself, b follows the volume, c an expansivity.
    law = F.struct(F.col("eos_type").alias("type"), F.col("k0").alias("K0"), F.col("k0p").alias("K0p"), F.col("k0pp").alias("K0pp"))
    none = F.lit(None).cast("double")

    def axis_of(k0, beta):
        return F.struct(F.col("eos_type").alias("type"), k0.alias("K0"), F.col("k0p").alias("K0p"), F.col("k0pp").alias("K0pp"), beta.alias("beta"))
    axial = F.struct(axis_of(F.col("k0"), none).alias("a"), axis_of(none, none).alias("b"), axis_of(none, F.lit(-1e-3)).alias("c"))
    cell = F.struct(*[F.lit(float(v)).alias(k) for k, v in (("a", 3), ("b", 4), ("c", 5), ("alpha", 90), ("beta", 90), ("gamma", 90))])
    df = compressed(spark, folder).withColumn("_l", eos.compress_lattice(law, axial, cell, F.col("p")))
    return df.select("peak_id", *[F.round(F.col("_l")[k], 6).alias(k) for k in "abc"], F.col("_l.alpha").alias("alpha"))


@query("eos_labels", cte("phases") + """
select phase, case when lower(eos_type) = 'vinet' then 'Vinet' when lower(eos_type) = 'bm2' then 'BM2' when eos_type = 'murn' then 'Murnaghan' when eos_type = 'BM4' then 'BM4' else 'BM3' end
 || ': K0=' || k0::string || ', K0''=' || k0p::string || case when eos_type = 'BM4' then ', K0''''=' || k0pp::string else '' end as label from phases""")
def eos_labels(spark, folder):
    law = F.struct(F.col("eos_type").alias("type"), F.col("k0").alias("K0"), F.col("k0p").alias("K0p"), F.col("k0pp").alias("K0pp"))
    return view(spark, folder, "phases").select("phase", eos.summary(law).alias("label"))


@query("pseudo_voigt", cte("peaks") + """
select peak_id, amplitude, fwhm, round(amplitude * (0.4 / (1 + z) + 0.6 * exp(-ln(2) * z)), 5) as value,
 round(amplitude * (0.4 * 0.5 * pi() * fwhm + 0.6 * sqrt(pi() / (4 * ln(2))) * fwhm), 5) as area
from (select *, pow(2 * 0.01 / fwhm, 2) as z from peaks) t""")
def pseudo_voigt(spark, folder):
    a, w = F.col("amplitude"), F.col("fwhm")
    return view(spark, folder, "peaks").select(
        "peak_id", "amplitude", "fwhm",
        F.round(pf.pseudo_voigt(F.lit(0.01), F.lit(0.0), a, w, F.lit(0.4)), 5).alias("value"),
        F.round(pf.pseudo_voigt_area(a, w, F.lit(0.4)), 5).alias("area"))


@query("quality_tier", cte("peaks") + """
select peak_id, flag, rel_misfit, case when flag <> 0 then 'reject' when rel_misfit <= 0.05 then 'quantitative' else 'position' end as tier from peaks""")
def quality_tier(spark, folder):
    return view(spark, folder, "peaks").select(
        "peak_id", "flag", "rel_misfit", pf.quality_tier(F.col("flag"), F.col("rel_misfit")).alias("tier"))


@query("confidence", cte("peaks") + """
select peak_id, round(2 * r * p / (r + p) * least(1, n / 3.0e0) * prior * case when corr is null then 1 else 1 - 0.3 * (1 - corr) end, 8) as confidence from
 (select peak_id, fwhm * 8 as r, 1 - rel_misfit * 5 as p, length(phase) % 5 as n, exp(-0.5 * rel_misfit * 100) as prior, case when flag = 0 then 1 - fwhm end as corr from peaks) t""")
def confidence(spark, folder):
    out = pf.confidence(F.col("fwhm") * 8, 1 - F.col("rel_misfit") * 5, F.length("phase") % 5,
                        prior_penalty=F.exp(-0.5 * F.col("rel_misfit") * 100),
                        intensity_corr=F.when(F.col("flag") == 0, 1 - F.col("fwhm")), intensity_k=0.3)
    return view(spark, folder, "peaks").select("peak_id", F.round(out, 8).alias("confidence"))


@query("pressure_windows", cte("frames") + """
select frame, greatest(coalesce(case when s > 0 then 2 * s end, 5.0e0), 0.3e0) as halfwidth from (select frame, pressure / 40 as s from frames) t""")
def pressure_windows(spark, folder):
    return view(spark, folder, "frames").select(
        "frame", pf.pressure_window(F.col("pressure") / 40, 5.0).alias("halfwidth"))


@query("prior_range_offenders", cte("frames") + """
, m as (select median(pressure) as med from frames), d as (select median(abs(pressure - med)) as mad from frames, m)
select frame, pressure, abs(pressure - med) > greatest(5.0, 8 * 1.4826 * mad) as outlier from frames, m, d
where pressure is not null and (greatest(0, pressure - 2) < 1 or pressure + 2 > 48)""")
def prior_range_offenders(spark, folder):
    from ..operators.identify import prior_range_offenders as offenders
    frames = view(spark, folder, "frames").withColumn("window", F.lit(2.0))
    return offenders(frames, 1.0, 48.0).select("frame", "pressure", "outlier")


@query("reflection_lists", cte("reflections") + """
, n as (select *, w / max(w) over (partition by phase) as wn from reflections)
, r as (select *, row_number() over (partition by phase order by wn desc, ord) as rank from n where wn >= 0.01)
select phase, ord, round(wn, 8) as w, rank from r where rank <= 12""")
def reflection_lists(spark, folder):
    out = matching.normalize_reflections(view(spark, folder, "reflections"), max_lines=12)
    return out.select("phase", "ord", F.round("w", 8).alias("w"), F.col("rank").cast("long").alias("rank"))


DIAMOND_SQL = """
, t as (select unnest(range(0, 8)) as i), hk as (select a.i as h, b.i as k, c.i as l from t a, t b, t c where a.i >= b.i and b.i >= c.i)
, dl as (select distinct round(2 * pi() * sqrt(h*h + k*k + l*l) / 3.56712, 9) as q from hk where h + k + l > 0
  and ((h % 2 = 1 and k % 2 = 1 and l % 2 = 1) or (h % 2 = 0 and k % 2 = 0 and l % 2 = 0 and (h + k + l) % 4 = 0)))
"""


@query("diamond_exclusion", cte("peaks") + DIAMOND_SQL + """
select peak_id, center, exists (select 1 from dl where q <= 8 * 1.06 + 1e-9 and center between q * 0.98 and q * 1.06) as excluded from peaks""")
def diamond_exclusion(spark, folder):
    windows = matching.diamond_windows(8.0)
    return view(spark, folder, "peaks").select(
        "peak_id", "center", matching.in_windows(F.col("center"), windows).alias("excluded"))


@query("integration_settings", """
with g as (select p_partkey, 100 + p_size * 60 as nrows, 500 + p_size * 40 as ncols, p_retailprice / 4 as br, p_retailprice / 3 as bc from part)
, r as (select p_partkey, greatest(sqrt(br*br + bc*bc), sqrt(br*br + (ncols-1-bc)**2), sqrt((nrows-1-br)**2 + bc*bc), sqrt((nrows-1-br)**2 + (ncols-1-bc)**2)) as m from g)
select p_partkey, least(greatest(ceil(m / 50) * 50, 500), 4000)::bigint as npt_1d, least(greatest(ceil(m / 2 / 50) * 50, 300), 1000)::bigint as npt_radial from r""")
def integration_settings(spark, folder):
    from ..operators.reduction import suggest_bins
    out = suggest_bins(100 + F.col("p_size") * 60, 500 + F.col("p_size") * 40, F.col("p_retailprice") / 4, F.col("p_retailprice") / 3)
    return base(spark, folder, "part").select("p_partkey", out["npt_1d"].alias("npt_1d"), out["npt_radial"].alias("npt_radial"))


@query("d_window_mask", cte("bins") + """
select frame, bin::int as bin, exists (select 1 from (values (2.23e0), (1.58e0), (3.1e0)) v(d) where radial between 2 * pi() / d * (1 - 0.028) and 2 * pi() / d * (1 + 0.028)) as inside from bins""")
def d_window_mask(spark, folder):
    from ..sources.tables import bins
    return bins(spark, folder, "clean").select(
        "frame", "bin", matching.d_window_mask(F.col("radial"), "q", None, [2.23, 1.58, 3.1]).alias("inside"))


@query("zero_d_windows", cte("bins") + """
select frame, round(sum(case when exists (select 1 from (values (2.23e0), (1.58e0), (3.1e0)) v(d) where radial between 2 * pi() / d * (1 - 0.028) and 2 * pi() / d * (1 + 0.028)) then 0 else clean end), 6) as total from bins group by frame""")
def zero_d_windows(spark, folder):
    from ..sources.tables import bins
    hit = matching.d_window_mask(F.col("radial"), "q", None, [2.23, 1.58, 3.1])
    return bins(spark, folder, "clean").groupBy("frame").agg(
        F.round(F.sum(F.when(hit, 0.0).otherwise(F.col("clean"))), 6).alias("total"))


@query("match_lines_top3", cte("peaks", "reflections") + """
, o as (select distinct center, 2 * pi() / center as d from peaks)
, p as (select o.center, r.phase as line_phase, r.ord as line_ord, (o.d - r.d) / r.d as delta,
   row_number() over (partition by o.center order by abs((o.d - r.d) / r.d), r.phase, r.ord) as rank from o join reflections r on abs(o.d - r.d) / r.d <= 0.03)
select center, rank, line_phase, line_ord, round(delta, 9) as delta_rel from p where rank <= 3""")
def match_lines_top3(spark, folder):
    observed = view(spark, folder, "peaks").select("center").distinct().withColumn("d", axis.radial_to_d(F.col("center"), "q"))
    out = matching.match_lines(observed, view(spark, folder, "reflections"), key=["center"])
    return out.select("center", F.col("rank").cast("long").alias("rank"), "line_phase", "line_ord",
                      F.round("delta_rel", 9).alias("delta_rel"))


@query("pooled_attributed", cte("peaks", "frames") + """
select round(pressure, 9) as pressure, center, max(fwhm) as fwhm, count(*) as n_peaks from peaks p join frames f on p.frame = f.frame
where phase <> '' and pressure is not null group by 1, 2""")
def pooled_attributed(spark, folder):
    return matching.pooled_attributed(view(spark, folder, "peaks"), view(spark, folder, "frames"))


@query("phase_layers", cte("bins", "reflections") + """
, hit as (select r.phase, b.frame, b.clean from reflections r join bins b on b.radial between 2*pi()/r.d - 0.01*2*pi()/r.d and 2*pi()/r.d + 0.01*2*pi()/r.d)
, raw as (select phase, frame, sum(clean) as s from hit group by 1, 2)
select phase, frame, round(s, 5) as intensity_raw, round(case when max(s) over (partition by phase) > 0 then s / max(s) over (partition by phase) else s end, 6) as intensity from raw""")
def phase_layers(spark, folder):
    from ..sources.tables import bins
    lines = view(spark, folder, "reflections").select("phase", axis.d_to_radial(F.col("d"), "q").alias("center"))
    out = matching.phase_layers(bins(spark, folder, "clean"), lines, value="clean")
    return rounded(rounded(out.select("phase", "frame", "intensity_raw", "intensity"), 5, "intensity_raw"), 6, "intensity")


@query("phase_layers_moving", cte("bins", "reflections") + """
, ln as (select phase, frame, 2*pi()/(d * (1 - 0.0005 * (frame % 10))) as c from reflections, (select distinct frame from bins) f where phase = case frame % 2 when 0 then 'PROMO' else 'SMALL' end)
, hit as (select l.phase, b.frame, b.clean from ln l join bins b on b.frame = l.frame and b.radial between c - 0.01*c and c + 0.01*c)
select phase, frame, round(sum(clean), 5) as intensity_raw from hit group by 1, 2""")
def phase_layers_moving(spark, folder):
    from ..sources.tables import bins
    frames = base(spark, folder, "embeddings").select(F.col("vec_id").alias("frame")).withColumn(
        "phase", F.when(F.col("frame") % 2 == 0, "PROMO").otherwise("SMALL"))
    d = F.col("d") * (1 - 0.0005 * (F.col("frame") % 10))
    lines = frames.join(view(spark, folder, "reflections"), "phase").select(
        "phase", "frame", axis.d_to_radial(d, "q").alias("center"))
    out = matching.phase_layers(bins(spark, folder, "clean"), lines, value="clean")
    return out.select("phase", "frame", F.round("intensity_raw", 5).alias("intensity_raw"))


@query("nearest_line", cte("peaks", "reflections") + """
, o as (select peak_id, phase, 2 * pi() / center as d from peaks where phase <> '')
select distinct peak_id, phase, round(d, 9) as d, round(min(abs(o.d - r.d)) over (partition by peak_id, o.phase, o.d), 9) as gap
from o join reflections r using (phase) """.replace("join reflections r using (phase)", "join reflections r on o.phase = r.phase").replace("peak_id, phase, round(d", "peak_id, o.phase, round(o.d") )
def nearest_line(spark, folder):
    from ..operators.joins import nearest_join
    obs = view(spark, folder, "peaks").where("phase <> ''").select(
        "peak_id", "phase", axis.radial_to_d(F.col("center"), "q").alias("d"))
    lines = view(spark, folder, "reflections").select("phase", F.col("d").alias("line_d"))
    # Peaks at one place have one nearest line, so a place is looked up once however many peaks lie there.
    places = nearest_join(obs.select("phase", "d").distinct(), lines, ["phase"], "d", "line_d", 0.05)
    out = obs.join(places, ["phase", "d"])
    return out.select("peak_id", "phase", F.round("d", 9).alias("d"), F.round("gap", 9).alias("gap")).distinct()


@query("track_labels", cte("track_points") + """
select track, count(*) as n_points, round(arg_min(2 * pi() / center, position), 8) as d0, min(position)::double as p_min, max(position)::double as p_max,
  round(regr_slope(2 * pi() / center, position), 8) as dd_dp from track_points group by track having count(*) >= 3""")
def track_labels(spark, folder):
    points = view(spark, folder, "track_points").select(
        "track", axis.radial_to_d(F.col("center"), "q").alias("d"), F.col("position").cast("double").alias("pressure"))
    out = matching.track_labels(points).where("n_points >= 3")
    return out.withColumn("d0", F.round("d0", 8)).withColumn("dd_dp", F.round("dd_dp", 8))


STATES = """
, st as (select f.frame, p.phase, pressure, temperature, alpha_v from frames f join (select distinct frame, phase from peaks where phase <> '') p on p.frame = f.frame join phases h on h.phase = p.phase)
, nl as (select phase, ord, d, row_number() over (partition by phase order by w desc, ord) as r, w / max(w) over (partition by phase) as wn from reflections)
"""


@query("thermal_line_tracks", cte("frames", "phases", "peaks", "reflections") + STATES + """
select frame, st.phase, ord, round(2 * pi() / (d * pow(1 + alpha_v * (temperature - 298), 1.0 / 3)), 8) as center from st join nl on nl.phase = st.phase where r <= 6 and wn >= 0.01""")
def thermal_line_tracks(spark, folder):
    scale = eos.thermal_scale(F.col("alpha_v"), F.lit(None).cast("double"), F.col("temperature"))
    out = matching.predicted_lines(states(spark, folder), view(spark, folder, "reflections"), scale, 6)
    return out.select("frame", "phase", "ord", F.round(axis.d_to_radial(F.col("pred_d"), "q"), 8).alias("center"))


@query("pressure_line_tracks")
def pressure_line_tracks(spark, folder):
    law = F.struct(F.col("eos_type").alias("type"), F.col("k0").alias("K0"), F.col("k0p").alias("K0p"), F.col("k0pp").alias("K0pp"))
    scale = eos.linear_scale(law, F.coalesce("pressure", F.lit(0.0)))
    out = matching.predicted_lines(states(spark, folder), view(spark, folder, "reflections"), scale, 6)
    return out.select("frame", "phase", "ord", axis.d_to_radial(F.col("pred_d"), "q").alias("center"))


def states(spark, folder):
    present = view(spark, folder, "peaks").where("phase <> ''").select("frame", "phase").distinct()
    frames = view(spark, folder, "frames").select("frame", "pressure", "temperature")
    return present.join(frames, "frame").join(view(spark, folder, "phases"), "phase")
