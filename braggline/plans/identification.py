"""Identification, attribution, spots and simulation queries."""

from pyspark.sql import functions as F

from ..functions import axis, eos
from ..operators import identify as idn
from ..operators import peaks as pk
from ..operators import simulate as sm
from ..operators import spots as sp
from ..operators.ordered import with_rank
from ..session import checkpointed
from ..sources.tables import cte, patterns, radial_axis, view
from .registry import query
from .series import GRID


def observed(spark, folder):
    d = axis.radial_to_d(F.col("center"), "q")
    err = axis.radial_error_to_d_error(F.col("center"), F.col("fwhm_err"), "q")
    return view(spark, folder, "peaks").where("flag = 0").select("frame", F.col("peak_id").alias("obs"), d.alias("d"), err.alias("d_err"))


def present_phases(spark, folder):
    return view(spark, folder, "peaks").where("phase <> ''").select("frame", "phase").distinct()


def library_lines(spark, folder):
    """The lines of the library, alike on all frames."""
    return view(spark, folder, "reflections").select("phase", F.col("ord").alias("line"), F.col("d").alias("pred_d"), "w")


LINES = """
, obs as (select distinct frame, peak_id as obs, 2 * pi() / center as d, 2 * pi() / center * fwhm_err / center as d_err from peaks where flag = 0)
, lf as (select p.frame, p.phase, ord as line, d as pred_d, w from (select distinct frame, phase from peaks where phase <> '') p join reflections r on p.phase = r.phase)
"""


@query("nearest_score", cte("peaks", "reflections") + LINES + """
, g as (select l.frame, l.phase, l.line, pred_d, w, min(abs(pred_d - o.d)) as gap from lf l left join obs o on o.frame = l.frame group by 1, 2, 3, 4, 5)
select frame, phase, round(sum(w * coalesce(exp(-0.5 * pow(gap / (0.01 * pred_d), 2)), 0)), 6) as score from g group by 1, 2""")
def nearest_score(spark, folder):
    d = axis.radial_to_d(F.col("center"), "q")
    # Each peak is read once, for its place and for the phase it names.
    rows = view(spark, folder, "peaks").select("frame", F.when(F.col("flag") == 0, d).alias("d"), F.when(F.col("phase") != "", F.col("phase")).alias("phase"))
    out = idn.nearest_score(library_lines(spark, folder).select("phase", "pred_d", "w"), rows, 0.01)
    return out.select("frame", "phase", F.round("score", 6).alias("score"))


@query("band_candidates", cte("peaks", "reflections") + LINES + """
select l.frame, l.phase, l.line, o.obs, round(abs(pred_d - o.d), 9) as gap from lf l join obs o on o.frame = l.frame
where abs(pred_d - o.d) < 2 * sqrt(pow(0.01 * pred_d, 2) + pow(d_err, 2))""")
def band_candidates(spark, folder):
    lines = library_lines(spark, folder).drop("w")
    out = idn.band_candidates(lines, observed(spark, folder).distinct(), 0.01, present=present_phases(spark, folder))
    return out.select("frame", "phase", "line", "obs", F.round("gap", 9).alias("gap"))


# Greedy matching as a fold over the sorted pairs of a group.
GREEDY = """list_reduce(list_transform(list_sort(list(struct_pack({fields}))), lambda p: [p]),
  lambda kept, p: case when len(list_filter(kept, lambda q: {same})) > 0 then kept else list_concat(kept, p) end)"""


@query("match_one_to_one", cte("peaks", "reflections") + LINES + """
, c as (select l.frame, l.phase, l.line, o.obs, abs(pred_d - o.d) as gap from lf l join obs o on o.frame = l.frame
  where abs(pred_d - o.d) < 2 * sqrt(pow(greatest(0.01 * pred_d, 1e-9), 2) + pow(coalesce(d_err, 0), 2)))
, m as (select frame, phase, unnest(""" + GREEDY.format(
    fields="gap := gap, line := line, obs := obs", same="q.line = p[1].line or q.obs = p[1].obs") + """) as k from c group by 1, 2)
select frame, phase, k.line as line, k.obs as obs, round(k.gap, 9) as gap from m""")
def match_one_to_one(spark, folder):
    lines = library_lines(spark, folder).drop("w")
    return idn.match_one_to_one(lines, observed(spark, folder), 0.01, present_phases(spark, folder)).select("frame", "phase", "line", "obs", F.round("gap", 9).alias("gap"))


@query("attribute_peaks", cte("peaks", "reflections") + LINES + """
, c as (select l.frame, l.phase, case when l.phase = 'ECONOMY' then 0 else 1 end as phase_rank, l.line, o.obs, abs(o.d - pred_d) / o.d as gap
  from lf l join obs o on o.frame = l.frame where abs(o.d - pred_d) / o.d < 0.01)
, m as (select frame, unnest(""" + GREEDY.format(
    fields="gap := gap, phase_rank := phase_rank, line := line, obs := obs, phase := phase",
    same="q.obs = p[1].obs or (q.line = p[1].line and q.phase = p[1].phase)") + """) as k from c group by 1)
select frame, k.obs as obs, k.phase as phase, k.line as line, round(k.gap, 9) as gap from m""")
def attribute_peaks(spark, folder):
    rank = F.when(F.col("phase") == "ECONOMY", 0).otherwise(1)
    lines = library_lines(spark, folder).drop("w").withColumn("phase_rank", rank)
    return idn.attribute_peaks(observed(spark, folder).select("frame", "obs", "d"), lines, 0.01, present_phases(spark, folder)).select("frame", "obs", "phase", "line", F.round("gap", 9).alias("gap"))


def law_of(kind=None):
    """The equation of a phase as a struct; ``kind`` replaces its form."""
    return F.struct((F.col("eos_type") if kind is None else F.lit(kind)).alias("type"), F.col("k0").alias("K0"), F.col("k0p").alias("K0p"),
                    F.col("k0pp").alias("K0pp"), F.col("p_max").alias("p_max"))


AXIS = "struct<type:string,K0:double,K0p:double,K0pp:double,beta:double>"
CELL = "struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>"


def phase_laws(spark, folder, kind=None):
    """The library of phases with their equations; these have no axial laws."""
    return view(spark, folder, "phases").select(
        "phase", law_of(kind).alias("eos"), F.lit(None).cast(f"struct<a:{AXIS},b:{AXIS},c:{AXIS}>").alias("axial"), F.lit(None).cast(CELL).alias("lattice"),
        "p_max", "alpha_v", F.lit(None).cast("double").alias("t0"), F.lit(None).cast("string").alias("assumption"))


def phase_lines(spark, folder):
    return view(spark, folder, "reflections").select("phase", F.col("ord").alias("line"), "d", "w", "h", "k", "l")


def observed_peaks(spark, folder):
    """All good peaks with their amplitude."""
    d = axis.radial_to_d(F.col("center"), "q")
    err = axis.radial_error_to_d_error(F.col("center"), F.col("fwhm_err"), "q")
    return view(spark, folder, "peaks").where("flag = 0").select("frame", F.col("peak_id").alias("obs"), d.alias("d"), err.alias("d_err"), "amplitude")


def frame_states(spark, folder):
    return view(spark, folder, "frames").select("frame", "pressure", F.lit(2.0).alias("window"), "temperature")


@query("predicted_d_axial", cte("peaks", "reflections", "phases", "frames") + """
, st as (select distinct h.phase, floor(f.pressure) as p, f.temperature as t, h.k0, h.k0p, h.alpha_v from peaks p join frames f on f.frame = p.frame join phases h on h.phase = p.phase where f.pressure is not null)
, cell as (select *, 3.0e0 + k0 / 100 as a, 3.5e0 + k0 / 120 as b, 4.0e0 + k0 / 90 as c, radians(85.0e0) as al, radians(95.0e0 + k0p) as be, radians(100.0e0) as ga,
   pow(1 + k0p * p / k0, -1 / (3 * k0p)) as iso, pow(1 + k0p * p / k0, -1 / (3 * k0p)) as sa, pow(1 + k0p * p / (1.5 * k0), -1 / (3 * k0p)) as sb, pow(1 + k0p * p / (2.5 * k0), -1 / (3 * k0p)) as sc,
   pow(greatest(1 + alpha_v * (t - 298), 1e-6), 1.0 / 3) as th from st)
, m as (select c.p, c.t, c.phase, r.ord, r.d, iso, th,
   h*h*sin(al)**2/(a*a) + k*k*sin(be)**2/(b*b) + l*l*sin(ga)**2/(c*c) + 2*h*k*(cos(al)*cos(be)-cos(ga))/(a*b) + 2*k*l*(cos(be)*cos(ga)-cos(al))/(b*c) + 2*h*l*(cos(al)*cos(ga)-cos(be))/(a*c) as s0,
   h*h*sin(al)**2/(a*a*sa*sa) + k*k*sin(be)**2/(b*b*sb*sb) + l*l*sin(ga)**2/(c*c*sc*sc) + 2*h*k*(cos(al)*cos(be)-cos(ga))/(a*b*sa*sb) + 2*k*l*(cos(be)*cos(ga)-cos(al))/(b*c*sb*sc)
   + 2*h*l*(cos(al)*cos(ga)-cos(be))/(a*c*sa*sc) as s1 from cell c join reflections r on r.phase = c.phase)
select p, t, phase, ord, round(th * d * case when s0 > 1e-12 then sqrt(s0 / s1) else iso end, 6) as pred_d from m""")
def predicted_d_axial(spark, folder):
    from .crystal import lattice_of
    none = F.lit(None).cast("double")
    softer = lambda m: F.struct(F.lit("Murnaghan").alias("type"), (F.col("k0") * m).alias("K0"), F.col("k0p").alias("K0p"), none.alias("K0pp"), none.alias("beta"))
    phases = view(spark, folder, "phases").select(
        "phase", law_of("Murnaghan").alias("eos"), F.struct(softer(1.0).alias("a"), softer(1.5).alias("b"), softer(2.5).alias("c")).alias("axial"),
        lattice_of(F.col("k0"), F.col("k0p")).alias("lattice"), "alpha_v")
    present = view(spark, folder, "peaks").select("frame", "phase").distinct()
    seen = view(spark, folder, "frames").where("pressure is not null").select("frame", F.floor("pressure").cast("double").alias("p"), "temperature")
    states = present.join(seen, "frame").select("phase", "p", "temperature").distinct().join(phases, "phase")
    states = states.withColumn("thermal", eos.thermal_scale(F.col("alpha_v"), F.lit(None).cast("double"), F.col("temperature")))
    out = idn.line_positions(states, phase_lines(spark, folder))
    return out.select("p", F.col("temperature").alias("t"), "phase", F.col("line").alias("ord"), F.round("pred_d", 6).alias("pred_d"))


@query("identification_candidates", cte("peaks", "reflections", "phases", "frames") + """
, kn as (select i, 5.0e0 * i as p from (select unnest(range(0, 13)) as i))
, cu as (select r.phase, r.ord as line, i, r.d * pow(1 + k0p * least(p, case when p_max > 0 then p_max else p end) / k0, -1 / (3 * k0p)) as d from reflections r join phases h on h.phase = r.phase, kn)
, ix as (select a.phase, a.line, a.i as bin, least(a.d, b.d) as lo, greatest(a.d, b.d) as hi from cu a join cu b on b.phase = a.phase and b.line = a.line and b.i = a.i + 1
   union all select phase, line, -2, min(d), max(d) from cu group by 1, 2)
, fb as (select frame, unnest(case when pressure is null then [-2] else range(greatest(0, least(floor((pressure - 2) / 5), 11))::bigint, greatest(0, least(floor((pressure + 2) / 5), 11))::bigint + 1) end) as bin from frames)
, ob as (select distinct frame, 2 * pi() / center as d, 2 * pi() / center * fwhm_err / center as e from peaks where flag = 0)
, v as (select o.frame, x.phase, x.bin, count(distinct x.line) as n from ob o join fb on fb.frame = o.frame join ix x on x.bin = fb.bin
   and o.d > x.lo - 2 * sqrt(pow(0.002 * x.hi, 2) + e * e) and o.d < x.hi + 2 * sqrt(pow(0.002 * x.hi, 2) + e * e) group by 1, 2, 3 having count(distinct x.line) >= 3)
select frame, phase, max(n) as n_lines from v group by 1, 2""")
def identification_candidates(spark, folder):
    curves = idn.line_curves(phase_laws(spark, folder, "Murnaghan"), phase_lines(spark, folder), 0.0, 60.0, 5.0)
    frames = frame_states(spark, folder).withColumn("thermal", F.lit(1.0))
    return idn.candidates(frames, observed_peaks(spark, folder), curves, 0.002, 0.0, 5.0, 3)


@query("identification_evidence", cte("peaks", "reflections") + LINES + """
, am as (select distinct frame, peak_id as obs, amplitude from peaks where flag = 0)
, n as (select l.frame, l.phase, l.line, pred_d, w, min(struct_pack(g := abs(pred_d - o.d), d := o.d, e := -o.d_err)) as n from lf l join obs o on o.frame = l.frame group by 1, 2, 3, 4, 5)
, s as (select *, sqrt(pow(0.01 * pred_d, 2) + n.e * n.e) as sigma, exp(-0.5 * pow(n.g / sqrt(pow(0.01 * pred_d, 2) + n.e * n.e), 2)) as near from n)
, c as (select l.frame, l.phase, l.line, o.obs, abs(pred_d - o.d) as gap from lf l join obs o on o.frame = l.frame
  where abs(pred_d - o.d) < 2 * sqrt(pow(greatest(0.01 * pred_d, 1e-9), 2) + pow(coalesce(d_err, 0), 2)))
, m0 as (select frame, phase, unnest(""" + GREEDY.format(
    fields="gap := gap, line := line, obs := obs", same="q.line = p[1].line or q.obs = p[1].obs") + """) as k from c group by 1, 2)
, m as (select m0.frame, phase, k.line as line, amplitude from m0 join am on am.frame = m0.frame and am.obs = k.obs)
, r as (select frame, min(d) as lo, max(d) as hi from obs group by 1)
, t as (select s.*, m.amplitude, m.line is not null as matched, 2 * max(sigma) over (partition by s.frame, s.phase) as span, lo, hi from s left join m on m.frame = s.frame and m.phase = s.phase and m.line = s.line join r on r.frame = s.frame)
, u as (select *, pred_d between lo - span and hi + span as inside from t)
, x as (select *, max(case when inside then w end) over (partition by frame, phase) as top from u)
, y as (select frame, phase, sum(w * near) as score, count(*) filter (matched) as n_matched, coalesce(sum(w * near) filter (inside and w >= 0.1 * top and matched) / sum(w) filter (inside and w >= 0.1 * top), 0) as recall,
   min(pred_d) - max(span) as fr, max(pred_d) + max(span) as till, sum(w * amplitude) filter (matched) as wa, sum(w * w) filter (matched) as ww, sum(amplitude * amplitude) filter (matched) as aa from x group by 1, 2)
, z as (select y.frame, y.phase, count(*) as n_inside from y join obs o on o.frame = y.frame and o.d between fr and till group by 1, 2)
select y.frame, y.phase, round(score, 6) as score, n_matched, round(recall, 6) as recall, round(coalesce(least(1, n_matched / n_inside), 0), 6) as precision,
  case when n_matched >= 3 then round(wa / (sqrt(ww) * sqrt(aa)), 6) end as intensity_corr from y left join z on z.frame = y.frame and z.phase = y.phase""")
def identification_evidence(spark, folder):
    out = idn.evidence(library_lines(spark, folder), observed_peaks(spark, folder), 0.01, present_phases(spark, folder))
    return out.select("frame", "phase", F.round("score", 6).alias("score"), "n_matched", F.round("recall", 6).alias("recall"),
                      F.round("precision", 6).alias("precision"), F.round("intensity_corr", 6).alias("intensity_corr"))


@query("identify")
def identify(spark, folder):
    return identified(spark, folder)


def identified(spark, folder):
    """All good peaks of all frames against the whole library; a phase needs four lines."""
    return idn.identify(frame_states(spark, folder), observed_peaks(spark, folder), phase_laws(spark, folder), phase_lines(spark, folder),
                        rel_tol=0.002, step=2.0, n_grid=40, min_matched=4)


@query("identification_summary")
def identification_summary(spark, folder):
    seen = idn.present_phases(identified(spark, folder), 0.2)
    return seen.groupBy("phase").agg(F.count(F.lit(1)).alias("n_frames"), F.avg("confidence").alias("mean_confidence"),
                                     F.median("pressure").alias("median_pressure"))


@query("subtract_peaks", cte("bins", "pattern_peaks") + """
, p as (select distinct frame, floor(center * 2) as c, first_value(center) over w as center, first_value(width) over w as fwhm, first_value(area) over w as amplitude from pattern_peaks window w as (partition by frame, floor(center * 2) order by area desc, peak_id desc))
, m as (select b.frame, b.bin, sum(amplitude / 1000 * (0.5 / (1 + pow(2 * (radial - center) / fwhm, 2)) + 0.5 * exp(-ln(2) * pow(2 * (radial - center) / fwhm, 2)))) as y from bins b join p on p.frame = b.frame group by 1, 2)
select b.frame, b.bin::int as bin, round(clean - coalesce(y, 0), 6) as residual from bins b left join m on m.frame = b.frame and m.bin = b.bin""")
def subtract_peaks(spark, folder):
    cell = view(spark, folder, "pattern_peaks").groupBy("frame", F.floor(F.col("center") * 2).alias("c")).agg(
        F.max_by(F.struct("center", "width", "area"), F.struct("area", "peak_id")).alias("p"))
    peaks = cell.select("frame", "p.center", (F.col("p.area") / 1000).alias("amplitude"), F.col("p.width").alias("fwhm"), F.lit(0.5).alias("eta"))
    out = idn.subtract_peaks(patterns(spark, folder).select("frame", "clean"), "clean", peaks, radial_axis())
    return out.select("frame", F.posexplode("residual").alias("bin", "_v")).select("frame", "bin", F.round("_v", 6).alias("residual"))


@query("residual_peaks")
def residual_peaks(spark, folder):
    base = patterns(spark, folder).select("frame", "clean")
    fitted = pk.fit_peaks(base, "clean", radial_axis(), min_snr=3.0)
    strongest = fitted.where("flag = 0").select("frame", "center", "amplitude", "fwhm", "eta")
    rest = idn.subtract_peaks(base, "clean", strongest, radial_axis())
    return pk.fit_peaks(rest.select("frame", "residual"), "residual", radial_axis(), min_snr=3.0).where("flag = 0")


def spots(spark, folder):
    return sp.detect_spots(view(spark, folder, "cakes"), n_azim=36, bin_a=10.0, bin_r=0.05, min_snr=1.2, min_samples=12,
                           max_azim=60.0, max_radial=6)


@query("fit_run")
def fit_run(spark, folder):
    """All patterns fitted with a preset inside the range found on the median pattern."""
    return pk.fit_run(patterns(spark, folder).select("frame", "clean"), "clean", radial_axis(), min_snr=3.0)


@query("residual_step")
def residual_step(spark, folder):
    """All fitted peaks, those of identified phases taken off, and what is left fitted again."""
    base = patterns(spark, folder).select("frame", "clean")
    fitted = pk.fit_peaks(base, "clean", radial_axis(), min_snr=3.0).where("flag = 0")
    peaks = checkpointed(fitted.select("frame", F.col("peak").alias("obs"), axis.radial_to_d(F.col("center"), "q").alias("d"), "center", "amplitude", "fwhm", "eta"))
    states = base.select("frame", F.lit(None).cast("double").alias("pressure"), F.lit(None).cast("double").alias("window"), F.lit(None).cast("double").alias("temperature"))
    library, lines = phase_laws(spark, folder), phase_lines(spark, folder)
    fixed = library.withColumn("eos", F.lit(None).cast(library.schema["eos"].dataType))
    found = checkpointed(idn.identify(states, peaks.withColumn("d_err", F.lit(0.0)), fixed, lines, rel_tol=0.005, step=1.0, p_max=1.0, n_grid=2))
    # The surest phase of a frame explains a peak first.
    shown = found.join(lines.select("phase", "line", F.col("d").alias("pred_d")), "phase").select(
        "frame", "phase", "line", "pred_d", F.lit(0).alias("phase_rank"))
    return idn.residual_step(base, "clean", peaks, shown, found, radial_axis(), 0.005, 0.2, min_snr=3.0)[1].where("flag = 0")


@query("bright_cells", cte("cakes") + """
, l as (select frame, rbin, median(y) as level, count(*) as n from cakes group by 1, 2)
, e as (select c.*, y - level as excess from cakes c join l on c.frame = l.frame and c.rbin = l.rbin where n >= 12)
, s as (select frame, rbin, 1.4826 * median(abs(excess)) as sigma from e group by 1, 2)
select e.frame, e.rbin, e.abin, round(excess + 1e-9, 5) as excess from e join s on e.frame = s.frame and e.rbin = s.rbin where excess > greatest(1.2 * sigma, 20)""")
def bright_cells(spark, folder):
    out = sp.bright_cells(view(spark, folder, "cakes"), min_snr=1.2, min_samples=12)
    return out.select("frame", "rbin", "abin", F.round(F.col("excess") + 1e-9, 5).alias("excess"))


@query("integrate_masked", cte("cakes") + """
, l as (select frame, rbin, median(y) as level, count(*) as n from cakes group by 1, 2)
, e as (select c.*, y - level as excess from cakes c join l on c.frame = l.frame and c.rbin = l.rbin where n >= 12)
, s as (select frame, rbin, 1.4826 * median(abs(excess)) as sigma from e group by 1, 2)
, box as (select e.frame, e.radial as q, e.azim as az from e join s on e.frame = s.frame and e.rbin = s.rbin where excess > greatest(1.2 * sigma, 20))
, kept as (select * from cakes c where not exists (select 1 from box b where b.frame = c.frame and abs(c.radial - b.q) <= 0.06 and abs((c.azim - b.az + 540) % 360 - 180) <= 12))
, t as (select frame, rbin, radial, avg(y) as intensity, sqrt(sum(y)) / count(*) as sigma, count(*) as n from kept group by 1, 2, 3)
select frame, rbin, round(intensity + 1e-9, 5) as intensity, round(sigma, 6) as sigma, n from t""")
def integrate_masked(spark, folder):
    cakes = view(spark, folder, "cakes")
    bright = sp.bright_cells(cakes, min_snr=1.2, min_samples=12)
    boxes = bright.select("frame", F.col("radial").alias("q"), "azim", F.lit(0.06).alias("q_width"), F.lit(12.0).alias("azim_width"))
    out = sp.integrate_masked(cakes, boxes, keep=False)
    return out.select("frame", "rbin", F.round(F.col("intensity") + 1e-9, 5).alias("intensity"), F.round("sigma", 6).alias("sigma"), "n")


@query("spot_patterns")
def spot_patterns(spark, folder):
    """Patterns of what the detected spots cover."""
    found = spots(spark, folder).select("frame", "q", "azim", "q_width", "azim_width")
    return sp.integrate_masked(view(spark, folder, "cakes"), found)


def merged(spark, folder):
    found = spots(spark, folder).withColumn("id", F.concat_ws("-", "frame", "spot")).withColumn("ladder", F.floor(F.col("frame") / 10))
    return sp.consolidate(found.select("ladder", "frame", "id", "q", "azim", "intensity", "area"), ["ladder"], q_tol=0.02)


@query("consolidate_spots")
def consolidate_spots(spark, folder):
    return sp.merged_spots(merged(spark, folder), ["ladder"])


@query("link_spot_tracks")
def link_spot_tracks(spark, folder):
    found = spots(spark, folder).select(
        F.floor(F.col("frame") / 50).alias("ladder"), F.concat_ws("-", "frame", "spot").alias("id"),
        F.col("frame").alias("position"), F.col("frame").cast("double").alias("axis"), "q", "azim", "intensity")
    return sp.link_spots(found, ["ladder"], azim_tol=15.0)


@query("spot_masks", cte("cakes") + """
, box as (select frame, azim as az, radial as q, 0.12 as hq, 25.0 as ha from (select *, row_number() over (partition by frame order by y desc, rbin, abin) as n from cakes) t where n = 1)
select c.frame, c.rbin, c.abin, round(c.y + 1e-9, 5) as y from cakes c join box b on b.frame = c.frame where abs(radial - q) <= hq + 1e-12 and abs((azim - az + 540) % 360 - 180) <= ha""")
def spot_masks(spark, folder):
    cakes = view(spark, folder, "cakes")
    brightest = cakes.groupBy("frame").agg(F.max_by(F.struct("azim", "radial"), F.struct("y", -F.col("rbin"), -F.col("abin"))).alias("b"))
    boxes = brightest.select("frame", F.col("b.radial").alias("q"), F.col("b.azim").alias("azim"),
                             F.lit(0.12 + 1e-12).alias("q_width"), F.lit(25.0).alias("azim_width"))
    return sp.keep_masks(cakes, boxes).select("frame", "rbin", "abin", F.round(F.col("y") + 1e-9, 5).alias("y"))


def mixtures(spark, folder):
    rows = view(spark, folder, "peaks").where("phase <> ''").groupBy(F.col("frame").alias("id"), "phase").agg(
        (F.floor(F.max("amplitude") / 2000) * 2.0).alias("pressure"))
    return rows.withColumn("pressure", F.least("pressure", F.lit(30.0)))


@query("scoring_pairs")
def scoring_pairs(spark, folder):
    phases = view(spark, folder, "phases").select("phase", "p_max")
    hashed = phases.withColumn("_h", F.pmod(F.xxhash64("phase"), F.lit(64)))
    library = with_rank(hashed, [], ["_h", "phase"], "_h", 1.0, "slot").drop("_h")
    return sm.scoring_pairs(mixtures(spark, folder), library)


@query("augmented_patterns")
def augmented_patterns(spark, folder):
    lines = view(spark, folder, "reflections").groupBy("phase").agg(F.sort_array(F.collect_list(F.struct("d", "w"))).alias("l"))
    samples = view(spark, folder, "frames").select(F.col("frame").alias("id")).join(
        mixtures(spark, folder).groupBy("id").agg(F.min("phase").alias("phase")), "id").select("id", "phase")
    shapes = lines.select("phase", F.col("l.d").alias("centers"), F.col("l.w").alias("weights"))
    out = sm.augmented_patterns(samples, shapes, GRID, seed=7)
    return out.select("id", "phase", F.aggregate("pattern", F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max("pattern").alias("peak"))


@query("simulated_patterns", cte("reflections") + """
, g as (select i, 1.55 + 0.025 * i as x from (select unnest(range(0, 180)) as i))
, s as (select phase, i, sum(w * (0.5 / (1 + z) + 0.5 * exp(-ln(2) * z))) as y from (select phase, i, w, pow(2 * (x - d) / (d * d * 0.05 / (2 * pi())), 2) as z from g, reflections) t group by 1, 2)
select phase, i::int as point, round(y / max(y) over (partition by phase), 8) as value from s""")
def simulated_patterns(spark, folder):
    from ..operators.ranking import simulated_patterns as simulate
    from .series import library
    out = simulate(library(spark, folder).withColumnRenamed("d0", "centers"), GRID, fwhm_q=0.05)
    return out.select("phase", F.posexplode("simulated").alias("point", "_v")).select("phase", "point", F.round("_v", 8).alias("value"))
