"""Peak groups, grids, size and strain, texture and reduction queries."""

from pyspark.sql import functions as F

from ..functions import axis
from ..operators import maps, microstructure as ms, peaks as pk, reduction as rd, texture as tx
from ..sources.tables import RADIAL_START, RADIAL_STEP, cte, patterns, radial_axis, view
from .registry import query


NUDGE = 1e-9  # decides decimal ties of means of cents the same way in both engines


def rnd(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def rnd_mean(df, name):
    return df.withColumn(name, F.round(F.col(name) + NUDGE, 5))


@query("group_peaks", cte("peaks") + """
, u as (select distinct frame, peak_id, center, fwhm from peaks)
, r as (select *, max(center + 3 * fwhm) over (partition by frame order by center, peak_id, fwhm rows between unbounded preceding and 1 preceding) as reach from u)
select frame, peak_id, center, fwhm, sum(case when reach is null or center - 3 * fwhm > reach then 1 else 0 end) over (partition by frame order by center, peak_id, fwhm rows unbounded preceding)::bigint - 1 as "group" from r""")
def group_peaks(spark, folder):
    rows = view(spark, folder, "peaks").select("frame", "peak_id", "center", "fwhm").distinct()
    return pk.group_overlapping(rows, ["frame"], 3.0, 2.0, ("center", "peak_id", "fwhm"))


@query("seed_paths", cte("frames") + """
select frame, case when pressure is null then 'frame-' || frame::string else 'group-' || series::string end as path from frames""")
def seed_paths(spark, folder):
    return pk.seed_paths(view(spark, folder, "frames"), "series", "pressure").select("frame", "path")


@query("fit_peaks")
def fit_peaks(spark, folder):
    return pk.fit_peaks(patterns(spark, folder), "clean", radial_axis(), min_snr=2.0, min_prominence_snr=1.5)


@query("fit_series")
def fit_series(spark, folder):
    return pk.fit_series(patterns(spark, folder), "clean", radial_axis(), "series", ["frame"], min_snr=2.5)


@query("frame_grid", cte("frames") + """
, g as (select frame, frame // 25 as line, frame % 25 as i from frames)
select frame, line as row_h, case when line % 2 = 1 then 24 - i else i end as col_h, i as row_v, line as col_v from g""")
def frame_grid(spark, folder):
    h = maps.grid_position(F.col("frame"), 25)
    v = maps.grid_position(F.col("frame"), 25, order="vertical", serpentine=False)
    return view(spark, folder, "frames").select("frame", h["row"].alias("row_h"), h["col"].alias("col_h"),
                                                v["row"].alias("row_v"), v["col"].alias("col_v"))


LINES = """
, {n}d as (select distinct {c} as v from positions), {n}g as (select v - lag(v) over (order by v) as gap from {n}d)
, {n}r as (select gap, lag(gap) over (order by gap) as pg from {n}g where gap > 0)
, {n}b as (select gap, pg from {n}r where pg is not null order by gap / pg desc, gap limit 1)
, {n}t as (select case when (select gap / pg from {n}b) > 4 then (select sqrt(gap * pg) from {n}b) else (select min(gap) / 2 from {n}r) end as tol)
, {n}l as (select v, sum(case when v - pv > (select tol from {n}t) then 1 else 0 end) over (order by v)::bigint as line from (select v, lag(v) over (order by v) as pv from {n}d) q)
"""
GRID = LINES.format(n="x", c="pos_x") + LINES.format(n="y", c="pos_y")


@query("cluster_1d", cte("positions") + GRID + """
select frame, xl.line as "line" from positions join xl on pos_x = v""")
def cluster_1d(spark, folder):
    return maps.cluster_lines(view(spark, folder, "positions"), "pos_x", 4.0).select("frame", "line")


@query("coordinate_grid", cte("positions") + GRID + """
select yl.line as "row", xl.line as col, max(frame) as frame, count(*) - 1 as collisions from positions join xl on pos_x = xl.v join yl on pos_y = yl.v group by 1, 2""")
def coordinate_grid(spark, folder):
    return maps.coordinate_grid(view(spark, folder, "positions"), 4.0)


@query("value_map", cte("positions") + GRID + """
, pl as (select frame, yl.line as "row", xl.line as col from positions join xl on pos_x = xl.v join yl on pos_y = yl.v)
, vl as (select user_id as frame, avg(value) as value from events where event_type <> 'click' group by 1)
, hd as (select "row", col, avg(value) as value, count(*) as n from pl join vl on vl.frame = pl.frame where value is not null group by 1, 2)
, ce as (select "row", unnest(range(0, (select max(col) + 1 from pl))) as col from (select distinct "row" from pl) t)
, ne as (select c."row", c.col, arg_min(h.value, struct_pack(g := abs(h.col - c.col), c := h.col)) as value from ce c left join hd h on h."row" = c."row" group by 1, 2)
select c."row", c.col, round(coalesce(h.value, ne.value), 6) as value, coalesce(h.n, 0) as n, h.n is null and ne.value is not null as filled
from ce c left join hd h on h."row" = c."row" and h.col = c.col join ne on ne."row" = c."row" and ne.col = c.col""")
def value_map(spark, folder):
    from ..sources.tables import base
    values = base(spark, folder, "events").where("event_type <> 'click'").groupBy(F.col("user_id").alias("frame")).agg(F.avg("value").alias("value"))
    return rnd(maps.value_map(view(spark, folder, "positions"), values, 4.0), 6, "value")


@query("pattern_image", cte("bins", "frames") + """
, pr as (select frame, pressure as x from frames where pressure is not null)
, rk as (select p.frame, x, row_number() over (order by x, p.frame) - 1 as rank from pr p join (select distinct frame from bins) b on b.frame = p.frame)
select rank, x, bin::int as bin, round(masked, 6) as value from bins b join rk on rk.frame = b.frame""")
def pattern_image(spark, folder):
    from ..sources.tables import bins
    rows = bins(spark, folder, "masked")
    frames = view(spark, folder, "frames").join(rows.select("frame").distinct(), "frame", "left_semi")
    out = maps.pattern_image(rows, frames, "masked", "pressure")
    return out.select("rank", "x", "bin", F.round("value", 6).alias("value"))


def good_in_q(spark, folder):
    c, w, e = F.col("center"), F.col("fwhm"), F.col("fwhm_err")
    return view(spark, folder, "peaks").where("flag = 0 and fwhm > 0").select(
        "frame", "series", axis.to_q(c, "2th_deg", 0.4066).alias("q"), axis.width_to_q(c, w, "2th_deg", 0.4066).alias("dq"),
        axis.width_to_q(c, e, "2th_deg", 0.4066).alias("dq_err"))


QPEAKS = """
, q as (select frame, series, 4 * pi() / 0.4066 * sin(radians(center) / 2) as q, 2 * pi() / 0.4066 * cos(radians(center) / 2) * radians(fwhm) as dq,
  2 * pi() / 0.4066 * cos(radians(center) / 2) * radians(fwhm_err) as e from peaks where flag = 0 and fwhm > 0)
"""


@query("williamson_hall", cte("peaks") + QPEAKS + """
, s as (select series, count(*) as n, sum(1/(e*e)) as s0, sum(q/(e*e)) as sx, sum(q*q/(e*e)) as sxx, sum(dq/(e*e)) as sy, sum(q*dq/(e*e)) as sxy, avg(dq) as my from q group by series having count(*) >= 5)
, l as (select *, (s0*sxy - sx*sy) / (s0*sxx - sx*sx) as b1, (sxx*sy - sx*sxy) / (s0*sxx - sx*sx) as b0, s0*sxx - sx*sx as det from s)
, rs as (select q.series, sum(pow((dq - b0 - b1 * q) / e, 2)) / greatest(any_value(n) - 2, 1) as s2, sum(pow(dq - b0 - b1 * q, 2)) as ss, sum(pow(dq - my, 2)) as st from q join l on q.series = l.series group by q.series)
select l.series, n as n_peaks, case when b0 > 0 then round(2 * pi() * 0.9 / b0, 4) else 'infinity'::double end as size, case when b0 > 0 then round(2 * pi() * 0.9 / b0 * sqrt(sxx / det * s2) / b0, 4) end as size_err,
  round(greatest(b1, 0) / 2, 8) as strain, round(sqrt(s0 / det * s2) / 2, 8) as strain_err, round(1 - ss / st, 7) as r2 from l join rs on l.series = rs.series""")
def williamson_hall(spark, folder):
    out = ms.williamson_hall(good_in_q(spark, folder), ["series"])
    return rnd(rnd(rnd(out, 4, "size", "size_err"), 8, "strain", "strain_err"), 7, "r2")


@query("estimate_fwhm_q", cte("peaks") + QPEAKS + "select series, count(*) as n, case when count(*) >= 5 then round(median(dq), 9) end as fwhm_q from q group by series")
def estimate_fwhm_q(spark, folder):
    return rnd(ms.estimate_fwhm(good_in_q(spark, folder), ["series"]), 9, "fwhm_q")


@query("resolution_fit", cte("peaks") + QPEAKS + """
, c as (select series, q, dq, q - avg(q) over (partition by series) as t, avg(q) over (partition by series) as m from q)
, s as (select series, any_value(m) as m, count(*) as n, min(q) as lo, max(q) as hi, median(dq) as med, sum(t) as t1, sum(t*t) as t2, sum(t*t*t) as t3, sum(t*t*t*t) as t4, sum(dq*dq) as y0, sum(dq*dq*t) as y1, sum(dq*dq*t*t) as y2 from c group by series)
, d as (select *, n*(t2*t4-t3*t3) - t1*(t1*t4-t3*t2) + t2*(t1*t3-t2*t2) as det from s)
, a as (select *, (y0*(t2*t4-t3*t3) - t1*(y1*t4-t3*y2) + t2*(y1*t3-t2*y2)) / det as a0, (n*(y1*t4-t3*y2) - y0*(t1*t4-t3*t2) + t2*(t1*y2-y1*t2)) / det as a1,
  (n*(t2*y2-y1*t3) - t1*(t1*y2-y1*t2) + y0*(t1*t3-t2*t2)) / det as a2 from d)
select series, n, round(a2, 7) as c2, round(a1 - 2 * a2 * m, 7) as c1, round(a0 - a1 * m + a2 * m * m, 7) as c0, round(med, 8) as median from a""")
def resolution_fit(spark, folder):
    out = ms.resolution_curve(good_in_q(spark, folder), ["series"]).drop("ok")
    return rnd(rnd(out, 7, "c2", "c1", "c0"), 8, "median")


RING = """
, win as (select frame, azim, radial, y from cakes where abs(radial - 2.0) <= 0.55)
, b as (select frame, azim, median(y) as base, count(*) as cells from win group by 1, 2)
, e as (select w.frame, w.azim, cells, 1.4826 * median(abs(y - base)) as noise, max(greatest(y - base, 0)) as height, sum(greatest(y - base, 0)) as s, sum(radial * greatest(y - base, 0)) as mo from win w join b on w.frame = b.frame and w.azim = b.azim group by 1, 2, 3)
, ring as (select frame, azim, case when cells >= 3 and height >= 1.5 * case when noise > 0 then noise else 1 end then s end as intensity,
   case when cells >= 3 and height >= 1.5 * case when noise > 0 then noise else 1 end then mo / s end as centroid from e)
"""


def ring(spark, folder):
    return tx.ring_rows(view(spark, folder, "cakes"), r0=2.0, halfwidth=0.55, min_height=1.5)


@query("ring_profile", cte("cakes") + RING + "select frame, azim, round(intensity, 4) as intensity, round(centroid, 7) as centroid from ring")
def ring_profile(spark, folder):
    return rnd(rnd(ring(spark, folder), 4, "intensity"), 7, "centroid")


@query("texture_metrics", cte("cakes") + RING + """
, md as (select frame, median(intensity) as med from ring group by frame)
, f as (select r.frame, intensity as v, med, cos(2 * radians(azim)) as c, sin(2 * radians(azim)) as s from ring r join md on r.frame = md.frame)
, t as (select frame, count(*) as rws, count(v) as n, avg(v) as mean, stddev_pop(v) as sd, any_value(med) as med, avg(case when v is not null then case when v > 3 * med then 1.0 else 0.0 end end) as spotty,
  sum(case when v is not null then c end) as c, sum(case when v is not null then s end) as s, sum(case when v is not null then c*c end) as cc, sum(case when v is not null then s*s end) as ss, sum(case when v is not null then c*s end) as cs,
  sum(v) as y, sum(v*c) as yc, sum(v*s) as ys from f group by frame)
, x as (select *, n*(cc*ss-cs*cs) - c*(c*ss-cs*s) + s*(c*cs-cc*s) as det from t)
, k as (select *, (y*(cc*ss-cs*cs) - c*(yc*ss-cs*ys) + s*(yc*cs-cc*ys)) / det as c0, (n*(yc*ss-cs*ys) - y*(c*ss-cs*s) + s*(c*ys-yc*s)) / det as c1, (n*(cc*ys-yc*cs) - c*(c*ys-yc*s) + y*(c*cs-cc*s)) / det as c2 from x)
select frame, n, round(n / rws, 8) as coverage, case when n >= 3 and mean > 0 then round(sd / mean, 8) end as texture_index, case when n >= 3 and med > 0 then round(spotty, 8) end as spotty_frac,
  case when n >= 5 and c0 > 0 then round(sqrt(c1*c1 + c2*c2) / c0, 7) end as po_amplitude, case when n >= 5 then round(case when atan2(c2, c1) < 0 then degrees(atan2(c2, c1)) / 2 + 180 else degrees(atan2(c2, c1)) / 2 end, 6) end as po_phase_deg from k""")
def texture_metrics(spark, folder):
    out = tx.texture_metrics(ring(spark, folder))
    return rnd(rnd(rnd(out, 8, "coverage", "texture_index", "spotty_frac"), 7, "po_amplitude"), 6, "po_phase_deg")


PICK = """
, pf as (select frame, rbin, coalesce(avg(case when y > 0 then y end), 0) as y from cakes group by 1, 2)
, en as (select min(rbin) as a, max(rbin) as b from cakes)
, gr as (select f.frame, i.i, coalesce(pf.y, 0) as y from (select distinct frame from cakes) f cross join (select unnest(range(0, b - a + 1)) as i, a from en) i left join pf on pf.frame = f.frame and pf.rbin = a + i.i)
, md as (select frame, median(y) as med from gr group by 1)
, ma as (select g.frame, med, case when median(abs(y - med)) > 0 then 1.4826 * median(abs(y - med)) else 1 end as mad from gr g join md on md.frame = g.frame group by 1, 2)
, tp as (select * from (select g.*, lag(y) over w as l, lead(y) over w as r, med, mad from gr g join ma on ma.frame = g.frame window w as (partition by g.frame order by i)) t where y > l and y > r and y >= med + 1.0 * mad)
, iso as (select frame, unnest(list_reduce(list_transform(list_reverse_sort(list(struct_pack(y := y, i := i))), lambda p: [p]),
   lambda kept, p: case when len(list_filter(kept, lambda q: abs(q.i - p[1].i) < 4)) > 0 then kept else list_concat(kept, p) end)) as k from tp group by 1)
, ed as (select s.frame, s.k.i as i, s.k.y as y, mad, (select coalesce(max(j.i), -1) from gr j where j.frame = s.frame and j.i < s.k.i and j.y > s.k.y) as lo,
   (select coalesce(min(j.i), 1000000) from gr j where j.frame = s.frame and j.i > s.k.i and j.y > s.k.y) as hi from iso s join ma on ma.frame = s.frame)
, pr as (select e.frame, e.i, e.y, mad, e.y - greatest((select min(j.y) from gr j where j.frame = e.frame and j.i > lo and j.i <= e.i), (select min(j.y) from gr j where j.frame = e.frame and j.i >= e.i and j.i < hi)) as prominence from ed e)
, bs as (select * from (select *, row_number() over (partition by frame order by y desc, i desc) as n from pr where prominence >= 0.5 * mad) t where n <= 3)
, rings as (select frame, (row_number() over (partition by frame order by i) - 1)::int as ring, 1.05e0 + 0.05e0 * i as r0, y as height, prominence from bs)
"""


def picked(spark, folder):
    return tx.pick_rings(view(spark, folder, "cakes"), n_rings=3, separation=4, height=1.0, prominence=0.5)


@query("pick_rings", cte("cakes") + PICK + """
select frame, ring, round(r0, 6) as r0, round(height + 1e-7, 4) as height, round(prominence + 1e-7, 4) as prominence from rings""")
def pick_rings(spark, folder):
    out = picked(spark, folder).withColumn("height", F.col("height") + 1e-7).withColumn("prominence", F.col("prominence") + 1e-7)
    return rnd(rnd(out, 6, "r0"), 4, "height", "prominence")


RINGS = PICK + """
, win as (select r.frame, r.ring, azim, radial, y from cakes c join rings r on r.frame = c.frame and abs(radial - r0) <= 0.33)
, b as (select frame, ring, azim, median(y) as base, count(*) as cells from win group by 1, 2, 3)
, e as (select w.frame, w.ring, w.azim, cells, 1.4826 * median(abs(y - base)) as noise, max(greatest(y - base, 0)) as top, sum(greatest(y - base, 0)) as s from win w join b on w.frame = b.frame and w.ring = b.ring and w.azim = b.azim group by 1, 2, 3, 4)
, rg as (select frame, ring, azim, case when cells >= 3 and top >= 1.5 * case when noise > 0 then noise else 1 end then s end as v from e)
"""


@query("texture_of_rings", cte("cakes") + RINGS + """
, mv as (select frame, ring, median(v) as med from rg group by 1, 2)
, f as (select r.frame, r.ring, v, med, cos(2 * radians(azim)) as c, sin(2 * radians(azim)) as s from rg r join mv on r.frame = mv.frame and r.ring = mv.ring)
, t as (select frame, ring, count(*) as rws, count(v) as n, avg(v) as mean, stddev_pop(v) as sd, any_value(med) as med, avg(case when v is not null then case when v > 3 * med then 1.0 else 0.0 end end) as spotty,
  sum(case when v is not null then c end) as c, sum(case when v is not null then s end) as s, sum(case when v is not null then c*c end) as cc, sum(case when v is not null then s*s end) as ss, sum(case when v is not null then c*s end) as cs,
  sum(v) as y, sum(v*c) as yc, sum(v*s) as ys from f group by 1, 2)
, x as (select *, n*(cc*ss-cs*cs) - c*(c*ss-cs*s) + s*(c*cs-cc*s) as det from t)
, k as (select *, (y*(cc*ss-cs*cs) - c*(yc*ss-cs*ys) + s*(yc*cs-cc*ys)) / det as c0, (n*(yc*ss-cs*ys) - y*(c*ss-cs*s) + s*(c*ys-yc*s)) / det as c1, (n*(cc*ys-yc*cs) - c*(c*ys-yc*s) + y*(c*cs-cc*s)) / det as c2 from x)
select k.frame, k.ring, round(r0, 6) as r0, n, round(n / rws, 8) as coverage, case when n >= 3 and mean > 0 then round(sd / mean, 7) end as texture_index, case when n >= 3 and med > 0 then round(spotty, 8) end as spotty_frac,
  case when n >= 6 and c0 > 0 then round(sqrt(c1*c1 + c2*c2) / c0, 5) end as po_amplitude from k join rings g on g.frame = k.frame and g.ring = k.ring""")
def texture_of_rings(spark, folder):
    out = tx.texture_of_rings(view(spark, folder, "cakes"), picked(spark, folder), halfwidth=0.33, min_height=1.5)
    out = out.withColumn("po_amplitude", F.when(F.col("n") >= 6, F.round("po_amplitude", 5)))
    return rnd(rnd(rnd(out, 8, "coverage", "spotty_frac"), 7, "texture_index"), 6, "r0").drop("po_phase_deg")


@query("waviness_of_rings")
def waviness_of_rings(spark, folder):
    return tx.waviness_of_rings(view(spark, folder, "cakes"), picked(spark, folder), halfwidth=0.33, min_height=1.5)


@query("waviness_summary")
def waviness_summary(spark, folder):
    return tx.diagnose_waviness(waviness_of_rings(spark, folder), "q", 0.4, 0.3)[1]


@query("fit_waviness")
def fit_waviness(spark, folder):
    return tx.fit_waviness(ring(spark, folder))


@query("straighten_cake")
def straighten_cake(spark, folder):
    cakes = view(spark, folder, "cakes")
    return tx.straighten(cakes, tx.fit_waviness(ring(spark, folder)), RADIAL_STEP, RADIAL_START)


@query("circular_mean", cte("cakes") + """
select frame, round(degrees(atan2(sum(y * sin(radians(azim))), sum(y * cos(radians(azim))))), 6) as mean_azim from cakes group by frame""")
def circular_mean(spark, folder):
    return view(spark, folder, "cakes").groupBy("frame").agg(
        F.round(tx.circular_mean(F.col("azim"), F.col("y")), 6).alias("mean_azim"))


@query("circular_difference", cte("cakes") + """
select distinct frame, azim, round(abs((azim - (frame % 360) + 900) % 360 - 180), 8) as diff from cakes""")
def circular_difference(spark, folder):
    cakes = view(spark, folder, "cakes").select("frame", "azim").distinct()
    return cakes.withColumn("diff", F.round(axis.circular_difference(F.col("azim"), F.col("frame") % 360), 8))


@query("ring_removed", cte("cakes") + """
select frame, rbin, abin, round(y - median(y) over (partition by frame, rbin) + 1e-9, 5) as y from cakes""")
def ring_removed(spark, folder):
    return tx.ring_removed(view(spark, folder, "cakes")).select("frame", "rbin", "abin", F.round(F.col("y") + NUDGE, 5).alias("y"))


@query("radial_profile", cte("cakes") + """
select frame, rbin, round(coalesce(avg(case when y > 40000 then y - 40000 end), 0) + 1e-9, 5) as y from cakes group by 1, 2""")
def radial_profile(spark, folder):
    cakes = view(spark, folder, "cakes").withColumn("y", F.col("y") - 40000)
    return tx.radial_profile(cakes).select("frame", "rbin", F.round(F.col("y") + NUDGE, 5).alias("y"))


@query("cake_for_frame", cte("cakes") + "select frame, rbin, abin, round(y + 1e-9, 5) as y from cakes where frame = 7")
def cake_for_frame(spark, folder):
    return tx.cakes_of_frame(view(spark, folder, "cakes"), 7).select("frame", "rbin", "abin", F.round(F.col("y") + NUDGE, 5).alias("y"))


@query("integrate_mean", cte("pixels") + "select frame, rbin, round(avg(intensity) + 1e-9, 5) as mean, count(*) as n from pixels group by 1, 2")
def integrate_mean(spark, folder):
    return rnd_mean(rd.integrate(view(spark, folder, "pixels")), "mean")


@query("integrate_sector", cte("pixels") + "select frame, rbin, round(avg(intensity) + 1e-9, 5) as mean, count(*) as n from pixels where abin * 10 - 180 between -60 and 95 group by 1, 2")
def integrate_sector(spark, folder):
    pixels = view(spark, folder, "pixels").withColumn("azim", F.col("abin") * 10 - 180)
    return rnd_mean(rd.integrate(pixels, sector=rd.azimuth_range("-60, 95")), "mean")


@query("integrate_cake", cte("pixels") + "select frame, rbin, abin, round(avg(intensity) + 1e-9, 5) as y from pixels group by 1, 2, 3")
def integrate_cake(spark, folder):
    return rnd_mean(rd.cake(view(spark, folder, "pixels")), "y")


@query("integrate_band", cte("pixels") + """
, r as (select frame, rbin, intensity as v, row_number() over (partition by frame, rbin order by intensity) - 1 as k, count(*) over (partition by frame, rbin) as n from pixels)
select frame, rbin, round(coalesce(avg(v) filter (where k >= ceil(0.45 * (n - 1)) and k <= floor(0.55 * (n - 1))), median(v)) + 1e-9, 5) as robust from r group by 1, 2""")
def integrate_band(spark, folder):
    return rnd_mean(rd.band_mean(view(spark, folder, "pixels")), "robust")


CLIP = "".join(f"""
, m{i} as (select frame, rbin, avg(intensity) as m, coalesce(stddev_pop(intensity), 0) as s from p{i} group by 1, 2)
, p{i + 1} as (select p.* from pixels p join m{i} m on p.frame = m.frame and p.rbin = m.rbin where abs(intensity - m) <= 1.5 * s + 1e-9)""" for i in range(2))


@query("integrate_sigma_clip", cte("pixels") + ", p0 as (select * from pixels)" + CLIP + """
select frame, rbin, round(avg(intensity) + 1e-9, 5) as sigmaclip from p2 group by 1, 2""")
def integrate_sigma_clip(spark, folder):
    return rnd_mean(rd.sigma_clip(view(spark, folder, "pixels"), k=1.5, rounds=2), "sigmaclip")


@query("sum_by_pressure", cte("pixels") + """
, f as (select frame, (frame % 10) / 2 as pressure from pixels group by frame)
, s as (select pressure, rbin, abin, sum(intensity) as c, bool_or(intensity < 950) as bad from pixels p join f on p.frame = f.frame group by 1, 2, 3)
, i as (select pressure, rbin, avg(c) as intensity, sqrt(sum(c)) / count(*) as sigma from s where not bad group by 1, 2)
select pressure, rbin, round(intensity + 1e-9, 4) as intensity, round(sigma, 6) as sigma from i""")
def sum_by_pressure(spark, folder):
    pixels = view(spark, folder, "pixels")
    frames = pixels.select("frame").distinct().withColumn("pressure", (F.col("frame") % 10) / 2)
    marked = pixels.withColumn("intensity", F.when(F.col("intensity") < 950, -F.col("intensity")).otherwise(F.col("intensity")))
    out = rd.floor_sigma(rd.sum_by_pressure(marked, frames), ["pressure"])
    return out.select("pressure", "rbin", F.round(F.col("intensity") + NUDGE, 4).alias("intensity"), F.round("sigma", 6).alias("sigma"))


