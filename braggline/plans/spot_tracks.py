"""Spot tracking: detections, rings they lie on, points and tracks."""

from pyspark.sql import functions as F

from ..operators import spot_tracking as st, spots as sp
from ..sources.tables import cte, view
from .registry import query

STEP = 5.0  # pressures of the frames are rounded down to this many GPa: one point of the ladder
DETECTION = dict(n_azim=36, bin_a=10.0, bin_r=0.05, min_snr=1.2, min_samples=12, max_azim=60.0, max_radial=6)

# Blobs in SQL: every cell reaches the bright cells beside it, azimuth wrapping round; the smallest one names the blob.
BLOBS = cte("cakes", "peaks", "frames").replace("with ", "with recursive ", 1) + """
, lev as (select frame, rbin, median(y) as level, count(*) as n from cakes group by 1, 2)
, exc as (select c.*, y - level as excess from cakes c join lev l on c.frame = l.frame and c.rbin = l.rbin where n >= 12)
, sig as (select frame, rbin, 1.4826 * median(abs(excess)) as sigma from exc group by 1, 2)
, bright as (select e.*, sigma from exc e join sig s on e.frame = s.frame and e.rbin = s.rbin where excess > greatest(1.2 * sigma, 20))
, reach as (
  select frame, abin, rbin, abin * 1000 + rbin as blob from bright
  union
  select b.frame, b.abin, b.rbin, r.blob from reach r join bright b on b.frame = r.frame and abs(b.rbin - r.rbin) <= 1 and (abs(b.abin - r.abin) <= 1 or abs(b.abin - r.abin) = 35))
, named as (select frame, abin, rbin, min(blob) as blob from reach group by 1, 2, 3)
, cell as (select b.*, n.blob from bright b join named n on n.frame = b.frame and n.abin = b.abin and n.rbin = b.rbin)
, brightest as (select frame, blob, abin as top_a, radial as q_peak, excess as peak, sigma as top_sigma from (
  select *, row_number() over (partition by frame, blob order by excess desc, abin, rbin) as k from cell) t where k = 1)
, turned as (select c.*, q_peak, peak, top_sigma, 10.0 * ((c.abin - top_a + 18 + 36) % 36 - 18) as turn from cell c join brightest t on t.frame = c.frame and t.blob = c.blob)
, mid as (select frame, blob, sum(radial * excess) / sum(excess) as q, sum(turn * excess) / sum(excess) as turn0,
  degrees(atan2(sum(sin(radians(azim)) * excess), sum(cos(radians(azim)) * excess))) as azim, sum(excess) as area, count(*) as n_pixels,
  max(rbin) - min(rbin) + 1 as long_r, max(turn) - min(turn) + 10 as long_a, any_value(q_peak) as q_peak, any_value(peak) as peak, any_value(top_sigma) as top_sigma from turned group by 1, 2)
, wid as (select t.frame, t.blob, greatest(2.3548 * sqrt(sum(pow(radial - q, 2) * excess) / sum(excess)), 0.05) as q_width,
  greatest(2.3548 * sqrt(sum(pow(turn - turn0, 2) * excess) / sum(excess)), 10) as azim_width from turned t join mid m on m.frame = t.frame and m.blob = t.blob group by 1, 2)
, spot as (select m.*, q_width, azim_width, row_number() over (partition by m.frame order by peak desc, m.blob) - 1 as spot
  from mid m join wid w on w.frame = m.frame and w.blob = m.blob where n_pixels >= 2 and long_r <= 6 and long_a <= 60)"""

STATES = """
, state as (select frame, floor(pressure / 5) * 5.0 as pressure, excluded from frames)"""

RINGS = """
, ring as (select coalesce('p' || s.pressure::string, 'f' || p.frame::string) as place, center - greatest(2 * fwhm, 0.05) as low, center + greatest(2 * fwhm, 0.05) as high
  from peaks p left join state s on s.frame = p.frame where phase <> '')
, begun as (select *, case when low <= max(high) over (partition by place order by low, high rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from ring)
, numbered as (select *, sum(fresh) over (partition by place order by low, high rows unbounded preceding) as win from begun)
, windows as (select place, min(low) as low, max(high) as high from numbered group by place, win)"""


def states(spark, folder):
    """Frames with their pressure to the step below, one ladder over all."""
    return view(spark, folder, "frames").select("frame", (F.floor(F.col("pressure") / STEP) * STEP).alias("pressure"), "excluded")


def run(spark, folder):
    """The spot tables of all cakes; the run is the frames that have one."""
    cakes = view(spark, folder, "cakes")
    frames = states(spark, folder).join(cakes.select("frame").distinct(), "frame", "left_semi")
    return st.track_spots(cakes, frames, view(spark, folder, "peaks"), link_q_rel=0.1, link_azim_tol=25.0, max_gap=10, min_points=2, **DETECTION)


@query("detect_spots", BLOBS + """
select frame, spot::int as spot, round(q, 6) as q, round(azim, 5) as azim, round(peak + 1e-9, 5) as intensity, round(area + 1e-9, 5) as area,
  case when top_sigma > 0 then round(peak / top_sigma, 6) end as snr, round(q_width, 6) as q_width, round(azim_width, 5) as azim_width, n_pixels::int as n_pixels from spot""")
def detect_spots(spark, folder):
    out = sp.detect_spots(view(spark, folder, "cakes"), **DETECTION)
    return out.select("frame", "spot", F.round("q", 6).alias("q"), F.round("azim", 5).alias("azim"), F.round(F.col("intensity") + 1e-9, 5).alias("intensity"),
                      F.round(F.col("area") + 1e-9, 5).alias("area"), F.when(F.col("snr") < float("inf"), F.round("snr", 6)).alias("snr"),
                      F.round("q_width", 6).alias("q_width"), F.round("azim_width", 5).alias("azim_width"), "n_pixels")


@query("ring_windows", cte("peaks", "frames") + STATES + RINGS + """
select place, round(low, 6) as low, round(high, 6) as high from windows""")
def ring_windows(spark, folder):
    out = st.ring_windows(view(spark, folder, "peaks"), states(spark, folder), bin_r=DETECTION["bin_r"])
    return out.select("place", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("spot_detections", BLOBS + STATES.replace("from frames", "from frames where frame in (select frame from cakes)") + RINGS + """
, ladder as (select pressure, dense_rank() over (order by pressure) - 1 as position from (select distinct pressure from state where pressure is not null) t)
select s.frame || '-' || s.spot as id, s.frame, l.position::bigint as position, t.pressure, round(2 * pi() / q, 6) as d, round(peak + 1e-9, 5) as intensity,
  exists (select 1 from windows w where w.place = coalesce('p' || t.pressure::string, 'f' || s.frame::string) and q_peak >= w.low and q_peak <= w.high) as on_ring
from spot s left join state t on t.frame = s.frame left join ladder l on l.pressure = t.pressure where not coalesce(t.excluded, false)""")
def spot_detections(spark, folder):
    """Every detection with its place on the ladder and whether it lies on a powder ring of its pressure."""
    return run(spark, folder).detections.select("id", "frame", "position", "pressure", F.round("d", 6).alias("d"),
                                                F.round(F.col("intensity") + 1e-9, 5).alias("intensity"), "on_ring")


@query("spot_points")
def spot_points(spark, folder):
    """Consolidated reflections of every pressure, with their tracks."""
    return run(spark, folder).points


@query("spot_tracks")
def spot_tracks(spark, folder):
    """Tracks of spots with the closest line of the library."""
    return st.label_tracks(run(spark, folder).tracks, view(spark, folder, "reflections"))
