"""Tracks, clusters, transitions and rankings."""

import math

from pyspark.sql import functions as F

from ..functions import axis
from ..operators import correlations as co
from ..operators import ranking as rk
from ..operators import tracks as tr
from ..sources.tables import base, cte, patterns, radial_axis, view
from .registry import query

TRACKS = """
, ends as (select series, track, count(*) as n_points, min(position) as first, max(position) as last, arg_min(center, position) as center_first, arg_max(center, position) as center_last, sum(amplitude) as amplitude_sum from track_points group by 1, 2)
"""


@query("track_summary", cte("track_points") + TRACKS + """
select series, track, n_points, first, last, center_first, center_last, round(amplitude_sum, 3) as amplitude_sum from ends""")
def track_summary(spark, folder):
    return tr.track_summary(view(spark, folder, "track_points")).withColumn("amplitude_sum", F.round("amplitude_sum", 3))


@query("track_edges", cte("track_points") + """
, e as (select series, track, lag(position) over w as "from", position as "to", center - lag(center) over w as shift from track_points window w as (partition by series, track order by position))
select series, track, "from", "to", round(shift, 9) as shift from e where "from" is not null""")
def track_edges(spark, folder):
    return tr.track_edges(view(spark, folder, "track_points")).withColumn("shift", F.round("shift", 9))


TRANSITIONS = TRACKS + """
, fr as (select distinct series, position from track_points)
, st as (select series, lag(position) over (partition by series order by position) as f, position as t from fr)
, pa as (select * from st where f is not null)
, sh as (select p.series, f, t, median(abs(b.center - a.center)) as m from pa p join track_points a on a.series = p.series and a.position = f join track_points b on b.series = p.series and b.position = t and b.track = a.track group by 1, 2, 3)
, tc as (select p.series, f, t, count(*) filter (where e.first = t) as births, count(*) filter (where e.last = f) as deaths, count(*) filter (where e.first <= f and e.last >= t) as n_active from pa p join ends e on e.series = p.series group by 1, 2, 3)
"""


@query("transition_summary", cte("track_points") + TRANSITIONS + """
select tc.series, tc.f as "from", tc.t as "to", births, deaths, n_active, round(m, 9) as median_center_shift, births + deaths >= greatest(2, ceil(0.25 * n_active)) as transition_candidate
from tc left join sh on sh.series = tc.series and sh.f = tc.f and sh.t = tc.t""")
def transition_summary(spark, folder):
    points = view(spark, folder, "track_points")
    out = tr.transition_summary(points, points.select("series", "position").distinct())
    return out.withColumn("median_center_shift", F.round("median_center_shift", 9))


@query("transition_windows", cte("track_points") + TRANSITIONS + """
, wd as (select series, position as t, median(fwhm * (track_len - 3)) as w from (select series, position, fwhm, length(track) as track_len from track_points) q group by 1, 2)
, wm as (select count(*) as n, median(w) as md from wd), wa as (select median(abs(w - md)) as mad from wd, wm)
select tc.series, tc.f as "from", tc.t as "to", births, deaths, n_active, round(w, 9) as window_direct_median,
  births + deaths >= greatest(2, ceil(0.25 * n_active)) or coalesce(n >= 4 and w < md - 2 * 1.4826 * mad, false) as transition_candidate
from tc left join wd on wd.series = tc.series and wd.t = tc.t, wm, wa""")
def transition_windows(spark, folder):
    points = view(spark, folder, "track_points")
    windows = points.select("series", "position", (F.col("fwhm") * (F.length("track") - 3)).alias("direct"))
    out = tr.transition_summary(points, points.select("series", "position").distinct(), windows)
    return out.drop("median_center_shift").withColumn("window_direct_median", F.round("window_direct_median", 9))


@query("predict_center", cte("track_points") + """
, r as (select series, track, position, center, regr_slope(center, position) over w as s, count(*) over w as n, lead(position) over (partition by series, track order by position) as nxt from track_points
  window w as (partition by series, track order by position rows 3 preceding))
select series, track, position, round(center + case when n >= 2 then s else 0 end * (nxt - position), 8) as expected from r where nxt is not null""")
def predict_center(spark, folder):
    from pyspark.sql import Window
    points = view(spark, folder, "track_points")
    # A track holds at most one point per position of its series.
    recent = Window.partitionBy("series", "track").orderBy("position")
    last4 = recent.rowsBetween(-3, 0)
    slope = F.when(F.count(F.lit(1)).over(last4) >= 2, F.regr_slope("center", F.col("position").cast("double")).over(last4)).otherwise(0.0)
    out = points.withColumn("_s", slope).withColumn("_next", F.lead("position").over(recent)).where("_next is not null")
    return out.select("series", "track", "position", F.round(
        F.col("center") + F.col("_s") * (F.col("_next") - F.col("position")), 8).alias("expected"))


def observations(spark, folder):
    return folded(view(spark, folder, "observations"))


def folded(rows):
    """One row per observation, series and frame."""
    rows = rows.groupBy("obs", "series", "frame").agg(
        F.max("center").alias("center"), F.max("amplitude").alias("amplitude"), F.max("fwhm").alias("fwhm"))
    return rows.withColumn("position", F.col("frame")).withColumn("axis", F.col("frame").cast("double"))


@query("link_tracks")
def link_tracks(spark, folder):
    return tr.link_tracks(observations(spark, folder), ["series"])


@query("link_tracks_predicted")
def link_tracks_predicted(spark, folder):
    return tr.link_tracks(observations(spark, folder), ["series"], predict=True, max_axis_gap=8.0)


@query("build_roi_tracks")
def build_roi_tracks(spark, folder):
    from ..operators.roi_tracks import build_tracks
    # All good peaks of a frame; copies of a peak are told apart by their slots.
    rows = view(spark, folder, "pattern_peaks").select("frame", "peak_id", "center", "width", "area", "flag")
    peaks = co.prepare_peaks(rows.withColumn("series", F.floor(F.col("frame") / 50)), 1.0, 4.15, 0.05)
    return build_tracks(peaks, patterns(spark, folder).select("frame", "clean"), "clean", radial_axis(), ["series"], max_gap=2)


EDGE_LIST = """list_reduce(list_transform(list_sort(list(struct_pack(gap := gap, u := -sim, a := a, b := b, sim := sim, shift := shift, ag := ag))), lambda p: [p]),
  lambda kept, p: case when len(list_filter(kept, lambda q: q.a = p[1].a or q.b = p[1].b)) > 0 then kept else list_concat(kept, p) end)"""
PATHS = """
, o as (select obs, series, frame, max(center) as center, max(amplitude) as amp, max(fwhm) as w from observations group by 1, 2, 3)
, r as (select *, dense_rank() over (partition by series order by frame) - 1 as rank from o)
, p1 as (select a.series, a.rank, a.obs as a, b.obs as b, abs(b.center - a.center) as gap, least(a.amp, b.amp) / greatest(a.amp, b.amp) as sim, b.center - a.center as shift, (b.frame - a.frame)::double as ag
   from r a join r b on b.series = a.series and b.rank = a.rank + 1 where abs(b.center - a.center) <= 1.5 * greatest(a.w, b.w, 1e-9) and least(a.amp, b.amp) / greatest(a.amp, b.amp) >= 0.5)
, e1 as (select series, unnest(""" + EDGE_LIST + """) as k from p1 group by series, rank)
, p2 as (select a.series, a.rank, a.obs as a, b.obs as b, abs(b.center - a.center) as gap, least(a.amp, b.amp) / greatest(a.amp, b.amp) as sim, b.center - a.center as shift, (b.frame - a.frame)::double as ag
   from (select * from r where obs not in (select k.a from e1)) a join (select * from r where obs not in (select k.b from e1)) b on b.series = a.series and b.rank = a.rank + 2
   where abs(b.center - a.center) <= 1.5 * greatest(a.w, b.w, 1e-9) and least(a.amp, b.amp) / greatest(a.amp, b.amp) >= 0.5)
, e2 as (select series, unnest(""" + EDGE_LIST + """) as k from p2 group by series, rank)
, ed as (select series, 1 as silence, k.a as a, k.b as b, k.sim as sim, k.shift as shift, k.ag as ag from e1 union all select series, 2, k.a, k.b, k.sim, k.shift, k.ag from e2)
, pa as (select a as obs, a as track from ed where a not in (select b from ed) union all select e.b, p.track from pa p join ed e on e.a = p.obs)
, ln as (select track, count(*) as n_obs from pa group by 1 having count(*) >= 3)
, ke as (select pa.track, ed.* from ed join pa on pa.obs = ed.a join ln on ln.track = pa.track)
"""


def track_paths(spark, folder):
    """All peaks of all series, linked by edges between neighbouring ranks; the likeness is that of the amplitudes."""
    from ..operators import roi_tracks as rt
    like = F.try_divide(F.least("feature_a", "feature_b"), F.greatest("feature_a", "feature_b"))

    def paths(rows, whole):
        rows = folded(rows).select("series", "obs", "frame", "axis", "center", F.col("fwhm").alias("width"), F.col("amplitude").alias("feature"))
        placed = rt.ranked(rows, ["series"], "frame", whole)
        edges = rt.link_edges(placed, ["series"], like, max_gap=1, min_similarity=0.5, whole=whole)
        return rt.track_paths(placed, edges, ["series"], whole=whole)

    # Short series are shuffled once and stay in their task from here on.
    short, long = rt.by_length(view(spark, folder, "observations"), ["series"])
    found = paths(short.repartition("series"), True)
    return found if long is None else tuple(a.unionByName(b, allowMissingColumns=True) for a, b in zip(found, paths(long, False)))


@query("roi_track_edges", cte("observations").replace("with ", "with recursive ", 1) + PATHS + """
select series, track, a as obs_a, b as obs_b, silence, round(sim, 9) as similarity, round(shift, 9) as center_shift, ag as axis_gap from ke""")
def roi_track_edges(spark, folder):
    kept = track_paths(spark, folder)[1]
    return kept.select("series", "track", "obs_a", "obs_b", "silence", F.round("similarity", 9).alias("similarity"),
                       F.round("center_shift", 9).alias("center_shift"), "axis_gap")


@query("roi_track_summary", cte("observations").replace("with ", "with recursive ", 1) + PATHS + """
, sm as (select track, avg(sim) as mean_similarity from ke group by 1)
select r.series, pa.track, count(*) as n_obs, min(rank) as first_rank, max(rank) as last_rank, arg_min(center, rank) as center_first, arg_max(center, rank) as center_last,
  min(frame)::double as axis_first, max(frame)::double as axis_last, round(any_value(mean_similarity), 8) as mean_similarity
from pa join ln on ln.track = pa.track join r on r.obs = pa.obs join sm on sm.track = pa.track group by 1, 2""")
def roi_track_summary(spark, folder):
    return track_paths(spark, folder)[2].withColumn("mean_similarity", F.round("mean_similarity", 8))


@query("unknown_clusters")
def unknown_clusters(spark, folder):
    """All observations linked, clustered and summed up; the clusters are those of the tracks."""
    summary = tr.unknown_series(observations(spark, folder), ["series"], 2 * math.pi / F.col("center"))[1]
    return summary


SETS = """
with points as (select o_orderkey::string as track, l_suppkey as frame, sum(l_extendedprice) as amplitude from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)
, sets as (select track, list(distinct frame order by frame) as items from points group by track)
, folded as (select items, min(track) as id from sets group by items)
, it as (select id, items, unnest(items) as i from folded)
, pr as (select a.id as a, b.id as b, count(*) / (len(any_value(a.items)) + len(any_value(b.items)) - count(*)) as j from it a join it b on a.i = b.i and a.id <> b.id group by a.id, b.id)
, ed as (select a, b, j from pr where j >= 0.6)
"""


def crowd(spark, folder):
    orders = base(spark, folder, "orders").select("o_orderkey")
    return (base(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_orderkey").cast("string").alias("track"), F.col("l_suppkey").alias("frame"))
            .agg(F.sum("l_extendedprice").alias("amplitude")))


@query("track_jaccard", SETS + "select least(a, b) as a, greatest(a, b) as b, round(max(j), 8) as jaccard from ed group by 1, 2")
def track_jaccard(spark, folder):
    sets = crowd(spark, folder).groupBy("track").agg(F.sort_array(F.collect_set("frame")).alias("items"))
    folded = sets.groupBy("items").agg(F.min("track").alias("id"))
    out = tr.similar_sets(folded.select("id", "items"), 0.6)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("jaccard", 8).alias("jaccard"))


# The closure of the edges, whose smallest member names a cluster.
CLUSTERS = SETS.replace("with points", "with recursive points") + """
, reach(node, root) as (select id, id from folded union select r.node, e.b from reach r join ed e on e.a = r.root)
, comp as (select node, min(root) as cluster from reach group by 1)
, cl as (select s.track, c.cluster from sets s join folded f on f.items = s.items join comp c on c.node = f.id)
"""


@query("cluster_tracks", CLUSTERS + "select track, cluster from cl")
def cluster_tracks(spark, folder):
    return tr.cluster_tracks(crowd(spark, folder), 0.6)


def supplier_points(spark, folder):
    return view(spark, folder, "track_points").groupBy("track", F.col("position").alias("frame")).agg(
        F.max("amplitude").alias("amplitude"), F.max("center").alias("center"))


UNKNOWN = """
, pts as (select track, position as frame, max(amplitude) as amplitude, max(center) as center from track_points group by 1, 2)
, cl as (select track, string_split(track, '-')[1] as cluster from pts group by track having count(*) > 8)
, joined as (select p.*, c.cluster from pts p join cl c on p.track = c.track)
, cf as (select cluster, frame, count(distinct track) as n from joined group by 1, 2)
, rf as (select cluster, arg_min(frame, row(-n, frame)) as ref_frame from cf group by cluster)
"""


def known_clusters(points):
    return points.groupBy("track").agg(F.count(F.lit(1)).alias("n")).where("n > 8").select(
        "track", F.get(F.split("track", "-"), F.lit(0)).alias("cluster"))


@query("cluster_summary", cte("track_points") + UNKNOWN + """
select j.cluster, count(distinct track) as n_tracks, count(*) as n_obs, min(frame) as first_frame, max(frame) as last_frame, round(sum(amplitude), 3) as amplitude_sum, any_value(ref_frame) as ref_frame
from joined j join rf on rf.cluster = j.cluster group by j.cluster""")
def cluster_summary(spark, folder):
    points = supplier_points(spark, folder)
    return tr.cluster_summary(points, known_clusters(points)).withColumn("amplitude_sum", F.round("amplitude_sum", 3))


@query("unknown_diagram", cte("track_points") + UNKNOWN + """
select p.track, p.frame, p.center, coalesce(c.cluster, '-1') as cluster from pts p left join cl c on p.track = c.track""")
def unknown_diagram(spark, folder):
    points = supplier_points(spark, folder)
    return tr.unknown_diagram(points, known_clusters(points)).select("track", "frame", "center", "cluster")


@query("unknown_fingerprints", cte("track_points") + UNKNOWN + """
select j.cluster, j.track, round(2 * pi() / center, 8) as d from joined j join rf on rf.cluster = j.cluster and rf.ref_frame = j.frame""")
def unknown_fingerprints(spark, folder):
    points = supplier_points(spark, folder)
    clusters = known_clusters(points)
    out = tr.fingerprints(points, clusters, tr.cluster_summary(points, clusters), axis.radial_to_d(F.col("center"), "q"))
    return out.withColumn("d", F.round("d", 8))


@query("unknown_report", cte("track_points") + UNKNOWN + """
select cluster, count(*) as n_obs, count(distinct frame) as n_frames, array_to_string(list(distinct frame order by frame), ';') as frames from joined group by cluster having count(*) >= 300 and count(distinct frame) >= 10""")
def unknown_report(spark, folder):
    points = supplier_points(spark, folder)
    rows = points.join(known_clusters(points), "track")
    return (rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct("frame").alias("n_frames"),
                                        F.array_join(F.transform(F.sort_array(F.collect_set("frame")), lambda f: f.cast("string")), ";").alias("frames"))
            .where((F.col("n_obs") >= 300) & (F.col("n_frames") >= 10)))


SCORES = """
, sc as (select frame, phase, max(1 - fwhm * 8 + amplitude / 1e6) as score from peaks where phase <> '' group by 1, 2)
, rk as (select *, row_number() over (partition by frame order by score desc, phase) as rank from sc)
, truth as (select frame, phase from peaks where phase <> '' and flag = 2 group by 1, 2)
"""


def scores(spark, folder):
    peaks = view(spark, folder, "peaks").where("phase <> ''")
    return peaks.groupBy("frame", "phase").agg(F.max(1 - F.col("fwhm") * 8 + F.col("amplitude") / 1e6).alias("score"))


@query("rank_top_k", cte("peaks") + SCORES + "select frame, phase, rank, round(score, 9) as score from rk where rank <= 3")
def rank_top_k(spark, folder):
    return rk.top_candidates(scores(spark, folder), 3).select(
        "frame", "phase", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query("candidate_shortlist", cte("peaks") + SCORES + "select distinct phase from rk where rank <= 1")
def candidate_shortlist(spark, folder):
    return rk.shortlist(rk.top_candidates(scores(spark, folder), 1))


@query("rank_metrics", cte("peaks") + SCORES + """
, b as (select r.frame, min(rank) as rank from rk r join truth t on r.frame = t.frame and r.phase = t.phase group by r.frame)
select count(*) as n_scored, round(avg(case when rank = 1 then 1.0 else 0.0 end), 8) as hit_at_1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 8) as hit_at_k, round(avg(1.0e0 / rank), 8) as mrr from b""")
def rank_metrics(spark, folder):
    truth = view(spark, folder, "peaks").where("phase <> '' and flag = 2").select("frame", "phase").distinct()
    out = rk.rank_metrics(scores(spark, folder), truth, 3)
    return out.select("n_scored", *[F.round(c, 8).alias(c) for c in ("hit_at_1", "hit_at_k", "mrr")])


@query("roc_auc", """
with s as (select l_extendedprice as v, l_returnflag = 'R' as y from lineitem)
, c as (select v, count(*) filter (where y) as p, count(*) filter (where not y) as n from s group by v)
, r as (select *, sum(n) over (order by v rows unbounded preceding) - n / 2 as w from c)
select round(sum(p * w) / (sum(p) * sum(n)), 9) as auc, sum(p)::bigint as n_pos, sum(n)::bigint as n_neg from r""")
def roc_auc(spark, folder):
    rows = base(spark, folder, "lineitem").select(
        "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rk.roc_auc(rows, "y", "l_extendedprice").withColumn("auc", F.round("auc", 9))


GRID = [1.55 + 0.025 * i for i in range(180)]


def library(spark, folder):
    lines = view(spark, folder, "reflections")
    # Lines per phase are bounded by the size classes of the part table.
    packed = lines.groupBy("phase").agg(F.sort_array(F.collect_list(F.struct("d", "w"))).alias("l"))
    return packed.select("phase", F.col("l.d").alias("d0"), F.col("l.w").alias("weights"))


MATRIX = """
, dd as (select frame, 'masked' as channel, 2 * pi() / radial as d, coalesce(masked, 0) as y from bins union all select frame, 'clean', 2 * pi() / radial, coalesce(clean, 0) from bins)
, g as (select i, 1.55 + 0.025 * i as x from (select unnest(range(0, 180)) as i))
, seg as (select frame, channel, d as d0, lead(d) over w as d1, y as y0, lead(y) over w as y1 from dd window w as (partition by frame, channel order by d))
, v as (select s.frame, channel, i, greatest(0, y0 + (y1 - y0) * (x - d0) / (d1 - d0)) as y from g join seg s on x >= d0 and x < d1)
, t as (select frame, channel, sum(y) as total from v group by 1, 2)
, idf as (select frame, 'band' || floor(center)::bigint as phase, avg(width) * 10 as confidence, max(center) as pressure from pattern_peaks group by 1, 2)
, lb as (select frame, string_agg(phase, ',' order by phase) filter (confidence >= 1.0) as present, count(*) as n_labels, max(pressure) as top from idf group by 1)
, gp as (select frame, count(*) as n_good from pattern_peaks where flag = 0 group by 1)
select t.frame, t.channel, round(total, 5) as total, coalesce(present, '') as present, coalesce(n_labels, 0)::int as n_labels, top, coalesce(n_good, 0) as n_good
from t left join lb on lb.frame = t.frame left join gp on gp.frame = t.frame where t.frame % 13 <> 0
"""


@query("labelled_matrix", cte("bins", "pattern_peaks") + MATRIX)
def labelled_matrix(spark, folder):
    peaks = view(spark, folder, "pattern_peaks")
    bands = peaks.groupBy("frame", F.concat(F.lit("band"), F.floor("center").cast("string")).alias("phase")).agg(
        (F.avg("width") * 10).alias("confidence"), F.max("center").alias("pressure"))
    rows = patterns(spark, folder).withColumn("excluded", F.col("frame") % 13 == 0)
    axis_d = [2 * math.pi / q for q in radial_axis()]
    out = rk.labelled_matrix(rows, ["masked", "clean"], axis_d, GRID, bands, peaks.where("flag = 0"), seen=1.0, normalize=False)
    return out.select("frame", "channel", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"),
                      F.array_join(F.transform(F.filter("labels", lambda x: x["present"]), lambda x: x["phase"]), ",").alias("present"),
                      F.size("labels").alias("n_labels"), F.array_max(F.transform("labels", lambda x: x["pressure"])).alias("top"), "n_good")


@query("frame_features", cte("bins") + """
, dd as (select frame, 2 * pi() / radial as d, greatest(coalesce(masked, 0), -1e9) as y from bins)
, g as (select i, 1.55 + 0.025 * i as x from (select unnest(range(0, 180)) as i))
, seg as (select frame, d as d0, lead(d) over (partition by frame order by d) as d1, y as y0, lead(y) over (partition by frame order by d) as y1 from dd)
, v as (select s.frame, i, greatest(0, y0 + (y1 - y0) * (x - d0) / (d1 - d0)) as y from g join seg s on x >= d0 and x < d1)
select f.frame, count(v.i) as n_inside, round(sum(v.y / mx), 6) as total from (select frame, max(y) as mx from v group by frame) f join v on v.frame = f.frame group by f.frame""")
def frame_features(spark, folder):
    from ..functions.arrays import array_sum
    d = [6.283185307179586 / r for r in radial_axis()]
    lo, hi = min(d), max(d)
    inside = sum(lo <= g < hi for g in GRID)
    rows = patterns(spark, folder).select("frame", rk.resample_to_d(F.col("masked"), d, GRID).alias("x"))
    return rows.select("frame", F.lit(inside).cast("long").alias("n_inside"), F.round(array_sum(F.col("x")), 6).alias("total"))


@query("cosine_rank", cte("bins", "reflections") + """
, dd as (select frame, 2 * pi() / radial as d, clean as y from bins)
, g as (select i, 1.55 + 0.025 * i as x from (select unnest(range(0, 180)) as i))
, seg as (select frame, d as d0, lead(d) over (partition by frame order by d) as d1, y as y0, lead(y) over (partition by frame order by d) as y1 from dd)
, m as (select s.frame, i, greatest(0, y0 + (y1 - y0) * (x - d0) / (d1 - d0)) as y from g join seg s on x >= d0 and x < d1)
, mn as (select frame, sqrt(sum(y * y)) as n from m group by frame)
, sm as (select phase, i, sum(w * (0.5 / (1 + pow(2 * (x - d) / 0.05, 2)) + 0.5 * exp(-ln(2) * pow(2 * (x - d) / 0.05, 2)))) as s from g, reflections group by phase, i)
, sn as (select phase, sqrt(sum(s * s)) as n from sm group by phase)
, sc as (select m.frame, sm.phase, sum(m.y * sm.s) / (any_value(mn.n) * any_value(sn.n)) as score from m join sm on m.i = sm.i join mn on mn.frame = m.frame join sn on sn.phase = sm.phase group by 1, 2)
, rk as (select *, row_number() over (partition by frame order by score desc, phase) as rank from sc)
select frame, phase, rank, round(score, 7) as score from rk where rank <= 3""")
def cosine_rank(spark, folder):
    d = [6.283185307179586 / r for r in radial_axis()]
    frames = patterns(spark, folder).select("frame", rk.resample_to_d(F.col("clean"), d, GRID).alias("meas"))
    sims = rk.simulated_patterns(library(spark, folder).withColumnRenamed("d0", "centers"), GRID, fwhm_d=0.05).select("phase", "simulated")
    scored = rk.pair_with_library(frames, sims).select("frame", "phase", rk.cosine("meas", "simulated").alias("score"))
    return rk.top_candidates(scored, 3).select("frame", "phase", F.col("rank").cast("long").alias("rank"), F.round("score", 7).alias("score"))


@query("candidate_pressures", cte("frames", "phases") + """
, f as (select frame, pressure, case frame % 3 when 0 then 'ECONOMY' when 1 then 'SMALL' else 'PROMO' end as phase from frames)
select frame, f.phase, array_to_string(list_transform(case when pressure is not null then [least(pressure, case when p_max > 0 then p_max else 1e9 end)]
 when p_max > 0 then [0.0, 20.0, 30.0] else [0.0, 20.0, 40.0, 60.0] end, lambda v: (round(v * 10))::bigint::string), ';') as tenths from f join phases p on p.phase = f.phase""")
def candidate_pressures(spark, folder):
    frames = view(spark, folder, "frames").withColumn("phase", F.when(F.col("frame") % 3 == 0, "ECONOMY").when(F.col("frame") % 3 == 1, "SMALL").otherwise("PROMO"))
    rows = frames.join(view(spark, folder, "phases"), "phase")
    tried = rk.candidate_pressures(F.col("pressure"), F.col("p_max"), F.lit(True), [0, 20, 40, 60])
    return rows.select("frame", "phase", F.array_join(F.transform(tried, lambda p: F.round(p * 10).cast("long").cast("string")), ";").alias("tenths"))
