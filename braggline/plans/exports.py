"""Export tables and run bookkeeping."""

from pyspark.sql import functions as F

from ..operators import corpus
from ..operators import correlations as co
from ..sources import files
from ..sources.tables import base, cte, view
from .correlations import TOL
from .registry import query


@query("peaks_export", cte("peaks", "frames") + """
select p.peak_id, p.frame, filename, center, area, phase from peaks p join frames f on p.frame = f.frame where not excluded and flag = 0""")
def peaks_export(spark, folder):
    frames = view(spark, folder, "frames").where(~F.col("excluded")).select("frame", "filename")
    return view(spark, folder, "peaks").where("flag = 0").join(frames, "frame").select(
        "peak_id", "frame", "filename", "center", "area", "phase")


@query("frame_export", cte("bins") + """
select frame, bin::int as bin, round(radial, 9) as radial, round(clean, 7) as clean from bins where not exists (select 1 from (values (2.23e0), (3.1e0)) v(d) where radial between 2 * pi() / d * 0.972 and 2 * pi() / d * 1.028)""")
def frame_export(spark, folder):
    from ..operators.matching import d_window_mask
    from ..sources.tables import bins
    keep = ~d_window_mask(F.col("radial"), "q", None, [2.23, 3.1])
    return files.frame_export(bins(spark, folder, "clean"), keep).select(
        "frame", "bin", F.round("radial", 9).alias("radial"), F.round("clean", 7).alias("clean"))


@query("anchor_summary", cte("pattern_peaks") + f""", u as (select distinct peak_id, frame, center from pattern_peaks where flag = 0)
, m as (select a.peak_id, b.peak_id as match_id, 1 - abs(a.center - b.center) / {TOL} as similarity, row_number() over (partition by a.peak_id order by abs(a.center - b.center), b.peak_id) as rank
  from u a join u b on a.frame <> b.frame and abs(a.center - b.center) < {TOL})
select peak_id, max(case when rank = 1 then match_id end) as match1_match_id, round(max(case when rank = 1 then similarity end), 7) as match1_similarity,
 max(case when rank = 2 then match_id end) as match2_match_id, round(max(case when rank = 2 then similarity end), 7) as match2_similarity from m where rank <= 2 group by peak_id""")
def anchor_summary(spark, folder):
    peaks = view(spark, folder, "pattern_peaks").where("flag = 0").select("peak_id", "frame", "center").distinct()
    wide = files.wide_matches(co.top_location_matches(peaks, TOL, 2), 2)
    return wide.withColumn("match1_similarity", F.round("match1_similarity", 7)).withColumn("match2_similarity", F.round("match2_similarity", 7))


@query("abandoned_runs", """
select o_orderkey as run from orders where o_orderstatus <> 'F' and epoch(timestamp '1998-01-01') - epoch(o_orderdate) >= 86400 * 30""")
def abandoned_runs(spark, folder):
    runs = base(spark, folder, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") == "F").alias("finished"),
                                                F.col("o_orderdate").alias("heartbeat"))
    return files.abandoned(runs, F.lit("1998-01-01").cast("timestamp"), 86400.0 * 30).select("run")


@query("reusable_runs", """
select o_custkey::string as config, o_orderpriority as inputs_hash, max(o_orderdate) as created_at from orders where o_orderstatus = 'F' and o_custkey = 7 and o_orderpriority = '5-LOW' group by 1, 2""")
def reusable_runs(spark, folder):
    runs = base(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("config"), F.col("o_orderpriority").alias("inputs_hash"),
        (F.col("o_orderstatus") == "F").alias("finished"), F.col("o_orderdate").alias("created_at"))
    return files.reusable(runs, "7", "5-LOW").select("config", "inputs_hash", "created_at")


@query("screen_structures", """
with e as (select lpad(p_partkey::string, 12, '0') || '.cif' as file, p_type as formula, p_size as spacegroup, p_retailprice as volume, p_partkey % 250 as n_sites from part)
, k as (select formula, spacegroup, unnest(list_reduce(list_transform(list_sort(list(struct_pack(file := file, v := volume))), lambda p: [p]),
  lambda kept, p: case when len(list_filter(kept, lambda q: abs(q.v - p[1].v) <= 0.005 * greatest(q.v, p[1].v, 1e-9))) > 0 then kept else list_concat(kept, p) end)) as one
  from e where n_sites <= 200 group by 1, 2)
select e.*, case when n_sites > 200 then 'too_big' when k.formula is null then 'duplicate' end as reason
from e left join k on k.formula = e.formula and k.spacegroup = e.spacegroup and k.one.file = e.file""")
def screen_structures(spark, folder):
    entries = base(spark, folder, "part").select(
        F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lit(".cif")).alias("file"), F.col("p_type").alias("formula"),
        F.col("p_size").alias("spacegroup"), F.col("p_retailprice").alias("volume"), (F.col("p_partkey") % 250).alias("n_sites"))
    return corpus.screen(entries)
