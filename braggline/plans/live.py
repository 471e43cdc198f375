"""Batch forms of the live operators over the arrivals of a run."""

from pyspark.sql import functions as F

from ..sources.tables import cte, view
from ..streaming import live
from .registry import query


@query("live_first_arrivals", cte("arrivals") + """
select display, arg_min(event_id, row(ts, event_id)) as event_id, count(*) as n_seen from arrivals group by display""")
def live_first_arrivals(spark, folder):
    return view(spark, folder, "arrivals").groupBy("display").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n_seen"))


@query("live_rates", cte("arrivals") + """
select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from arrivals group by 1, 2""")
def live_rates(spark, folder):
    out = live.arrival_rates(view(spark, folder, "arrivals"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("live_sliding_rates", cte("arrivals") + """
, w as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start, event_type, value from arrivals)
select start, event_type, count(*) as n, round(sum(value), 4) as value from w group by 1, 2""")
def live_sliding_rates(spark, folder):
    out = live.arrival_rates(view(spark, folder, "arrivals"), slide="30 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("live_sessions", cte("arrivals") + """
, g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as s from arrivals)
, k as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as run from g)
select user_id, min(ts) as start, max(ts) + interval '2 hours' as "end", count(*) as n from k group by user_id, run""")
def live_sessions(spark, folder):
    out = live.sessions(view(spark, folder, "arrivals"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("live_ready_frames", """
with l as (select 'run' || p_partkey::string as file, p_size as n, case when p_brand < 'Brand#2' then p_size when p_brand < 'Brand#3' then p_size - 1 end as b from part)
, u as (select file, n - case when n > coalesce(b, 0) then 1 else 0 end as usable from l)
select file, unnest(range(0, usable::bigint)) as "index" from u where usable > 0""")
def live_ready_frames(spark, folder):
    from ..sources.tables import base
    part = base(spark, folder, "part").withColumn("file", F.concat(F.lit("run"), F.col("p_partkey").cast("string")))
    listing = part.select("file", F.col("p_size").alias("n_frames"))
    previous = part.where("p_brand < 'Brand#3'").select("file", F.when(F.col("p_brand") < "Brand#2", F.col("p_size")).otherwise(F.col("p_size") - 1).alias("n_frames"))
    return live.ready_stack_frames(listing, previous)
