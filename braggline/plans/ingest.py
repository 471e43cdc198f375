"""Patterns on axes of their own."""

from pyspark.sql import functions as F

from ..operators import ingest as ig
from ..sources.tables import bins, cte
from .registry import query


def shifted(spark, folder):
    """All patterns, each read as measured on an axis moved by a few thousandths."""
    own = F.col("radial") + (F.col("frame") % 7) * F.lit(0.003) + F.col("bin") * (F.col("frame") % 3) * F.lit(0.0005)
    return bins(spark, folder, "masked").select("frame", own.alias("x"), F.col("masked").alias("y"))


@query("common_axis", cte("bins") + """
, p as (select frame, radial + (frame % 7) * 0.003::double + bin * (frame % 3) * 0.0005::double as x, masked as y from bins where masked is not null)
, d as (select frame, x, x - lag(x) over (partition by frame order by x) as step from p)
, f as (select frame, min(x) as first, max(x) as last, median(step) as own from d group by 1 having count(*) >= 16)
select round(min(first), 9) as start, round(max(last), 9) as stop, round(median(own), 9) as step from f""")
def common_axis(spark, folder):
    return ig.common_axis(ig.knots(shifted(spark, folder), "frame")).select(*[F.round(c, 9).alias(c) for c in ("start", "stop", "step")])


@query("ingest_patterns", cte("bins") + """
, p as (select frame, radial + (frame % 7) * 0.003::double + bin * (frame % 3) * 0.0005::double as x, masked as y from bins where masked is not null)
, d as (select frame, x, y, x - lag(x) over w as step, lead(x) over w as x2, lead(y) over w as y2 from p window w as (partition by frame order by x))
, f as (select frame, min(x) as first, max(x) as last, median(step) as own from d group by 1 having count(*) >= 16)
, a as (select min(first) as start, max(last) as stop, median(own) as step from f)
, g as (select i, start + step * i as spot, step from (select unnest(range(0, (select ceil((stop - start) / step)::bigint + 1 from a))) as i) t, a)
, s as (select d.* from d semi join f on f.frame = d.frame)
select s.frame, g.i::bigint as bin, round(spot, 7) as radial, round(case when x2 is null then y else y + least(greatest((spot - x) / (x2 - x), 0), 1) * (y2 - y) end, 6) as y
from s join g on spot >= x - 1e-9 * g.step and (spot < x2 - 1e-9 * g.step or (x2 is null and spot <= x + 1e-9 * g.step))""")
def ingest_patterns(spark, folder):
    out = ig.on_common_axis(shifted(spark, folder), "frame")
    return out.select("frame", "bin", F.round("radial", 7).alias("radial"), F.round("y", 6).alias("y"))
