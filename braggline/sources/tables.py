"""Adapter views: the diffraction data model over the given parquet tables.

Each view is one SELECT that Spark and the DuckDB check both accept; ``{name}``
marks a base table.  The values are synthetic, the shapes are those of the data
model, and every view grows with its tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import to_double_array

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

N_BINS = 64           # width of the embedding rows read as patterns
RADIAL_START = 1.0
RADIAL_STEP = 0.05

VIEWS = {
    # One row per frame of a series, with filenames that carry the pressure in several ways.
    "frames": """
select o_orderkey as frame, o_custkey as series, o_orderkey % 17 = 0 as excluded,
  p10 / 10.0e0 as pressure, 290.0e0 + o_orderkey % 30 as temperature, o_orderdate as stamp,
  concat('run', cast(o_custkey % 7 as string), '/', case
    when o_orderpriority = '1-URGENT' then concat('scan', lpad(cast(o_custkey % 50 as string), 3, '0'), '/P', cast(o_orderkey as string), '_', coalesce(cast(cast(floor(p10 / 10) as bigint) as string) || 'p' || cast(p10 % 10 as string) || 'GPa', 'noP'), '.tif')
    when o_orderpriority = '2-HIGH' then concat('Scan_', cast(o_custkey % 50 as string), '/P', cast(o_orderkey as string), '_', coalesce(cast(p10 * 100 as string) || 'MPa', 'noP'), '.tif')
    when o_orderpriority = '3-MEDIUM' then concat(coalesce(cast(p10 as string) || ' kbar', 'noP'), '/scan-', cast(o_custkey % 50 as string), '/P', cast(o_orderkey as string), '.tif')
    else concat('P', cast(o_orderkey as string), '.tif') end) as filename
from (select *, case when o_orderstatus = 'P' then null else cast(floor(o_totalprice / 1000) as bigint) end as p10 from {orders}) t""",
    # One row per fitted peak.
    "peaks": """
select l_orderkey as frame, concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as peak_id, l_suppkey as series,
  1.0e0 + (l_partkey % 2000) * 3.0e-3 as center, l_extendedprice as amplitude,
  0.02e0 + l_discount as fwhm, 0.001e0 + l_tax * 0.05e0 as fwhm_err,
  l_extendedprice * (1 - l_discount) as area, case when l_returnflag = 'R' then 2 else 0 end as flag,
  l_tax as rel_misfit, case when l_tax = 0 then '' else p_type end as phase
from {lineitem} join {part} on l_partkey = p_partkey""",
    # Fitted peaks of the frames that also have a pattern.
    "pattern_peaks": """
select l_suppkey as frame, concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as peak_id,
  1.0e0 + (l_partkey % 1000) * 3.15e-3 as center, 0.05e0 + l_discount as width, l_extendedprice as area,
  case when l_returnflag = 'R' then 2 else 0 end as flag from {lineitem}""",
    # One row per phase line, drawn from the whole part table.
    "reflections": """
select p_type as phase, cast(p_size as bigint) as ord, 0.8e0 + p_size * 0.04e0 as d,
  sum(p_retailprice) / count(*) / 1000 as w, p_size % 4 as h, p_size % 3 as k, p_size % 2 as l
from {part} group by p_type, p_size""",
    # One equation of state per phase.
    "phases": """
select p_type as phase, case when p_type like 'E%' then 'Vinet' when p_type like 'L%' then 'BM2'
    when p_type like 'M%' then 'murn' when p_type like 'P%' then 'BM4' else 'bm-3' end as eos_type,
  60.0e0 + floor(min(p_retailprice) / 10) as k0, 3.5e0 + (count(*) % 20) / 10.0e0 as k0p,
  -0.02e0 as k0pp, case when p_type like 'S%' then 30.0e0 else 0.0e0 end as p_max,
  2.0e-5 * (1 + count(*) % 5) as alpha_v
from {part} group by p_type""",
    # Azimuth x radius cells; sparse, as a masked detector is.
    "cakes": """
select l_suppkey as frame, cast(l_partkey % 36 as int) as abin, -180.0e0 + 10 * (l_partkey % 36) as azim,
  cast(l_quantity as int) as rbin, 1.0e0 + 0.05e0 * cast(l_quantity as int) as radial, sum(l_extendedprice) / count(*) as y
from {lineitem} group by 1, 2, 3, 4, 5""",
    # Detector pixels with their polar coordinates.
    "pixels": """
select l_suppkey as frame, cast(l_quantity as int) as rbin, cast(l_partkey % 36 as int) as abin,
  l_extendedprice as intensity from {lineitem}""",
    # Stage positions: a jittered grid.
    "positions": """
select user_id as frame, (user_id % 15) * 0.5e0 + min(value) * 1.0e-5 as pos_x,
  floor(user_id / 15) * 0.5e0 + max(value) * 1.0e-6 as pos_y
from {events} group by user_id""",
    # Residual-peak observations of a series, ordered by week.
    "observations": """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as obs, l_suppkey as series,
  cast(floor(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) / 7) as bigint) as frame,
  1.0e0 + (l_partkey % 2000) * 3.0e-3 as center, l_extendedprice as amplitude, 0.02e0 + l_discount as fwhm
from {lineitem}""",
    # Points of given tracks, one per track and position of its series.
    "track_points": """
select l_suppkey as series, concat(cast(l_suppkey as string), '-', cast(l_partkey % 40 as string)) as track,
  cast(floor(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) / 60) as bigint) as position,
  min(1.0e0 + (l_partkey % 2000) * 3.0e-3) as center, max(l_extendedprice) as amplitude, max(0.02e0 + l_discount) as fwhm
from {lineitem} group by 1, 2, 3""",
    # Arrivals of a live run.
    "arrivals": """
select event_id, cast(ts as timestamp) as ts, user_id, event_type, value,
  concat('f', cast(event_id % 9000 as string), '.tif') as display from {events}""",
}

BINS_SQL = """
select vec_id as frame, label as series, pos as bin, 1.0::double + 0.05::double * pos as radial,
  100::double * v::double as clean, 100::double * v::double + 60 as robust,
  100::double * v::double + 60 + case when (vec_id * 7 + pos * 13) % 29 = 0 then 50::double else 0::double end as mean,
  case when (vec_id * 5 + pos * 3) % 97 = 0 then null else 100::double * v::double end as masked
from (select vec_id, label, cast(unnest(range(0, 64)) as integer) as pos, unnest(embedding) as v from embeddings)"""


def base(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An adapter view as a DataFrame; column pruning and filters reach the scan."""
    text = VIEWS[name]
    tables = {t: base(spark, folder, t) for t in sorted(set(re.findall(r"\{(\w+)\}", text)))}
    return spark.sql(text.replace("date_diff('day', date '1992-01-01', cast(l_shipdate as date))",
                                  "datediff(cast(l_shipdate as date), date '1992-01-01')"), **tables)


def patterns(spark: SparkSession, folder: str) -> DataFrame:
    """One row per frame, one array column per co-registered channel."""
    raw = base(spark, folder, "embeddings").select(
        F.col("vec_id").alias("frame"), F.col("label").alias("series"),
        to_double_array(F.col("embedding")).alias("v"))
    spike = lambda x, i: x * 100 + 60 + F.when((F.col("frame") * 7 + i * 13) % 29 == 0, 50.0).otherwise(0.0)
    return raw.select(
        "frame", "series",
        F.transform("v", lambda x: x * 100).alias("clean"),
        F.transform("v", lambda x: x * 100 + 60).alias("robust"),
        F.transform("v", spike).alias("mean"),
        F.transform("v", lambda x, i: F.when((F.col("frame") * 5 + i * 3) % 97 != 0, x * 100)).alias("masked"))


def bins(spark: SparkSession, folder: str, *channels: str) -> DataFrame:
    """The long view of the patterns, one row per radial bin."""
    chosen = channels or ("clean", "robust", "mean", "masked")
    zipped = F.arrays_zip(*[F.col(c) for c in chosen])
    return (patterns(spark, folder)
            .select("frame", "series", F.posexplode(zipped).alias("bin", "_z"))
            .select("frame", "series", "bin",
                    (F.lit(RADIAL_START) + F.lit(RADIAL_STEP) * F.col("bin")).alias("radial"),
                    *[F.col(f"_z.{c}").alias(c) for c in chosen]))


def radial_axis() -> list[float]:
    return [RADIAL_START + RADIAL_STEP * i for i in range(N_BINS)]


def cte(*names: str) -> str:
    """``with`` clause that builds the named views for the DuckDB check."""
    parts = []
    for name in names:
        text = BINS_SQL if name == "bins" else re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
        parts.append(f"{name} as ({text})")
    return "with " + ",\n".join(parts) + "\n"
