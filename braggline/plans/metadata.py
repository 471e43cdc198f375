"""Metadata, names, sources and libraries."""

from pyspark.sql import functions as F

from ..functions import axis, metadata as md
from ..operators import metadata as op
from ..operators.ordered import with_running_sum_by_range
from ..operators import refinement
from ..sources.tables import base, cte, view
from .registry import query

UNITS = """case lower(unit) when 'gpa' then 1.0e0 when 'mpa' then 1e-3 when 'kpa' then 1e-6 when 'pa' then 1e-9
 when 'mbar' then 100.0e0 when 'kbar' then 0.1e0 when 'bar' then 1e-4 end"""
PATTERN = r"(?i)(\d+(?:[.,p]\d+)?)\s*[_\-]?\s*(gpa|mpa|kpa|mbar|kbar|bar|pa)(?:[^a-z]|$)"


@query("parse_pressure", cte("frames") + f"""
, parts as (select frame, filename, string_split(filename, '/') as p from frames)
, long as (select frame, filename, unnest(p) as part, generate_subscripts(p, 1) as pos from parts)
, tok as (select frame, filename, pos, regexp_extract(part, '{PATTERN}', 1) as num, regexp_extract(part, '{PATTERN}', 2) as unit from long)
, val as (select frame, filename, pos, try_cast(replace(replace(num, 'p', '.'), ',', '.') as double) * {UNITS} as v from tok)
select frame, filename, round(arg_max(v, pos) filter (where v is not null), 6) as parsed from val group by 1, 2""")
def parse_pressure(spark, folder):
    return view(spark, folder, "frames").select(
        "frame", "filename", F.round(md.parse_pressure_from_path(F.col("filename")), 6).alias("parsed"))


@query("summarize_pressures", cte("frames") + """
, steps as (select series, pressure - lag(pressure) over (partition by series order by frame) as step, pressure from frames where pressure is not null)
, trend as (select series, count(*) >= 2 and (coalesce(bool_and(step >= -1e-9), true) or coalesce(bool_and(step <= 1e-9), true)) as monotonic from steps group by series)
select f.series, count(*) as n_frames, count(pressure) as n_parsed, round(count(pressure) * 1.0e0 / count(*), 8) as frac_parsed,
  min(pressure) as p_min, max(pressure) as p_max, coalesce(any_value(t.monotonic), false) as monotonic
from frames f left join trend t on f.series = t.series group by f.series""")
def summarize_pressures(spark, folder):
    out = op.summarize_pressures(view(spark, folder, "frames"), ["series"])
    return out.withColumn("frac_parsed", F.round("frac_parsed", 8))


GROUP_SQL = """
, labelled as (select frame, {label} as group_label from frames)
, firsts as (select group_label, min(frame) as f from labelled group by 1)
, ids as (select group_label, row_number() over (order by f) - 1 as group_id from firsts)
select frame, group_label, group_id from labelled join ids using (group_label)"""


@query("scan_groups", cte("frames") + GROUP_SQL.format(
    label=r"""case when regexp_matches(filename, '(?i)(?:^|[^A-Za-z])scan[_\- ]*0*(\d+)')
  then 'scan' || lpad(regexp_extract(filename, '(?i)(?:^|[^A-Za-z])scan[_\- ]*0*(\d+)', 1), 3, '0') else 'scan_unknown' end"""))
def scan_groups(spark, folder):
    return op.series_group(view(spark, folder, "frames"), "scan").select("frame", "group_label", "group_id")


@query("folder_groups", cte("frames") + GROUP_SQL.format(label="string_split(filename, '/')[-2]"))
def folder_groups(spark, folder):
    return op.series_group(view(spark, folder, "frames"), "folder").select("frame", "group_label", "group_id")


@query("series_axis_time", cte("frames") + """
select frame, round((epoch_us(stamp) - min(epoch_us(stamp)) over ()) / 1e6, 3) as axis from frames""")
def series_axis_time(spark, folder):
    return op.series_axis(view(spark, folder, "frames"), "time").select("frame", F.round("axis", 3).alias("axis"))


@query("series_axis_pressure", cte("frames") + """
select series, frame, pressure as axis, count(pressure) over (partition by series) > 0 as usable from frames""")
def series_axis_pressure(spark, folder):
    frames = op.series_axis(view(spark, folder, "frames"), "pressure")
    usable = frames.groupBy("series").agg((F.count("axis") > 0).alias("usable"))
    return frames.select("series", "frame", "axis").join(usable, "series")


@query("order_frames", cte("frames") + """
select series, frame, row_number() over (partition by series order by pressure asc nulls last, frame) - 1 as "row"
from frames where not excluded""")
def order_frames(spark, folder):
    return op.order_frames(view(spark, folder, "frames"), ["series"], "pressure", 10.0).select("series", "frame", "row")


ROWS_SQL = """
, rows0 as (select o_orderkey as row_no, case when o_orderpriority < '3' then o_orderkey end as frame,
  case when o_orderpriority = '3-MEDIUM' then 'P' || o_orderkey::string when o_orderpriority > '3-M' then 'other/P' || o_orderkey::string || '.tif' end as filename,
  round(o_totalprice / 1000, 3) as pressure, case when o_orderstatus = 'F' then o_custkey / 10 end as temperature from orders)
"""


@query("map_metadata_rows", cte("frames") + ROWS_SQL + """
, keys as (select k, min(frame) as hit from (select frame, unnest(list_distinct([filename, string_split(filename, '/')[-1], replace(string_split(filename, '/')[-1], '.tif', '')])) as k from frames) group by k)
, placed as (select row_no, frame, pressure, temperature from rows0 where frame is not null union all
  select row_no, coalesce(a.hit, b.hit, c.hit), pressure, temperature from rows0 r left join keys a on a.k = r.filename
   left join keys b on b.k = string_split(r.filename, '/')[-1] left join keys c on c.k = replace(string_split(r.filename, '/')[-1], '.tif', '') where r.frame is null)
select frame, arg_max(pressure, row_no) as pressure, round(arg_max(temperature, row_no), 6) as temperature
from placed where frame is not null group by frame""")
def map_metadata_rows(spark, folder):
    key = F.col("o_orderkey").cast("string")
    rows = base(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_no"),
        F.when(F.col("o_orderpriority") < "3", F.col("o_orderkey")).alias("Frame"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("P"), key))
        .when(F.col("o_orderpriority") > "3-M", F.concat(F.lit("other/P"), key, F.lit(".tif"))).alias("fname"),
        F.round(F.col("o_totalprice") / 1000, 3).alias("P_GPa"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") / 10).alias("temp_k"))
    mapped = op.map_rows_to_frames(op.canonical_columns(rows), view(spark, folder, "frames"), "row_no")
    return mapped.select("frame", "pressure", F.round("temperature", 6).alias("temperature"))


@query("merge_metadata", cte("frames") + """
, edited as (select frame, series, pressure, temperature, excluded as user_edited from frames)
, new as (select o_orderkey as frame, case when o_orderstatus <> 'O' then o_totalprice / 500 end as pressure, null::double as temperature from orders)
select e.frame, case when user_edited then e.pressure else coalesce(n.pressure, e.pressure) end as pressure,
  case when user_edited then e.temperature else coalesce(n.temperature, e.temperature) end as temperature
from edited e left join new n on e.frame = n.frame""")
def merge_metadata(spark, folder):
    frames = view(spark, folder, "frames").withColumn("user_edited", F.col("excluded"))
    new = base(spark, folder, "orders").select(
        F.col("o_orderkey").alias("frame"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") / 500).alias("pressure"),
        F.lit(None).cast("double").alias("temperature"))
    return op.merge_values(frames, new, ["pressure", "temperature"], edited="user_edited").select(
        "frame", "pressure", "temperature")


@query("carry_user_values", cte("frames") + """
, prev as (select frame + 1 as frame, filename, 1.5e0 * temperature as temperature, excluded as user_edited from frames)
select f.frame, case when a.filename is not null then a.temperature when b.frame is not null then b.temperature else f.temperature end as temperature,
  a.filename is not null or b.frame is not null as user_edited
from frames f left join (select filename, arg_max(temperature, frame) as temperature from prev where user_edited group by filename) a on a.filename = f.filename
left join (select frame, temperature from prev where user_edited) b on b.frame = f.frame""")
def carry_user_values(spark, folder):
    frames = view(spark, folder, "frames")
    previous = frames.select((F.col("frame") + 1).alias("frame"), "filename",
                             (F.col("temperature") * 1.5).alias("temperature"),
                             F.col("excluded").alias("user_edited"))
    return op.carry_user_values(frames, previous, ["temperature"]).select("frame", "temperature", "user_edited")


@query("set_excluded", cte("frames") + """
select frame, case when temperature > 310 then true else excluded end as excluded from frames""")
def set_excluded(spark, folder):
    frames = view(spark, folder, "frames")
    return op.set_excluded(frames, frames.where("temperature > 310"), True).select("frame", "excluded")


STACKS_SQL = """
with f as (select 'data/run' || cast(p_partkey as string) || '.h5' as file, 'entry/data' as dataset, p_size as n from part)
, e as (select file, dataset, unnest(range(0, n)) as idx from f)
"""


@query("expand_frame_sources", STACKS_SQL + """
select file, idx::bigint as "index", file || '::' || dataset || '#' || lpad(idx::string, 6, '0') as source from e""")
def expand_frame_sources(spark, folder):
    return op.expand_sources(stacks(spark, folder)).select("file", "index", "source")


@query("parse_frame_spec", STACKS_SQL + """
select file || '::' || dataset || '#' || lpad(idx::string, 6, '0') as source, file, dataset, idx::bigint as "index", true as is_stack,
  replace(file, 'data/', '') || '::' || dataset || '#' || lpad(idx::string, 6, '0') as display from e
union all select filename, null, null, null, false, string_split(filename, '/')[-1] from (""" + cte("frames") + " select * from frames) t")
def parse_frame_spec(spark, folder):
    src = (op.expand_sources(stacks(spark, folder)).select("source")
           .unionByName(view(spark, folder, "frames").select(F.col("filename").alias("source"))))
    # Each part is parsed once, in a column of its own.
    parsed = md.parse_stack_spec(F.col("source"))
    src = src.select("source", md.is_stack_spec(F.col("source")).alias("is_stack"), *[parsed[c].alias(f"_{c}") for c in ("file", "dataset", "index")])
    spec, stacked = {c: F.col(f"_{c}") for c in ("file", "dataset", "index")}, F.col("is_stack")
    return src.select("source", *[F.when(stacked, spec[c]).alias(c) for c in ("file", "dataset", "index")], "is_stack",
                      md.display_name(F.col("source"), "data", spec, stacked).alias("display"))


def stacks(spark, folder):
    return base(spark, folder, "part").select(
        F.concat(F.lit("data/run"), F.col("p_partkey").cast("string"), F.lit(".h5")).alias("file"),
        F.lit("entry/data").alias("dataset"), F.col("p_size").alias("n_frames"))


@query("stack_metadata", STACKS_SQL + """
, m as (select 'data/run' || cast(p_partkey as string) || '.h5' as file, p_retailprice as temperature from part where p_brand < 'Brand#2')
select e.file, idx::bigint as "index", m.temperature, strftime(make_timestamp(idx::bigint * 1500000), '%Y-%m-%dT%H:%M:%S.%f') as stamp
from e left join m using (file)""")
def stack_metadata(spark, folder):
    meta = base(spark, folder, "part").where(F.col("p_brand") < "Brand#2").select(
        F.concat(F.lit("data/run"), F.col("p_partkey").cast("string"), F.lit(".h5")).alias("file"),
        F.col("p_retailprice").alias("temperature"))
    return op.expand_sources(stacks(spark, folder)).join(meta, "file", "left").select(
        "file", "index", "temperature", md.seconds_to_iso(F.col("index") * 1.5).alias("stamp"))


@query("latest_handoff", cte("frames") + """
select string_split(filename, '/')[1] as run, max(stamp) as modified, arg_min(filename, row(-epoch_us(stamp), filename)) as path from frames group by 1""")
def latest_handoff(spark, folder):
    frames = view(spark, folder, "frames").withColumn("run", F.get(F.split("filename", "/"), F.lit(0)))
    return op.latest_file(frames, ["run"], "filename", "stamp")


@query("header_value", """
select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, user_id / 2 as samx from events""")
def header_value(spark, folder):
    header = event_header()
    return base(spark, folder, "events").select(
        "event_id", md.header_value(header, "K").alias("k"), md.header_value(header, "samX").alias("samx"))


def event_header():
    return F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("Motor_Mne"), F.lit("samy samx"),
                     F.lit("motor_pos"), F.concat(F.lit("0.0 "), (F.col("user_id") / 2).cast("string"))))


@query("header_keys", """
with k as (select unnest(json_keys(props)) as key from events union all select unnest(['Motor_Mne', 'motor_pos', 'samx', 'samy']) from events)
select key, count(*) as n_frames from k group by key""")
def header_keys(spark, folder):
    keys = base(spark, folder, "events").select(F.explode(md.header_keys(event_header())).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_frames"))


@query("remove_user_phases", """
with own as (select distinct p_name as name from part where p_brand = 'Brand#17'), gone as (select distinct p_name as name from part where p_size < 10)
select name, name in (select name from own) as removed from gone""")
def remove_user_phases(spark, folder):
    own, _ = libraries(spark, folder)
    gone = base(spark, folder, "part").where("p_size < 10").select(F.col("p_name").alias("name")).distinct()
    left = op.remove_phases(own, gone)
    before = own.select("name", F.lit(True).alias("own"))
    return gone.join(before, "name", "left").join(left.select("name", F.lit(True).alias("still")), "name", "left").select(
        "name", (F.coalesce("own", F.lit(False)) & F.col("still").isNull()).alias("removed"))


@query("phase_library", """
with bundled as (select p_name as name, min(p_type) as category from part group by p_name)
, own as (select p_name as name, 'user' as category from part where p_brand = 'Brand#17' group by p_name)
select name, category, false as builtin from own
union all select name, category, true from bundled where name not in (select name from own)""")
def phase_library(spark, folder):
    return op.merge_library(*libraries(spark, folder)).select("name", "category", "builtin")


def libraries(spark, folder):
    part = base(spark, folder, "part")
    bundled = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("category"))
    own = part.where(F.col("p_brand") == "Brand#17").select(
        F.col("p_name").alias("name"), F.lit("user").alias("category")).distinct()
    return own, bundled


@query("list_phases", """
with lib as (select p_name as name, min(p_type) as category from part group by p_name)
select name, category, row_number() over (order by coalesce(array_position(['PROMO', 'ECONOMY'], category), 3), lower(name), name) as position from lib""")
def list_phases(spark, folder):
    _, bundled = libraries(spark, folder)
    placed = bundled.withColumn("_p", op.library_position(F.col("category"), ["PROMO", "ECONOMY"])).withColumn("_n", F.lower("name"))
    ranked = with_running_sum_by_range(placed, [F.col("_p"), F.col("_n"), F.col("name")], F.lit(1), "position")
    return ranked.select("name", "category", "position")


@query("upsert_phases", """
with lib as (select p_name as name, min(p_type) as category from part group by p_name)
, rows as (select distinct p_name as name, 'edited' as category from part where p_size = 50)
select name, category from lib where name not in (select name from rows) union all select name, category from rows""")
def upsert_phases(spark, folder):
    _, bundled = libraries(spark, folder)
    rows = base(spark, folder, "part").where("p_size = 50").select(
        F.col("p_name").alias("name"), F.lit("edited").alias("category")).distinct()
    return op.upsert(bundled, rows)


@query("safe_names", r"""
select url, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), ''), 'calibration') as stem,
  regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') as name_key from pages""")
def safe_names(spark, folder):
    return base(spark, folder, "pages").select(
        "url", md.safe_stem(F.col("url")).alias("stem"), md.name_key(F.col("url")).alias("name_key"))


@query("geometry_wavelength", """
select s_suppkey, round(case when s_suppkey % 2 = 0 then (s_suppkey + 1) / 10 else (s_suppkey + 1) * 1.0e0 end, 9) as wavelength from supplier""")
def geometry_wavelength(spark, folder):
    text = F.concat(F.lit("# geometry\nDistance: 0.2\nWavelength : "), (F.col("s_suppkey") + 1).cast("string"),
                    F.when(F.col("s_suppkey") % 2 == 0, "e-11").otherwise(""), F.lit("\n"))
    return base(spark, folder, "supplier").select(
        "s_suppkey", F.round(axis.wavelength_from_geometry(text), 9).alias("wavelength"))


@query("file_fingerprint", "select doc_id, sha256(text) as sha256, strlen(text) as size from documents")
def file_fingerprint(spark, folder):
    return base(spark, folder, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("hkl_labels", cte("reflections") + """
select phase, ord, h, -k as k, l from reflections""")
def hkl_labels(spark, folder):
    label = F.concat(F.lit("("), F.col("h").cast("string"), F.lit(", -"), F.col("k").cast("string"),
                     F.lit(", "), F.col("l").cast("string"), F.lit(")"))
    hkl = md.parse_hkl(label)
    return view(spark, folder, "reflections").select(
        "phase", "ord", *[hkl[i].alias(n) for i, n in enumerate("hkl")])


@query("refinement_frames", """
select o_orderkey as frame, 'refine SERIES-' || lpad(o_custkey::string, 6, '0') || ' PWDR' as name, c_acctbal as rwp,
  count(*) over (partition by o_custkey) as group_size from orders join customer on o_custkey = c_custkey""")
def refinement_frames(spark, folder):
    return refined(spark, folder).select("frame", "name", "rwp", "group_size")


def refined(spark, folder):
    code = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    customers = base(spark, folder, "customer")
    histograms = customers.select(
        F.concat(F.lit("refine SERIES-"), code, F.lit(" PWDR")).alias("name"), F.col("c_acctbal").alias("rwp"),
        F.create_map(F.lit("A phase"), F.col("c_nationkey") / 50.0, F.lit("B"), 1 - F.col("c_nationkey") / 25.0).alias("phases"))
    groups = customers.select(
        F.col("c_custkey").alias("group_id"), F.concat(F.lit("series "), code).alias("label"),
        F.array(F.concat(F.lit("out/Series_"), code, F.lit("_q.xy"))).alias("patterns"))
    members = base(spark, folder, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("frame"))
    return refinement.frame_results(histograms, groups, members)


@query("refinement_phases", """
select o_orderkey as frame, unnest(['alpha', 'B']) as phase, round(unnest([c_nationkey / 50, 1 - c_nationkey / 25]), 6) as weight_fraction
from orders join customer on o_custkey = c_custkey""")
def refinement_phases(spark, folder):
    return refinement.explode_phases(refined(spark, folder), {"A phase": " alpha"}).select(
        "frame", "phase", F.round("weight_fraction", 6).alias("weight_fraction"))


@query("refinement_checks", """
select o_orderkey as frame, round(1 - c_nationkey / 50, 6) as total, 0::bigint as duplicates
from orders join customer on o_custkey = c_custkey where abs(c_nationkey / 50) > 0.020000001""")
def refinement_checks(spark, folder):
    out = refinement.fraction_checks(refinement.explode_phases(refined(spark, folder), {}), 0.02 + 1e-9)
    return out.withColumn("total", F.round("total", 6))
