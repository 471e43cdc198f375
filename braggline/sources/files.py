"""File scans and sinks of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metadata import basename

# Leading bytes (hex) of the image kinds.
MAGIC = {"tiff": ("49492A00", "4D4D002A"), "png": ("89504E47",), "hdf5": ("89484446",), "jpeg": ("FFD8FF",)}

REFINEMENT = T.StructType([T.StructField("histograms", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("rwp", T.DoubleType()), T.StructField("gof", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("phases", T.MapType(T.StringType(), T.StructType([
        T.StructField("weight_fraction", T.DoubleType()), T.StructField("weight_fraction_esd", T.DoubleType()),
        T.StructField("cell", T.ArrayType(T.DoubleType())), T.StructField("cell_esd", T.ArrayType(T.DoubleType()))])))])))])

PHASE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("formula", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("space_group", T.StringType()),
    T.StructField("lattice", T.StructType([T.StructField(n, T.DoubleType()) for n in ("a", "b", "c", "alpha", "beta", "gamma")])),
    T.StructField("eos", T.StructType([T.StructField("type", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("V0", "K0", "K0p", "K0pp", "p_max")]])),
    T.StructField("thermal", T.StructType([T.StructField("alpha_v", T.DoubleType()), T.StructField("T0", T.DoubleType())])),
    T.StructField("pressure_assumption", T.StringType()), T.StructField("amorphous", T.BooleanType())])


def scan_files(spark: SparkSession, folder: str, patterns: str = "*", recursive: bool = False) -> DataFrame:
    """Files matching any ``;``-separated pattern, each once."""
    found = None
    for pattern in [p.strip() for p in patterns.split(";") if p.strip()]:
        part = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                .option("recursiveFileLookup", str(recursive).lower()).load(folder))
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["path"])


def file_kind(content: Column) -> Column:
    """Kind of a file by its leading bytes."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for kind, marks in MAGIC.items():
        for mark in marks:
            out = F.when(head.startswith(mark), F.lit(kind)).otherwise(out)
    return out


def read_xy(spark: SparkSession, folder: str, pattern: str = "*.xy") -> DataFrame:
    """Two- or three-column text patterns: ``filename, x, y, sigma``; ``#`` lines are comments."""
    lines = (spark.read.option("pathGlobFilter", pattern).text(folder)
             .select(basename(F.input_file_name()).alias("filename"), F.trim("value").alias("line"))
             .where((F.col("line") != "") & ~F.col("line").startswith("#")))
    parts = F.split(F.regexp_replace("line", "[,;]", " "), r"\s+")
    return lines.select("filename", *[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x", "y", "sigma"))]).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())


def xy_header(spark: SparkSession, folder: str, pattern: str = "*.xy") -> DataFrame:
    """``#KEY=VALUE`` header entries of text patterns."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select(
        basename(F.input_file_name()).alias("filename"), F.regexp_extract("value", r"^#+\s*([^=]+?)\s*=\s*(.*)$", 1).alias("key"),
        F.trim(F.regexp_extract("value", r"^#+\s*([^=]+?)\s*=\s*(.*)$", 2)).alias("value"))
    return lines.where(F.col("key") != "")


def read_metadata_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Metadata rows under canonical column names."""
    from ..operators.metadata import canonical_columns
    return canonical_columns(spark.read.option("header", True).option("sep", separator).csv(path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``filename, phase`` rows of a label CSV whose phases are ``;`` or ``,`` lists."""
    rows = spark.read.option("header", True).csv(path)
    names = F.filter(F.transform(F.split("phases", "[;,]"), lambda p: F.trim(p)), lambda p: p != "")
    return rows.select(F.trim("filename").alias("filename"), F.explode(names).alias("phase"))


def read_refinement(spark: SparkSession, path: str) -> DataFrame:
    """One row per histogram of a refinement-result JSON file."""
    return (spark.read.schema(REFINEMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
            .select(F.explode("histograms").alias("h")).select("h.*"))


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    """User phases of a JSON list."""
    return spark.read.schema(PHASE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_table(df: DataFrame, path: str, kind: str = "csv", partition_by: Sequence[str] = ()) -> None:
    """Write a table; columns of a CSV are in name order and missing cells are empty."""
    ordered = df.select(*sorted(df.columns)) if kind == "csv" else df
    writer = ordered.write.mode("overwrite").partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).option("nullValue", "").csv(path)
    else:
        writer.format(kind).save(path)


def frame_export(bins: DataFrame, keep: Column | None = None) -> DataFrame:
    """Rows of an exported pattern; bins outside ``keep`` are absent, not zero."""
    return bins if keep is None else bins.where(keep)


def wide_matches(top: DataFrame, n: int) -> DataFrame:
    """One row per anchor with ``match1..n`` columns out of ranked match rows."""
    return top.groupBy("peak_id").agg(*[
        F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"match{k}_{c}")
        for k in range(1, n + 1) for c in ("match_id", "similarity")])


def run_record(df: DataFrame, *, tool: str, version: str, config: Column, inputs: Column) -> DataFrame:
    """Provenance row of a run."""
    return df.select(F.lit(tool).alias("tool"), F.lit(version).alias("version"),
                     F.to_json(config).alias("config"), inputs.alias("inputs"), F.current_timestamp().alias("created_at"))


def reusable(runs: DataFrame, config_json: str, inputs_hash: str) -> DataFrame:
    """Newest finished run with the same configuration and inputs."""
    newest = Window.partitionBy("config", "inputs_hash").orderBy(F.desc("created_at"))
    same = runs.where((F.col("config") == config_json) & (F.col("inputs_hash") == inputs_hash) & F.col("finished"))
    return same.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def abandoned(runs: DataFrame, now: Column, stale_seconds: float = 120.0) -> DataFrame:
    """Unfinished runs whose last sign of life is older than ``stale_seconds``."""
    silence = (F.unix_micros(now) - F.unix_micros(F.col("heartbeat").cast("timestamp"))) / 1e6
    return runs.where(~F.col("finished") & (silence >= stale_seconds))
