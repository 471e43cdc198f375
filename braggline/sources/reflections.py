"""Calculated reflection lists out of text tables, one file per phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import basename, stem

# Names of the intensity column, in lower case.
INTENSITY_NAMES = ("i", "int", "intensity", "irel", "i_rel", "i(%)")
FULL_SCALE = 100.0  # a normalised intensity column ends here


def last_index(names: Column, wanted) -> Column:
    """0-based index of the last name that is wanted, null where there is none."""
    marked = F.transform(names, lambda n, i: F.when(wanted(n), i))
    return F.array_max(F.filter(marked, lambda i: i.isNotNull()))


def first_index(names: Column, name: str) -> Column:
    at = F.array_position(names, name)
    return F.when(at > 0, (at - 1).cast("int"))


def reflection_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``filename, phase, rows, d_col, i_col, hkl_cols, problem``: every file with its numbers and where its columns are.

    A file holds white-space separated numbers, ``#`` lines are comments.  The first line, if it is
    no row of numbers, is a header when it names as many columns as the rows have (units in
    brackets are no names); ``d``, intensity and ``h k l`` are found by it.  Without a named
    ``d``, two columns are ``d`` and intensity, and four or more that begin with whole numbers are ``h k l
    d`` with the intensity in the last column that ends at 100, else in the one after ``d``.  Rows
    of fewer columns than the widest are left out.  ``problem`` says why a file gives no lines: no
    numbers, or no ``d`` column; an empty file has no numbers.  A list has a few thousand lines, so a
    file is one row.
    """
    text = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: (v != "") & ~v.startswith("#"))
    tokens = text.select(basename(F.col("_metadata.file_path")).alias("filename"), F.transform(lines, lambda v: F.split(v, r"\s+")).alias("_tokens"))
    numbers = F.transform("_tokens", lambda t: F.transform(t, lambda x: x.try_cast("double")))
    wide = (tokens.withColumn("_numbers", F.filter(numbers, lambda n: ~F.exists(n, lambda x: x.isNull())))
            .withColumn("_first", F.get("_tokens", F.lit(0)))
            .withColumn("_n", F.coalesce(F.array_max(F.transform("_numbers", lambda n: F.size(n))), F.lit(0)))
            .withColumn("rows", F.filter("_numbers", lambda n: F.size(n) == F.col("_n"))))
    no_row = F.exists("_first", lambda x: x.try_cast("double").isNull())
    names = F.transform(F.filter("_first", lambda x: ~x.startswith("(")), lambda x: F.lower(x))
    named = wide.withColumn("_names", F.when(no_row & (F.size(names) == F.col("_n")), names))
    hkl = [first_index(F.col("_names"), n) for n in "hkl"]
    named = (named.withColumn("_d", last_index(F.col("_names"), lambda n: (n == "d") | n.startswith("d(")))
             .withColumn("_i", last_index(F.col("_names"), lambda n: n.isin(*INTENSITY_NAMES)))
             .withColumn("_hkl", F.when(hkl[0].isNotNull() & hkl[1].isNotNull() & hkl[2].isNotNull(), F.array(*hkl))))
    whole = ~F.exists("rows", lambda r: F.exists(F.slice(r, 1, 3), lambda x: F.isnan(x) | (F.abs(x - F.round(x)) > 1e-8 + 1e-5 * F.abs(x))))
    top = F.transform(F.sequence(F.lit(4), F.greatest(F.col("_n") - 1, F.lit(4))), lambda j: F.when(
        F.abs(F.array_max(F.transform(F.filter("rows", lambda r: ~F.isnan(F.get(r, j))), lambda r: F.get(r, j))) - FULL_SCALE) < 1e-6, j))
    scaled = F.coalesce(F.array_max(F.filter(top, lambda j: j.isNotNull())), F.when(F.col("_n") > 4, F.lit(4)))
    pair, table = F.col("_d").isNull() & (F.col("_n") == 2), F.col("_d").isNull() & (F.col("_n") >= 4) & whole
    found = (named.withColumn("d_col", F.when(pair, 0).when(table, 3).otherwise(F.col("_d")))
             .withColumn("i_col", F.when(pair, 1).when(table, F.coalesce("_i", scaled)).otherwise(F.col("_i")))
             .withColumn("hkl_cols", F.when(table, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.col("_hkl"))))
    problem = F.when(F.size("rows") == 0, "no rows of numbers").when(F.col("d_col").isNull(), "no d column")
    return found.select("filename", stem(F.col("filename")).alias("phase"), "rows", "d_col", "i_col", "hkl_cols", problem.alias("problem"))


def read_reflections(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``phase, ord, d, w, h, k, l`` of all lists that can be read; ``phase`` is the file's stem, ``ord`` the row from 0.

    Intensity and indices are null where a list has none; see ``reflection_files`` for what is left out.
    """
    rows = reflection_files(spark, path, pattern).where(F.col("problem").isNull()).select("phase", "d_col", "i_col", "hkl_cols", F.posexplode("rows").alias("ord", "_r"))
    return rows.select("phase", F.col("ord").cast("long").alias("ord"), F.get("_r", F.col("d_col")).alias("d"), F.get("_r", F.col("i_col")).alias("w"),
                       *[F.get("_r", F.get("hkl_cols", F.lit(k))).cast("int").alias(n) for k, n in enumerate("hkl")])
