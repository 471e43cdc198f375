"""Lines that many documents repeat, by levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line hash, so runs meet in merge joins without a
shuffle.  A batch of documents is reduced to its distinct hashes, anti-joined with the
runs there are, and added as a run of its own; when a level has ``fanout`` runs they are
merged into one run of the next level.  Batches come from the largest ids downwards: a
hash that no run has is in the largest document that will ever hold it, and the run keeps
that document beside the number of documents.  Hashes already in a run add their number only.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import checkpoint_folder
from .common import join_split_hot, text_mark, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
#: Hashes a bucket is meant to hold; the number of buckets follows the number of lines.
BUCKET_ROWS = 2_000_000
#: White space that is stripped, and the letters that are lower-cased.
STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class LineRuns:
    """The runs of a store of line hashes: ``key, docs, last`` each, with ``last`` null where an older run has it.

    ``levels[i]`` names the runs of level ``i``, none of them larger than ``fanout ** i`` batches.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        if buckets < 1 or fanout < 2:
            raise ValueError("a store has at least one bucket and merges at least two runs")
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        """All runs, the largest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def store(self, rows: DataFrame, level: int) -> None:
        """Write ``rows`` as one sorted run of ``level``."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{checkpoint_folder(self.spark)}/braggline-{name}"
        (rows.repartition(self.buckets, "key").write.format("parquet").option("path", path)
         .bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch``, one per key, whose key is in no run."""
        for run in self.runs():
            batch = batch.join(run.select("key").hint("merge"), "key", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Anti-join ``batch`` (``key, docs, last``, one row per key) with the runs and add it as a run."""
        if any(self.levels):
            new = self.unseen(batch).select("key", "last")
            batch = batch.drop("last").join(new.hint("merge"), "key", "left")
        self.store(batch.select("key", "docs", "last"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of ``level`` into one of the next."""
        names, self.levels[level] = self.levels[level], []
        self.store(merged([self.spark.table(n) for n in names]), level + 1)
        for name in names:
            self.spark.sql(f"drop table {name}")

    def entries(self) -> DataFrame:
        """``key, docs, last`` over all runs, one row per key."""
        return merged(self.runs())


def merged(runs: list[DataFrame]) -> DataFrame:
    """Sums of ``docs`` per key; the one ``last`` that a run has is kept."""
    both, *more = runs
    for run in more:
        other = run.select("key", F.col("docs").alias("more"), F.col("last").alias("also")).hint("merge")
        both = both.join(other, "key", "full").select(
            "key", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "also").alias("last"))
    return both


def lines_of(text: str | Column) -> Column:
    """The lines of a text; null is one empty line."""
    col = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(col, F.lit("")), "\n", -1)


def line_hashes(lines: Column, min_chars: int) -> Column:
    """The hash of each line's key as hexadecimal text, null where the key is short."""
    def one(line):
        key = F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)
        return F.when(F.length(key) >= min_chars, F.md5(key))
    return F.transform(lines, one)


def batch_numbers(docs: DataFrame, key: str, batches: int) -> Column:
    """Number the ids' ranges from the largest, equal ids together and a null id last."""
    cuts = docs.agg(F.percentile_approx(F.col(key), [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    below = [F.when(F.col(key) <= c, 1).otherwise(0) for c in sorted(set(cuts or []))]
    return F.when(F.col(key).isNull(), len(below)).otherwise(sum(below, F.lit(0)))


def hashed_documents(docs: DataFrame, key: str, text: str, min_chars: int, batches: int) -> str:
    """Write ``mark, doc_id, hashes`` of the documents, a folder per batch, and return its path."""
    path = f"{checkpoint_folder(docs.sparkSession)}/braggline-line-hashes-{uuid.uuid4().hex}"
    hashes = F.array_distinct(F.filter(line_hashes(lines_of(text), min_chars), lambda h: h.isNotNull()))
    # Rows without long lines are written too: a condition on the hashes would have them made twice.
    docs.select(row_mark(key, text).alias("mark"), F.col(key).alias("doc_id"), hashes.alias("hashes"),
                batch_numbers(docs, key, batches).alias("batch")).write.partitionBy("batch").parquet(path)
    return path


def row_mark(key: str, text: str) -> Column:
    """What tells a row apart: rows equal in id and text meet the same fate."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), text_mark(text))))


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, hashes: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines whose hash is to go, null where no line is left."""
    out = []
    for text, own, drop in zip(texts, hashes, gone):
        if drop is None:
            out.append(None)
        else:
            drop = set(drop)
            left = [line for line, h in zip(text.split("\n"), own) if h not in drop]
            out.append("\n".join(left) if left else None)
    return pd.Series(out, dtype=object)


def deduplicate(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: every row's text without its repeated lines.

    A line's key is the line stripped of ASCII white space at both ends, A-Z in lower case.  Keys of
    ``min_chars`` code points or more in ``min_docs`` rows or more lose all their lines but those of the largest
    id holding it; a null id is below all others.  Every row is a document, also one that repeats an id; rows
    of the largest id all keep their lines.  A null or empty text is one empty line.  An empty table gives an
    empty result; other columns are not read.  Neither ``batches`` nor ``fanout`` changes the result.
    """
    spark = docs.sparkSession
    path = hashed_documents(docs, key, text, min_chars, batches)
    schema = f"mark binary, doc_id {docs.schema[key].dataType.simpleString()}, hashes array<string>, batch int"
    facts = spark.read.schema(schema).parquet(path)
    size = facts.agg(F.sum(F.size("hashes").cast("long")).alias("lines"), F.collect_set("batch").alias("batches")).first()
    rows = facts.select("mark", "doc_id", "batch", F.explode("hashes").alias("h")).select("mark", "doc_id", "batch", F.unhex("h").alias("key"))
    store = LineRuns(spark, max(-(-(size["lines"] or 0) // BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), fanout)
    for number in sorted(size["batches"]):
        store.add(rows.where(F.col("batch") == number).groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")))
    read = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), row_mark(key, text).alias("mark"))
    if any(store.levels):
        often = written(store.entries().where(F.col("docs") >= min_docs), "repeated-lines")
        meet = join_split_hot(rows.drop("batch"), often, "key", "docs", size["lines"], "inner").where(~F.col("doc_id").eqNullSafe(F.col("last")))
        gone = meet.groupBy("mark").agg(F.collect_set(F.lower(F.hex("key"))).alias("gone"))
    else:
        gone = spark.createDataFrame([], "mark binary, gone array<string>")
    lines = lines_of("text")
    hit = F.col("gone").isNotNull()
    # Rows that lose nothing send no text to the Python worker.
    left = read.join(gone, "mark", "left").select(
        "doc_id", "text", F.size(lines).cast("long").alias("n_lines"),
        without_lines(F.when(hit, F.col("text")), F.when(hit, line_hashes(lines, min_chars)), "gone").alias("less"), hit.alias("hit"))
    after = F.when(F.col("less").isNull(), 0).otherwise(F.size(lines_of("less")))
    dropped = F.when(F.col("hit"), F.col("n_lines") - after).otherwise(0).cast("long")
    kept = F.when(F.col("hit"), F.coalesce("less", F.lit(""))).otherwise(F.col("text"))
    return left.select("doc_id", "n_lines", dropped.alias("n_dropped"), kept.alias("kept"))
