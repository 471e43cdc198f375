"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder, checkpointed

#: ASCII white space of the word rules: blank, tab, newline, vertical tab, form feed, return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_crc(column: str | Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def unit_hash(*parts: str | Column) -> Column:
    """52 bits of an md5 over ``parts`` as a number in (0, 1); the same in any SQL engine with md5."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again.

    The lineage ends at the files, so a lost executor costs no recomputation; the
    columns are compressed, unlike those of ``checkpoint()``.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/braggline-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no piece of more than one row holds over ``limit`` bytes of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def joined_bytes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``values`` one after another, and the start of each (with the end last)."""
    ends = np.zeros(len(values) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)), out=ends[1:])
    return np.frombuffer(b"".join(values), np.uint8), ends


def dense_rank_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 0 in ``order`` without a window over the whole table.

    Rows are range-partitioned and sorted, the partitions are counted, and each row
    gets its place in its partition plus the rows of the partitions before.  The
    sorted rows are checkpointed between, as a second sampling might cut elsewhere.
    """
    spot = F.monotonically_increasing_id()
    cut = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = checkpointed(df.repartitionByRange(int(cut), *order).sortWithinPartitions(*order)
                          .withColumn("_part", F.shiftright(spot, 33)).withColumn("_place", spot.bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: bounded by the session's partition number, not by the rows.
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def join_split_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, how: str = "left", parts: int = 1_000) -> DataFrame:
    """Join ``rows`` to ``facts``, one row per ``key`` with its rows counted in ``count``, without a hot task.

    The counts add up to ``total`` at most, so at most ``parts`` keys hold a ``parts``-th of it:
    these are broadcast and their rows stay where they are.  All other keys meet in a shuffle.
    """
    large = F.col(count) * parts >= total
    other = fresh(rows, "__hot")
    hot, cold = facts.where(large), facts.where(~large)
    found = rows.join(F.broadcast(hot.withColumn(other, F.lit(True))), key, "left")
    done = found.where(F.col(other)).drop(other)
    rest = found.where(F.col(other).isNull()).select(*rows.columns).join(cold, key, how)
    return done.unionByName(rest)


def sums_before(rows: DataFrame, group: str, order: list[str], amount: str, name: str, piece_rows: int) -> DataFrame:
    """Add the sum of ``amount`` over the rows of the same ``group`` that stand before in ``order``.

    Rows are range-partitioned by group and order into pieces of about ``piece_rows``, so
    neither a large group nor rows of one key meet in a task as long as ``order`` tells them
    apart; sums of whole pieces carry what lies before.  A null group is a group of its own.
    """
    piece, place, start = (fresh(rows.withColumn(name, F.lit(0)), n) for n in ("__piece", "__within", "__pieces"))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, as a second sampling might cut elsewhere.
    cut = written(rows.repartitionByRange(max(least, -(-rows.count() // piece_rows)), F.col(group).asc_nulls_last(), *order)
                  .withColumn(piece, F.spark_partition_id()), "pieces")
    inside = Window.partitionBy(group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy(group, piece).agg(F.sum(amount).alias(start))
              .select(F.col(group).alias("__g"), F.col(piece).alias("__p"), F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start)))
    placed = cut.withColumn(place, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return (placed.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col(piece) == F.col("__p")))
            .withColumn(name, F.col(start) + F.col(place)).drop(piece, place, start, "__g", "__p"))


def numbers_below(count: str, name: str) -> list[Column]:
    """Two generators, one after the other, of the numbers from 0 to ``count - 1``; no array is longer than its root."""
    return [F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(1 << 16).cast("long"))).alias("__block"),
            F.explode(F.sequence(F.col("__block"), F.least(F.col("__block") + (1 << 16), F.col(count)) - 1)).alias(name)]


def numbered(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Every row ``count`` times (1 at least), numbered from 0 in ``name``."""
    block, each = numbers_below(count, name)
    return rows.select("*", block).select(*rows.columns, each)


def shipped(spark: SparkSession, value: object):
    """Broadcast ``value`` by value with its classes: the workers need not have this package."""
    cloudpickle.register_pickle_by_value(importlib.import_module(__package__))
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast) -> object:
    """The value of a ``shipped`` broadcast, unpacked once per worker."""
    if not hasattr(broadcast, "unpacked"):
        broadcast.unpacked = cloudpickle.loads(broadcast.value)
    return broadcast.unpacked


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with as many ``_`` before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_mark(text: str) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def marked_rows(docs: DataFrame, key: str, mark: Column, wanted: DataFrame, first: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose key and ``mark`` are together in ``wanted`` (two columns), with all their columns.

    ``wanted`` has a pair as often as ``docs`` has rows of it.  Rows equal in both are one
    document: the one with the largest ``first`` stays, or any.
    """
    spot, own, other, more, row = (fresh(docs, name) for name in ("__id", "__mark", "__wanted", "__again", "__row"))
    pairs = wanted.toDF(spot, other).groupBy(spot, other).agg((F.count(F.lit(1)) > 1).alias(more))
    found = docs.withColumn(own, mark).join(pairs, F.col(own).eqNullSafe(F.col(other)) & F.col(key).eqNullSafe(F.col(spot)))
    single = found.where(~F.col(more)).select(*docs.columns)
    order = F.lit(0) if first is None else first
    again = found.where(F.col(more)).groupBy(spot, other).agg(F.max_by(F.struct(*docs.columns), order).alias(row)).select(f"{row}.*")
    return single.unionByName(again)
