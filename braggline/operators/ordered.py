"""Ordered operators that never sort one whole group in one task.

A group (a series, a scan, a frame) can hold a large share of all rows.  Each
helper cuts a group into chunks that are a pure function of the ordering value,
runs the window inside ``(group, chunk)``, and carries what crosses a chunk edge
through a summary with one row per chunk.  A null group key is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

CHUNK = "_chunk"
GROUP = "_group"


def grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Put the group keys into one struct: it is never null, and null fields are equal to each other in joins."""
    return (df.withColumn(GROUP, F.struct(*by)), [GROUP]) if by else (df, [])


def with_chunk(df: DataFrame, value: str, width: float) -> DataFrame:
    """Add the chunk id of the ordering value; nulls sort last in their own chunk."""
    return df.withColumn(CHUNK, F.coalesce(F.floor(F.col(value) / F.lit(float(width))),
                                           F.lit(2 ** 62)))


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str,
                  width: float, columns: Sequence[str], prefix: str = "prev_", once: bool = False) -> DataFrame:
    """Add ``prev_<col>`` of the row before, in ``order`` within ``by``.

    ``value`` is the leading order column; ``width`` its chunk width.  With ``once`` the rows are shuffled
    once, for the chunks' last rows and the windows alike, if ``columns`` has all columns of the row.
    """
    df, by = grouped(df, list(by))
    order = list(order)
    chunked = with_chunk(df, value, width)
    if once:
        chunked = chunked.repartition(*by, CHUNK)
    key = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in columns])
    last = (chunked.groupBy(*by, CHUNK).agg(F.max_by(payload, key).alias("_last"))
            .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*by).orderBy(CHUNK))).drop("_last"))
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order)
    out = chunked.join(last, [*by, CHUNK], "left").withColumn("_row", F.row_number().over(inside))
    for c in columns:
        out = out.withColumn(prefix + c, F.when(F.col("_row") == 1, F.col(f"_carry.{c}"))
                             .otherwise(F.lag(c).over(inside)))
    return out.drop(CHUNK, GROUP, "_carry", "_row")


def with_running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str,
                     width: float, amount: Column, name: str) -> DataFrame:
    """Add the inclusive running sum of ``amount`` in ``order`` within ``by``."""
    df, by = grouped(df, list(by))
    order = list(order)
    chunked = with_chunk(df.withColumn("_amount", amount), value, width)
    before = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = (chunked.groupBy(*by, CHUNK).agg(F.sum("_amount").alias("_total"))
              .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total"))
    inside = (Window.partitionBy(*by, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (chunked.join(totals, [*by, CHUNK], "left")
            .withColumn(name, F.sum("_amount").over(inside) + F.col("_offset"))
            .drop(CHUNK, GROUP, "_amount", "_offset"))


def with_running_max_before(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str,
                            width: float, amount: str, name: str) -> DataFrame:
    """Add the maximum of ``amount`` over all earlier rows of the group."""
    df, by = grouped(df, list(by))
    order = list(order)
    chunked = with_chunk(df, value, width)
    before = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    tops = (chunked.groupBy(*by, CHUNK).agg(F.max(amount).alias("_top"))
            .withColumn("_carry", F.max("_top").over(before)).drop("_top"))
    inside = (Window.partitionBy(*by, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (chunked.join(tops, [*by, CHUNK])
            .withColumn(name, F.greatest(F.max(amount).over(inside), F.col("_carry")))
            .drop(CHUNK, GROUP, "_carry"))


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str,
              width: float, name: str = "rank") -> DataFrame:
    """Add a 0-based position in ``order`` within ``by`` (nulls of ``value`` last)."""
    ordering = [F.col(order[0]).asc_nulls_last(), *[F.col(c) for c in order[1:]]]
    out = with_running_sum(df, by, ordering, value, width, F.lit(1), "_pos")
    return out.withColumn(name, (F.col("_pos") - 1).cast("long")).drop("_pos")


def with_running_sum_by_range(df: DataFrame, order: Sequence[Column], amount: Column, name: str) -> DataFrame:
    """Add the inclusive running sum of ``amount`` over the whole table in ``order``.

    The chunks are ranges that Spark samples from the data, as many as the session has
    shuffle partitions, so they are even however the values lie.  They are checkpointed,
    as another sampling might cut elsewhere.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.withColumn("_amount", amount).repartitionByRange(count, *order).withColumn(CHUNK, F.spark_partition_id()))
    # One row per chunk in this window, bounded by the number of partitions.
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(CHUNK).agg(F.sum("_amount").alias("_total")).select(
        CHUNK, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (placed.join(totals, CHUNK).withColumn(name, F.sum("_amount").over(inside) + F.col("_offset"))
            .drop(CHUNK, "_amount", "_offset"))


def with_island(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str,
                width: float, gap: Column | float, name: str = "island") -> DataFrame:
    """Gaps and islands: a new island starts where ``value`` moves on by more than ``gap``.

    One summary per chunk holds its first and last value and the islands that
    start inside it; that decides both the start at its edge and the offset.
    """
    df, by = grouped(df, list(by))
    order = list(order)
    limit = gap if isinstance(gap, Column) else F.lit(float(gap))
    chunked = with_chunk(df, value, width)
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order)
    step = F.col(value) - F.lag(value).over(inside)
    marked = chunked.withColumn("_start", F.when(step > limit, 1).otherwise(0))
    chunks = Window.partitionBy(*by).orderBy(CHUNK)
    before = chunks.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (marked.groupBy(*by, CHUNK)
               .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_start").alias("_inner"))
               .withColumn("_edge", F.when(F.col("_lo") - F.lag("_hi").over(chunks) > limit, 1).otherwise(0))
               .withColumn("_base", F.sum(F.col("_edge") + F.col("_inner")).over(before) - F.col("_inner"))
               .select(*by, CHUNK, "_base"))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (marked.join(offsets, [*by, CHUNK], "left")
            .withColumn(name, (F.sum("_start").over(running) + F.col("_base")).cast("long"))
            .drop(CHUNK, GROUP, "_start", "_base"))


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = 100_000) -> DataFrame:
    """Exact linear-interpolated quantiles per group, columns ``q0, q1, ...`` and ``n``.

    A mergeable sketch brackets each quantile, a second scan counts the rows
    below the bracket and keeps only the values inside it, already counted per
    distinct value.  Groups no larger than the sketch skip the bracket.
    """
    by, qs = list(by), [float(q) for q in qs]
    data = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    margin = 4.0 / accuracy
    probes = [p for q in qs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = (data.groupBy(*by)
              .agg(F.count(F.lit(1)).alias("_n"),
                   F.percentile_approx("_v", probes, accuracy).alias("_probe")))
    spans = sketch.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], "_n",
        F.explode(F.array(*[F.struct(
            F.lit(i).alias("qi"), F.lit(q).alias("q"),
            F.when(F.col("_n") > accuracy, F.col("_probe")[2 * i]).alias("lo"),
            F.when(F.col("_n") > accuracy, F.col("_probe")[2 * i + 1]).alias("hi"))
            for i, q in enumerate(qs)])).alias("_q"))
    if by:
        cond = F.lit(True)
        for k in by:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = data.join(spans, cond)
    else:
        spans_array = sketch.select(F.struct("_n", "_probe")).scalar()
        joined = data.withColumn("_s", spans_array).select(
            "_v", F.col("_s._n").alias("_n"),
            F.explode(F.array(*[F.struct(
                F.lit(i).alias("qi"), F.lit(q).alias("q"),
                F.when(F.col("_s._n") > accuracy, F.col("_s._probe")[2 * i]).alias("lo"),
                F.when(F.col("_s._n") > accuracy, F.col("_s._probe")[2 * i + 1]).alias("hi"))
                for i, q in enumerate(qs)])).alias("_q"))
    below = F.col("_q.lo").isNotNull() & (F.col("_v") < F.col("_q.lo"))
    counted = (joined
               .where(F.col("_q.hi").isNull() | (F.col("_v") <= F.col("_q.hi")))
               .groupBy(*by, F.col("_q.qi").alias("_qi"), F.col("_q.q").alias("_qq"), "_n",
                        F.when(~below, F.col("_v")).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_c")))
    order = (Window.partitionBy(*by, "_qi").orderBy(F.col("_v").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("_cum", F.sum("_c").over(order))
    rank = F.col("_qq") * (F.col("_n") - 1)

    def at(position: Column) -> Column:
        hit = (F.col("_cum") > position) & (F.col("_cum") - F.col("_c") <= position)
        return F.max(F.when(hit, F.col("_v")))

    picked = (placed.groupBy(*by, "_qi", "_n")
              .agg(at(F.floor(rank)).alias("_lo"), at(F.ceil(rank)).alias("_hi"),
                   F.max(rank - F.floor(rank)).alias("_f"))
              .withColumn("_val", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")))
    return picked.groupBy(*by).agg(
        F.max("_n").alias("n"),
        *[F.max(F.when(F.col("_qi") == i, F.col("_val"))).alias(f"q{i}") for i in range(len(qs))])


def median_and_mad(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Columns ``n``, ``median`` and ``mad`` (unscaled) per group."""
    by = list(by)
    centre = exact_quantiles(df, value, [0.5], by).withColumnRenamed("q0", "median")
    if by:
        renamed = centre.select(*[F.col(k).alias(f"_m_{k}") for k in by], "median")
        cond = F.lit(True)
        for k in by:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        deviations = df.select(*by, value).join(renamed, cond).select(
            *by, F.abs(F.col(value) - F.col("median")).alias("_dev"))
        spread = exact_quantiles(deviations, "_dev", [0.5], by)
        spread = spread.select(*[F.col(k).alias(f"_m_{k}") for k in by], F.col("q0").alias("mad"))
        return centre.join(spread, cond).select(*by, "n", "median", "mad")
    deviations = df.select(F.abs(F.col(value) - centre.select("median").scalar()).alias("_dev"))
    spread = exact_quantiles(deviations, "_dev", [0.5])
    return centre.withColumn("mad", spread.select("q0").scalar())
