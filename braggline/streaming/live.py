"""Live runs: settle, de-duplicate, append, retry, and keep tracks open between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracks import Linker
from ..session import checkpointed

MAX_RETRIES = 3
#: Folder numbers from one batch to the next.
STEPS = 8


def settled(polls: DataFrame) -> DataFrame:
    """Sources whose ``size, mtime`` did not change between two polls, each once.

    ``polls`` streams ``source, poll, size, mtime``; the state per source is its
    last signature and whether it was passed on.
    """
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, mtime, done = state.get if state.exists else (None, None, False)
        rows = pd.concat(list(batches)).sort_values("poll")
        ready = None
        for row in rows.itertuples():
            if not done and (size, mtime) == (row.size_, row.mtime):
                done, ready = True, row.poll
            size, mtime = row.size_, row.mtime
        state.update((int(size), float(mtime), bool(done)))
        yield pd.DataFrame({"source": [key[0]], "poll": [ready]} if ready is not None else {"source": [], "poll": []})

    return (polls.select("source", "poll", F.col("size").alias("size_"), "mtime").groupBy("source")
            .applyInPandasWithState(run, "source string, poll bigint", "size bigint, mtime double, done boolean",
                                    "append", GroupStateTimeout.NoTimeout))


def ready_stack_frames(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """Frames of stack files, holding back the newest frame of one that still grows.

    ``listing`` is ``file, n_frames`` of this poll, ``previous`` of the last one.
    """
    known = previous.select("file", F.col("n_frames").alias("_before"))
    growing = F.col("n_frames") > F.coalesce("_before", F.lit(0))
    usable = F.col("n_frames") - F.when(growing, 1).otherwise(0)
    return (listing.join(known, "file", "left").withColumn("usable", usable).where(F.col("usable") > 0)
            .select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("usable").cast("long") - 1)).alias("index")))


def first_arrivals(arrivals: DataFrame, name: str = "display", stamp: str = "ts", delay: str | None = None) -> DataFrame:
    """Each display name once.  Names are remembered for good, or with a ``delay`` at least that long and then forgotten."""
    if delay is None:
        return arrivals.dropDuplicates([name])
    return arrivals.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([name])


def arrival_rates(arrivals: DataFrame, stamp: str = "ts", window: str = "1 hour", delay: str = "10 minutes",
                  slide: str | None = None) -> DataFrame:
    """Arrivals and summed value per event-time window."""
    span = F.window(stamp, window, slide) if slide else F.window(stamp, window)
    return (arrivals.withWatermark(stamp, delay).groupBy(span.alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
            .select(F.col("w.start").alias("start"), "event_type", "n", "value"))


def sessions(arrivals: DataFrame, key: str = "user_id", stamp: str = "ts", gap: str = "2 hours",
             delay: str = "10 minutes") -> DataFrame:
    """Runs of arrivals without a silence longer than ``gap``."""
    return (arrivals.withWatermark(stamp, delay).groupBy(F.session_window(stamp, gap).alias("s"), key)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n"))


class AppendSink:
    """``foreachBatch`` sink that writes each batch under its own id.

    A replayed batch overwrites its own folder, so the table holds every frame
    once.  ``frame`` numbers follow arrival: the offset of a batch is the row
    count of the batches before it, and rows in a batch keep the given order.  Of
    the good arrivals of one name the first in ``order`` is stored.  The arrivals of
    names without a good one are kept and tried again with the next batch, three
    times in all; then they are given up.  Rows without a name are set aside in ``unnamed``.
    ``finish`` ends a run: it tries what still waits and brings the analysis up to date.
    Folders are numbered with room between two batches for those tries, so a run that is
    resumed afterwards overwrites none of them.
    """

    def __init__(self, path: str, order: str, integrate: Callable[[DataFrame], DataFrame] | None = None,
                 analyze: Callable[[str], None] | None = None, analyze_every: int = 1):
        self.path, self.order = path.rstrip("/"), order
        self.integrate, self.analyze, self.analyze_every = integrate, analyze, max(1, analyze_every)

    def table(self, spark, name: str) -> DataFrame | None:
        """A table below the sink's folder, or None if nothing was written yet; other errors are errors."""
        from pyspark.errors import AnalysisException
        try:
            return spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def stored(self, spark) -> DataFrame | None:
        return self.table(spark, "frames")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.append(batch, batch_id * STEPS)
        if self.analyze is not None and (batch_id + 1) % self.analyze_every == 0:
            self.run_analysis(batch.sparkSession)

    def run_analysis(self, spark) -> None:
        """Analyse the stored frames and note how many there were."""
        frames = self.stored(spark)
        self.analyze(self.path)
        spark.createDataFrame([(frames.count() if frames is not None else 0,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/analysed")

    def last_batch(self, spark) -> int:
        tables = [t for t in (self.stored(spark), self.table(spark, "failures")) if t is not None]
        return max((t.agg(F.max("batch")).first()[0] or 0 for t in tables), default=0)

    def waiting(self, spark) -> DataFrame | None:
        """The failed arrivals that may be tried again."""
        failed = self.table(spark, "failures")
        if failed is None:
            return None
        last = failed.where(F.col("batch") == failed.agg(F.max("batch")).scalar())
        return last.where(F.col("_tries") < MAX_RETRIES)

    def finish(self, spark) -> dict:
        """Try what still waits until it succeeds or is given up, then analyse if frames came since; returns the counts of the run."""
        while (rest := self.waiting(spark)) is not None and not rest.isEmpty():
            self.append(rest.drop("batch", "_tries").limit(0), self.last_batch(spark) + 1)
        frames, analysed = self.stored(spark), self.table(spark, "analysed")
        n = 0 if frames is None else frames.count()
        if self.analyze is not None and n > (0 if analysed is None else analysed.first()["n"]):
            self.run_analysis(spark)
        return {"n_frames": n, "n_failed": self.given_up(spark).count()}

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Store the good arrivals of a batch and of those that wait, under the number ``batch_id``."""
        from ..operators.ordered import with_rank
        spark = batch.sparkSession
        if not (nameless := batch.where(F.col("display").isNull())).isEmpty():
            nameless.write.mode("overwrite").parquet(f"{self.path}/unnamed/batch={batch_id}")
        incoming = checkpointed(self.with_waiting(batch.where(F.col("display").isNotNull()), batch_id))
        before = self.stored(spark)
        offset = 0
        if before is not None:
            before = before.where(F.col("batch") < batch_id)
            incoming = incoming.join(before.select("display"), "display", "left_anti")
            offset = before.count()
        rows = incoming.drop("_tries")
        rows = self.integrate(rows) if self.integrate else rows
        if "ok" in rows.columns:
            rows = checkpointed(rows)  # integrated once, read for both outcomes
            good = rows.where(F.coalesce("ok", F.lit(False)))
            lost = incoming.join(good.select("display"), "display", "left_anti")
            (lost.withColumn("_tries", F.col("_tries") + 1).write.mode("overwrite").parquet(f"{self.path}/failures/batch={batch_id}"))
            rows = good
        first = rows.groupBy("display").agg(F.min_by(F.struct(*rows.columns), F.struct(F.col(self.order).isNull(), F.col(self.order))).alias("_row"))
        rows = first.select("_row.*")
        ordered = with_rank(rows.withColumn("_o", F.col(self.order).cast("double")), [], ["_o", "display"], "_o", 3600.0, "frame").drop("_o")
        (ordered.withColumn("frame", F.col("frame") + offset)
         .write.mode("overwrite").parquet(f"{self.path}/frames/batch={batch_id}"))

    def with_waiting(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The arrivals of a batch and those that failed in the batch before and may be tried again."""
        now = batch.withColumn("_tries", F.lit(0))
        failed = self.table(batch.sparkSession, "failures")
        if failed is None:
            return now
        earlier = failed.where(F.col("batch") < batch_id)
        waiting = earlier.where(F.col("batch") == earlier.agg(F.max("batch")).scalar()).drop("batch")
        tries = waiting.groupBy("display").agg(F.max("_tries").alias("_before"))
        again = now.join(tries, "display", "left").withColumn("_tries", F.coalesce("_before", "_tries")).drop("_before")
        # A name that was given up stays so, also if it arrives again.
        gone = earlier.where(F.col("_tries") >= MAX_RETRIES).select("display").distinct()
        return again.unionByName(waiting, allowMissingColumns=True).join(gone, "display", "left_anti")

    def given_up(self, spark) -> DataFrame:
        """Names that failed three times."""
        failed = self.table(spark, "failures")
        if failed is None:
            return spark.createDataFrame([], "display string, tries int")
        tries = failed.where(F.col("_tries") >= MAX_RETRIES)
        return tries.groupBy("display").agg(F.max("_tries").alias("tries"))


def step_analysis(spark, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[str], None]:
    """An ``analyze`` for the sink: each step gets the stored frames (the first) or the step before it, and is written beside them."""
    def run(path: str) -> None:
        rows = spark.read.parquet(f"{path}/frames")
        for name, step in steps.items():
            step(rows).write.mode("overwrite").parquet(f"{path}/analysis/{name}")
            rows = spark.read.parquet(f"{path}/analysis/{name}")
    return run


def run_live(stream: DataFrame, sink: AppendSink, checkpoint: str, *, once: bool = True, poll: str = "5 seconds"):
    """Start the live query; the checkpoint folder makes it resume where it stopped."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()


def open_tracks(observations: DataFrame, *, link_tol: float = 1.5, max_gap: int = 2) -> DataFrame:
    """Link a stream of observations per series; open tracks live in the keyed state.

    Positions of a series must arrive in order.  The state holds the open tracks
    only, a few numbers each.
    """
    point = T.StructType([T.StructField("id", T.StringType()), T.StructField("position", T.LongType()),
                          T.StructField("fwhm", T.DoubleType()), T.StructField("axis", T.ArrayType(T.DoubleType())),
                          T.StructField("center", T.ArrayType(T.DoubleType()))])
    state_type = T.StructType([T.StructField("open", T.ArrayType(point))])
    output = T.StructType([T.StructField("series", T.LongType()), T.StructField("obs", T.StringType()),
                           T.StructField("position", T.LongType()), T.StructField("track", T.StringType())])

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        linker = Linker(link_tol, max_gap, None, False, None, 0.0)
        if state.exists:
            for row in state.get[0]:
                linker.open.append({"id": row[0], "position": row[1], "fwhm": row[2], "row": None,
                                    "points": list(zip(row[3], row[4]))})
        rows = pd.concat(list(batches)).sort_values(["position", "obs"])
        out = []
        for position, at in rows.groupby("position", sort=True):
            records = at.to_dict("records")
            ids = linker.advance(int(position), float(position), records)
            out += [(int(key[0]), r["obs"], int(position), i) for r, i in zip(records, ids)]
        state.update(([(t["id"], int(t["position"]), float(t["fwhm"]), [float(a) for a, _ in t["points"]],
                        [float(c) for _, c in t["points"]]) for t in linker.open],))
        yield pd.DataFrame(out, columns=output.names)

    return observations.groupBy("series").applyInPandasWithState(run, output, state_type, "append", GroupStateTimeout.NoTimeout)
