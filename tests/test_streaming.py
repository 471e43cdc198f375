"""Live operators: stream equals batch, resume, retries, open tracks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from braggline.operators import tracks
from braggline.sources import files
from braggline.sources.tables import view
from braggline.streaming import live


def drain(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def parts(spark, df, folder, n):
    """Write ``df`` as ``n`` input files, oldest first."""
    for i in range(n):
        df.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.drop("_part").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_settling_needs_two_equal_polls(spark, tmp_path):
    rows = [("a", 0, 10, 1.0, 0), ("b", 0, 5, 1.0, 0), ("a", 1, 10, 1.0, 1), ("b", 1, 6, 2.0, 1), ("b", 2, 6, 2.0, 2), ("a", 2, 10, 1.0, 2)]
    df = spark.createDataFrame(rows, "source string, poll bigint, size bigint, mtime double, _part int")
    out = drain(spark, live.settled(parts(spark, df, tmp_path / "polls", 3)), "settled")
    assert sorted((r.source, r.poll) for r in out.collect()) == [("a", 1), ("b", 2)]


def test_first_arrivals_and_rates_match_batch(spark, tmp_path):
    arrivals = view(spark, "/root/testdata/sf0.001", "arrivals").withColumn("_part", F.lit(0))
    stream = parts(spark, arrivals, tmp_path / "arr", 1)
    batch = arrivals.drop("_part")
    first = drain(spark, live.first_arrivals(stream, delay="60 days"), "first_arrivals")
    assert first.count() == batch.select("display").distinct().count()
    rates = drain(spark, live.arrival_rates(stream), "rates", "complete").toPandas()
    want = live.arrival_rates(batch).toPandas()
    key = ["start", "event_type"]
    pd.testing.assert_frame_equal(rates.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_append_sink_numbers_arrivals_once_and_resumes(spark, tmp_path):
    rows = [("f1", 1.0, True, 0), ("f2", 2.0, True, 0), ("f2", 3.0, True, 1), ("f3", 4.0, True, 1), ("f4", 5.0, True, 2)]
    df = spark.createDataFrame(rows, "display string, t double, ok boolean, _part int")
    seen = []
    sink = live.AppendSink(str(tmp_path / "out"), "t", analyze=seen.append, analyze_every=2)
    stream = parts(spark, df, tmp_path / "in", 3)
    live.run_live(stream, sink, str(tmp_path / "chk")).awaitTermination(120)
    got = {r.display: r.frame for r in spark.read.parquet(str(tmp_path / "out/frames")).collect()}
    assert sorted(got) == ["f1", "f2", "f3", "f4"] and sorted(got.values()) == [0, 1, 2, 3]
    assert len(seen) == 1
    # A replay of the last batch leaves the table as it is, and a restart adds only what is new.
    sink(df.where("_part = 2").drop("_part"), 2)
    spark.createDataFrame([("f5", 9.0, True)], "display string, t double, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.run_live(stream, sink, str(tmp_path / "chk")).awaitTermination(120)
    again = {r.display: r.frame for r in spark.read.parquet(str(tmp_path / "out/frames")).collect()}
    assert again == {**got, "f5": 4}


def test_failed_frames_are_given_up_after_three_batches(spark, tmp_path):
    sink = live.AppendSink(str(tmp_path / "out"), "t")
    for batch in range(3):
        sink(spark.createDataFrame([("bad", 1.0, False), (f"good{batch}", 2.0, True)], "display string, t double, ok boolean"), batch)
    assert [r.display for r in sink.given_up(spark).collect()] == ["bad"]


def test_a_good_arrival_beats_a_failed_one_and_failures_are_tried_again(spark, tmp_path):
    schema = "display string, t double, ok boolean"
    healed = {"late": 0}

    def integrate(rows):
        healed["late"] += 1
        return rows.withColumn("ok", F.col("ok") | ((F.col("display") == "late") & (F.lit(healed["late"]) >= 3)))

    sink = live.AppendSink(str(tmp_path / "out"), "t", integrate)
    sink(spark.createDataFrame([("a", 1.0, False), ("a", 2.0, True), ("late", 3.0, False), ("never", 1.0, False)], schema), 0)
    sink(spark.createDataFrame([("b", 4.0, True), ("b", 5.0, True)], schema), 1)
    sink(spark.createDataFrame([], schema), 2)
    sink(spark.createDataFrame([("never", 9.0, True)], schema), 3)
    got = {r.display: (r.frame, r.t) for r in sink.stored(spark).collect()}
    assert got == {"a": (0, 2.0), "b": (1, 4.0), "late": (2, 3.0)}
    assert [r.display for r in sink.given_up(spark).collect()] == ["never"]


def test_a_run_ends_with_failures_tried_and_frames_analysed(spark, tmp_path):
    """The last batch leaves a failure that heals, one that does not, a nameless row and a late repeat; then the run is resumed."""
    schema = "display string, t double, ok boolean"
    calls = {"n": 0}

    def integrate(rows):
        calls["n"] += 1
        return rows.withColumn("ok", F.col("ok") | ((F.col("display") == "slow") & (F.lit(calls["n"]) >= 3)))

    path = str(tmp_path / "out")
    analyze = live.step_analysis(spark, {"doubled": lambda f: f.withColumn("t", F.col("t") * 2), "total": lambda f: f.agg(F.sum("t").alias("t"))})
    sink = live.AppendSink(path, "t", integrate, analyze, analyze_every=2)
    assert sink.given_up(spark).collect() == [] and sink.finish(spark) == {"n_frames": 0, "n_failed": 0}
    rows = [("a", 1.0, True, 0), (None, 9.0, True, 0), ("b", 2.0, True, 1), ("a", 3.0, True, 2), ("slow", 4.0, False, 2), ("never", 5.0, False, 2)]
    df = spark.createDataFrame(rows, "display string, t double, ok boolean, _part int")
    live.run_live(parts(spark, df, tmp_path / "in", 3), sink, str(tmp_path / "chk")).awaitTermination(120)
    assert spark.read.parquet(f"{path}/analysis/total").first().t == 6.0
    assert sink.finish(spark) == {"n_frames": 3, "n_failed": 1}
    assert spark.read.parquet(f"{path}/analysis/total").first().t == 14.0
    assert {r.display: r.frame for r in sink.stored(spark).collect()} == {"a": 0, "b": 1, "slow": 2}
    assert sink.table(spark, "unnamed").count() == 1 and [r.display for r in sink.given_up(spark).collect()] == ["never"]
    assert sink.finish(spark) == {"n_frames": 3, "n_failed": 1}
    sink(spark.createDataFrame([("c", 6.0, True), ("never", 7.0, True)], schema), 3)
    assert {r.display: r.frame for r in sink.stored(spark).collect()} == {"a": 0, "b": 1, "slow": 2, "c": 3}


def test_names_are_not_forgotten(spark, tmp_path):
    rows = [("x", "2024-01-01 00:00:00", 0), ("y", "2024-01-01 02:00:00", 1), ("x", "2024-01-03 00:00:00", 2)]
    df = spark.createDataFrame(rows, "display string, ts string, _part int").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(spark, live.first_arrivals(parts(spark, df, tmp_path / "names", 3)), "names_kept")
    assert sorted(r.display for r in out.collect()) == ["x", "y"]


def test_a_broken_table_is_an_error(spark, tmp_path):
    (tmp_path / "out" / "frames").mkdir(parents=True)
    (tmp_path / "out" / "frames" / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        live.AppendSink(str(tmp_path / "out"), "t")(spark.createDataFrame([("a", 1.0, True)], "display string, t double, ok boolean"), 0)


def test_open_tracks_match_batch(spark, tmp_path):
    rows = [(s, f"{s}-{p:02d}", p, float(p), 2.0 + 0.01 * p + s, 1.0, 0.1, p // 5) for s in (1, 2) for p in range(15) if p not in (6, 7)]
    df = spark.createDataFrame(rows, "series long, obs string, position long, axis double, center double, amplitude double, fwhm double, _part int")
    stream = parts(spark, df, tmp_path / "obs", 3)
    got = drain(spark, live.open_tracks(stream), "open_tracks").toPandas()
    want = tracks.link_tracks(df.drop("_part"), ["series"], min_points=1).toPandas()
    a = {frozenset(p["obs"]) for _, p in got.groupby("track")}
    assert a == {frozenset(p["obs"]) for _, p in want.groupby("track")}


def test_text_patterns_and_labels(spark, tmp_path):
    (tmp_path / "one.xy").write_text("##NAME=Gold\n# comment\n1.0 10\n2.0, 20\nbad line\n")
    rows = files.read_xy(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r.filename, r.x, r.y) for r in rows] == [("one.xy", 1.0, 10.0), ("one.xy", 2.0, 20.0)]
    head = files.xy_header(spark, str(tmp_path)).collect()
    assert [(r.key, r.value) for r in head] == [("NAME", "Gold")]
    labels = tmp_path / "labels.csv"
    labels.write_text('filename,phases\na.xy,"Au; Re"\nb.xy,Au\n')
    got = sorted((r.filename, r.phase) for r in files.read_labels(spark, str(labels)).collect())
    assert got == [("a.xy", "Au"), ("a.xy", "Re"), ("b.xy", "Au")]


def test_metadata_csv_and_table_sink(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text("Frame;P_GPa;temp\n0;1.5;\n1;x;300\n2;;\n")
    got = {r.frame: (r.pressure, r.temperature) for r in files.read_metadata_csv(spark, str(path), ";").collect()}
    assert got == {0: (1.5, None), 1: (None, 300.0)}
    files.write_table(spark.createDataFrame([(1, None, "x")], "b int, a double, c string"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["a", "b", "c"]


def test_refinement_json(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"histograms": [{"name": "frame 3", "rwp": 5.1, "converged": true, "phases": {"Au": {"weight_fraction": 0.7}}}]}')
    row = files.read_refinement(spark, str(tmp_path / "r.json")).first()
    assert row.name == "frame 3" and row.phases["Au"].weight_fraction == 0.7 and row.gof is None


@pytest.mark.parametrize("head,kind", [(b"II*\0rest", "tiff"), (b"\x89PNG....", "png"), (b"\x89HDF\r\n", "hdf5"), (b"text", None)])
def test_file_kinds(spark, tmp_path, head, kind):
    (tmp_path / "x.bin").write_bytes(head)
    got = files.scan_files(spark, str(tmp_path), "*.bin;*.tif").select(files.file_kind(F.col("content")).alias("k")).first().k
    assert got == kind
