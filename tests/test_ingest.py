"""Patterns on axes of their own and calculated reflection lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggline.operators import ingest
from braggline.sources import files
from braggline.sources.reflections import read_reflections, reflection_files


def plain(patterns, min_points=16):
    """Union range, median step, linear interpolation inside each range."""
    kept = {k: (np.sort(np.asarray(x)), np.asarray(y)[np.argsort(x)]) for k, (x, y) in patterns.items() if len(x) >= min_points}
    start, stop = min(x[0] for x, _ in kept.values()), max(x[-1] for x, _ in kept.values())
    step = float(np.median([np.median(np.diff(x)) for x, _ in kept.values()]))
    axis = start + step * np.arange(int((stop - start) / step) + 2)
    out = {}
    for k, (x, y) in kept.items():
        inside = (axis >= x[0] - 1e-9 * step) & (axis <= x[-1] + 1e-9 * step)
        out.update({(k, int(i)): float(np.interp(axis[i], x, y)) for i in np.nonzero(inside)[0]})
    return (start, stop, step), out


@pytest.fixture(scope="module")
def measured():
    rng = np.random.default_rng(3)
    made = {f"p{i}": (np.cumsum(rng.uniform(0.01, 0.05, 40)) + i * 0.3, rng.uniform(0, 100, 40)) for i in range(7)}
    made["regular"] = (0.5 + 0.03 * np.arange(30), np.arange(30.0))
    made["short"] = (np.arange(15.0), np.zeros(15))
    return {k: (list(map(float, x)), list(map(float, y))) for k, (x, y) in made.items()}


def rows(patterns):
    return [(k, x, y) for k, (xs, ys) in patterns.items() for x, y in zip(xs, ys)]


def test_patterns_meet_on_one_axis(spark, measured):
    shuffled = sorted(rows(measured), key=lambda r: hash((r[1], r[0])))
    odd = [("p0", None, 1.0), ("p0", float("nan"), 2.0), ("p1", 1.0, None), ("p1", float("inf"), 1.0), ("none", None, None)]
    df = spark.createDataFrame(shuffled + odd, "filename string, x double, y double").withColumn("bin", F.lit("clash"))
    (start, stop, step), want = plain(measured)
    row = ingest.common_axis(ingest.knots(df, "filename")).first()
    assert (row.start, row.stop) == (start, stop) and row.step == pytest.approx(step)
    got = {(r.filename, r.bin): r for r in ingest.on_common_axis(df).collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        assert r.y == pytest.approx(want[key], abs=1e-6) and r.radial == pytest.approx(start + step * key[1])


def test_dense_and_sparse_patterns(spark):
    # One pattern has many knots between two grid points, the other many grid points between two knots.
    made = {"dense": (list(np.linspace(0, 1, 901)), list(np.linspace(5, 6, 901))), "sparse": (list(np.linspace(0.2, 9.2, 16)), list(np.linspace(0, 15, 16))),
            "middle": (list(np.linspace(0, 5, 101)), [1.0] * 101)}
    made = {k: (list(map(float, x)), list(map(float, y))) for k, (x, y) in made.items()}
    _, want = plain(made)
    got = {(r.filename, r.bin): r.y for r in ingest.on_common_axis(spark.createDataFrame(rows(made), "filename string, x double, y double")).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_repeated_positions_are_averaged(spark):
    made = rows({"a": ([0.1 * i for i in range(20)], [1.0] * 20)}) + [("a", 0.5, 3.0)]
    got = ingest.on_common_axis(spark.createDataFrame(made, "filename string, x double, y double")).where("bin = 5").first()
    assert got.y == pytest.approx(2.0)


def test_empty_and_short_tables(spark):
    empty = spark.createDataFrame([], "filename string, x double, y double")
    assert ingest.on_common_axis(empty).count() == 0
    assert ingest.on_common_axis(spark.createDataFrame([("a", 1.0, 2.0)] * 40, empty.schema)).count() == 0


def test_folder_to_pattern_rows(spark, tmp_path, measured):
    for name, (xs, ys) in measured.items():
        lines = ["# wavelength = 0.4", *[f"{x!r}, {y!r}" for x, y in zip(xs, ys)], "end of file"]
        (tmp_path / f"{name}.xy").write_text("\n".join(lines))
    long = ingest.ingest_folder(spark, str(tmp_path))
    _, want = plain({f"{k}.xy": v for k, v in measured.items()})
    assert long.count() == len(want)
    packed = {r.filename: r.clean for r in ingest.pack(long, 200).collect()}
    assert set(packed) == {k for k, _ in want}
    for name, row in packed.items():
        assert [i for i, v in enumerate(row) if v is not None] == sorted(b for k, b in want if k == name)
    assert files.xy_header(spark, str(tmp_path)).count() == len(measured)


LISTS = {
    "pair": "# calculated\n2.5 100\n1.9 40\n\n1.2 7\n",
    "export": "h k l d (A) F I M\n1 1 1 2.31 5.0 100.0 8\n2 0 0 2.00 3.0 47.5 6\n",
    "named": "I d(A) note\n10 3.1 0\n90 2.2 1\n",
    "bare": "1 1 1 2.31 9 55.5 100 8\n2 0 0 2.0 8 44.4 30 6\n0 2 2 1.5\nnot a row\n",
    "unscaled": "1 0 0 3.0 12 4\n1 1 0 2.1 8 2\n",
    "short": "1 0 0 3.0\n-1 1 0 2.1\n",
    "fractions": "1.5 2.5 3.5 4.5\n1 2 3 4\n",
    "words": "nothing here\nat all\n",
    "empty": "",
    "windows": "d I\r\n2.5 100\r\n1.25 50\r\n",
}
WANT = {
    "pair": [(2.5, 100, None), (1.9, 40, None), (1.2, 7, None)],
    "export": [(2.31, 100, (1, 1, 1)), (2.0, 47.5, (2, 0, 0))],
    "named": [(3.1, 10, None), (2.2, 90, None)],
    "bare": [(2.31, 100, (1, 1, 1)), (2.0, 30, (2, 0, 0))],
    "unscaled": [(3.0, 12, (1, 0, 0)), (2.1, 8, (1, 1, 0))],
    "short": [(3.0, None, (1, 0, 0)), (2.1, None, (-1, 1, 0))],
    "windows": [(2.5, 100, None), (1.25, 50, None)],
}


def test_reflection_lists(spark, tmp_path):
    for name, text in LISTS.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    got = {}
    for r in read_reflections(spark, str(tmp_path)).orderBy("phase", "ord").collect():
        got.setdefault(r.phase, []).append((r.d, r.w, None if r.h is None else (r.h, r.k, r.l)))
    assert got == WANT
    problems = {r.phase: r.problem for r in reflection_files(spark, str(tmp_path)).where("problem is not null").collect()}
    assert {k: v for k, v in problems.items() if k != "empty"} == {"fractions": "no d column", "words": "no rows of numbers"}
