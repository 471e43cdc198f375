"""Plans stay free of cross joins and push work into the scans."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["peaks_in_q"](spark, FOLDER))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "lineitem" in line)
    assert "l_shipdate" not in scan.split("ReadSchema")[1]
    assert "IsNotNull(l_partkey)" in scan


def test_row_statistics_add_no_shuffle(spark):
    for name in ("mad_sigma", "contamination", "frame_values_roi", "normalize_trace", "separate_background", "fit_source_hybrid"):
        assert "Exchange" not in plan(QUERIES[name](spark, FOLDER)), name
