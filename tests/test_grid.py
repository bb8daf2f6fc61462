from pyspark.sql import functions as F

from cinemill.operators.regular_grid import regular_grid

SCHEMA = "src long, frame long, t double, fps double, v double, step string"


def grid(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    options = dict(key="frame", rate="fps", slice_ms=5000) | more
    return {(r.src, r[1]): (r.status, r.v) for r in regular_grid(df, "src", "t", ["v"], **options).collect()}


def test_hole_interpolation_and_repeats(spark):
    rows = [(1, 0, 500.0, 1.0, 1.0, "x"), (1, 1, 3500.0, 1.0, 4.0, "x"), (1, 1, 3500.0, 1.0, 4.0, "y"), (1, 2, 9000.0, 1.0, 0.0, None)]
    got = grid(spark, rows)
    assert got[1, 0] == ("observed", 1.0) and got[1, 3] == ("observed", 4.0)
    assert got[1, 1] == ("interpolated", 2.0) and got[1, 2] == ("interpolated", 3.0)
    assert [got[1, s][0] for s in range(4, 9)] == ["missing"] * 5 and got[1, 9][0] == "observed"


def test_slower_of_two_rates_and_slices(spark):
    # 8 s apart: at 0.5 a second four periods are 8 s, which is no hole; far slices must still meet.
    rows = [(1, 0, 0.0, 0.5, 1.0, ""), (1, 1, 8000.0, 10.0, 1.0, ""), (1, 2, 100_000.0, 10.0, 1.0, "")]
    got = grid(spark, rows)
    assert all(got[1, s][0] == "interpolated" for s in range(1, 8))
    assert all(got[1, s][0] == "missing" for s in range(9, 100))


def test_nulls_ties_and_empty(spark):
    nan = float("nan")
    rows = [(None, 0, 0.0, 1.0, nan, ""), (None, 1, 2000.0, None, 2.0, ""), (1, 0, None, 1.0, 1.0, ""), (1, 1, nan, 1.0, 1.0, ""), (2, 0, 10.0, 0.0, 1.0, ""), (2, 1, 10.0, 1.0, 3.0, "")]
    got = grid(spark, rows)
    assert got[None, 1] == ("interpolated", None) and got[None, 0] == ("observed", None)
    assert not [k for k in got if k[0] == 1] and got[2, 0] == ("observed", 2.0)
    assert grid(spark, []) == {}


def test_bounds_extend(spark):
    ends = spark.createDataFrame([(1, 0, 3), (2, 0, 1)], "src long, first_step long, last_step long")
    got = grid(spark, [(1, 0, 1500.0, 1.0, 7.0, "")], bounds=ends)
    assert {k: v[0] for k, v in got.items()} == {(1, 0): "edge", (1, 1): "observed", (1, 2): "edge", (1, 3): "edge", (2, 0): "edge", (2, 1): "edge"}


def test_long_hole(spark):
    got = grid(spark, [(1, 0, 0.0, 1.0, 1.0, ""), (1, 1, 10_000_000.0, 1.0, 1.0, "")])
    assert sum(v[0] == "missing" for v in got.values()) == 9999
    assert F is not None
