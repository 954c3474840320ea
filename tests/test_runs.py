"""Sliced runs give what one window per key gives, whatever the slice size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revtide.plans import runs
from revtide.plans.runs import running, slice_cuts, slice_of


@pytest.fixture(scope="module")
def line(spark):
    rng = random.Random(7)
    # Key 0 holds more than a third of all rows, with many equal positions and one dense burst.
    rows = [(0, rng.choice([rng.randrange(400), 200 + rng.randrange(5)]), i, rng.choice([None, rng.randrange(50)])) for i in range(600)]
    rows += [(1 + i % 9, rng.randrange(1000), 1000 + i, rng.randrange(50)) for i in range(700)]
    return spark.createDataFrame(rows, "k int, at long, id long, v int").cache()


def _outputs(line, rows_per_slice):
    df = running(
        line,
        ["k"],
        ["at", "id"],
        prior={"p": F.col("v")},
        following={"f": F.struct("v")},
        total={"t": F.coalesce("v", F.lit(0))},
        peak={"m": F.struct("v", "id")},
        rows_per_slice=rows_per_slice,
    )
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("rows_per_slice", [1, 3, 40, 100_000])
def test_slices_change_nothing(line, rows_per_slice):
    assert _outputs(line, rows_per_slice) == _outputs(line, None)


def test_against_plain_windows(line):
    w = Window.partitionBy("k").orderBy("at", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = line.select(
        "k", "id",
        F.last("v", True).over(before).alias("p"),
        F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"),
    )
    sliced = running(
        line, ["k"], ["at", "id"], prior={"p": F.col("v")}, total={"t": F.coalesce("v", F.lit(0))}, rows_per_slice=5
    ).select("k", "id", "p", "t")
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, sliced.collect()), key=str)


def _slices(rows, rows_per_slice):
    joined = runs._join(rows, slice_cuts(rows, ["k"], "at", rows_per_slice), ["k"], "left", False)
    return joined.groupBy("k", slice_of("at").alias("s")).count().collect()


def test_only_large_keys_are_sliced(line):
    assert [r.k for r in slice_cuts(line, ["k"], "at", 100).collect()] == [0]


@pytest.mark.parametrize(
    "place",
    [
        lambda i: F.col("id"),  # even
        lambda i: F.when(i == 0, -(10**15)).otherwise(i),  # one early row
        lambda i: F.when(i % 10 == 0, i * 10**9).otherwise(5 * 10**12 + i),  # a burst
        lambda i: F.exp(i / 10000.0).cast("long") * 10**6 + i,  # ever denser
    ],
)
@pytest.mark.parametrize("key", [1, None])
def test_slices_hold_about_the_same_number_of_rows(spark, place, key):
    rows = spark.range(200_000).select(F.lit(key).cast("int").alias("k"), place(F.col("id")).alias("at"))
    found = _slices(rows, 5000)
    assert len(found) >= 30 and max(r["count"] for r in found) < 2 * 5000


def test_rows_without_a_key_run_as_one_key(spark, line):
    rows = line.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    assert _outputs(rows, 7) == _outputs(rows, None)


def test_many_cuts_are_joined_without_a_broadcast(spark, line, monkeypatch):
    monkeypatch.setattr(runs, "MAX_BROADCAST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = running(line, ["k"], ["at", "id"], total={"t": F.coalesce("v", F.lit(0))}, rows_per_slice=5)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        plain = running(line, ["k"], ["at", "id"], total={"t": F.coalesce("v", F.lit(0))}, rows_per_slice=None)
        assert sorted(map(str, df.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_outside_the_measured_span(spark, line):
    inner = line.filter((F.col("k") == 0) & F.col("at").between(100, 300))
    whole = line.filter("k = 0")
    sliced = running(whole, ["k"], ["at", "id"], total={"t": F.lit(1)}, sizes=inner, rows_per_slice=10)
    plain = running(whole, ["k"], ["at", "id"], total={"t": F.lit(1)}, rows_per_slice=None)
    assert sorted(map(tuple, sliced.select("id", "t").collect())) == sorted(map(tuple, plain.select("id", "t").collect()))
