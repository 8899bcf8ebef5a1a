"""Joins that must not send their rows through the driver: the planner takes multiplied rows for as small as the file they came from."""
from pyspark.sql import functions as F

from voxelflux.operators import scans, stats as St, trains as Tr
from voxelflux.sensor import Sensor


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_and_scans_join_without_broadcast(spark):
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    assert "Broadcast" not in plan(St.exact_quantiles(rows, ["k"], "v", [0.5]))
    assert "Broadcast" not in plan(St.per_recording(rows, ["k"], ("v",)))
    chunked = rows.withColumn("c", F.floor(F.col("v") / 50))
    for df in (scans.ranked(chunked, ["k"], ["v"], "c"), scans.lagged(chunked, ["k"], ["v"], "c", ["v"]),
               scans.running(chunked, ["k"], ["v"], "c", "v", F.sum, "s")):
        assert "Broadcast" not in plan(df)
    want = {k: sorted(range(k, 200, 7)) for k in range(7)}
    got = {r.k: r.q0 for r in St.exact_quantiles(rows, ["k"], "v", [0.5]).collect()}
    assert got == {k: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for k, v in want.items()}


def test_lonely_joins_without_broadcast(make):
    ev = make([(10 * i, i % 12, i % 10, i % 2) for i in range(50)])
    assert "Broadcast" not in plan(Tr.lonely(ev, ("rec",), Sensor(12, 10), 10_000))
