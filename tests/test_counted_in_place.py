"""Rows that multiply (candidates, displacements) are counted where they arise: no shuffle between the join and the first aggregate."""
import re

from pyspark.sql import functions as F

from voxelflux.operators import fits as Ft, shift as S
from voxelflux.sensor import Sensor


def plan(df):
    """Operators from the result down to the sources, one per line."""
    return df._jdf.queryExecution().executedPlan().toString()


def between(text):
    """Exchanges between the topmost join and the result."""
    return len(re.findall("Exchange hashpartitioning", text[:text.index("SortMergeJoin")]))


def test_velocity_candidates_are_not_shuffled(spark):
    ev = spark.range(40).select((F.col("id") % 3).alias("k"), (F.col("id") % 8).alias("x"), (F.col("id") % 5).alias("y"), F.lit(1).alias("p"), (-F.col("id")).alias("dt"))
    best = spark.range(3).select(F.col("id").alias("k"), F.lit(1.0).alias("vx"), F.lit(0.5).alias("vy"), F.lit(1.0).alias("site"))
    df = Ft.velocity_sharpness(ev, best, ["k"], 1, F.lit(0.25), 0.1)
    assert between(plan(df)) == 0 and "Broadcast" not in plan(df)
    assert df.groupBy("k").count().collect() and df.count() == 27


def test_displacements_are_summed_on_their_tile(make):
    a = make([(10 * i, i % 12, i % 10, i % 2) for i in range(60)])
    df = S.voxel_votes(a.withColumn("block", F.lit(0)), a, ["rec", "w"], 3, (2, 3), Sensor(12, 10))
    assert between(plan(df)) == 1 and "Broadcast" not in plan(df)      # the one shuffle holds sums per displacement
