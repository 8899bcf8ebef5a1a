"""The search of keys that own their truth against the search by joins, over random objects and over keys without pixels or truth."""
import numpy as np
from pyspark.sql import functions as F

from voxelflux.operators import fits as Ft
from voxelflux.operators.encode import PARAMS
from voxelflux.sensor import Sensor

SN = Sensor(16, 8, 1000, 4)


def test_rows_climb_like_joins(spark):
    g = np.random.default_rng(4)
    ev = lambda n, ks: [(int(k), int(g.integers(0, 1000)), int(g.integers(2, 12)), int(g.integers(0, 8)), int(g.integers(0, 2))) for k in ks for _ in range(n)]
    schema = "k long, tr long, x long, y long, p long"
    src, tru = spark.createDataFrame(ev(14, range(12)), schema), spark.createDataFrame(ev(18, range(1, 13)), schema)
    start = spark.range(14).select(F.col("id").alias("k"), F.lit(2).cast("bigint").alias("dx"), *[F.lit(0).cast("bigint").alias(n) for n in PARAMS[1:]],
                                   F.lit(6.5).alias("cx"), F.lit(3.5).alias("cy"), F.lit(5.0).alias("hx"), F.lit(3.5).alias("hy"),
                                   F.lit(0).alias("x0"), F.lit(13).alias("x1"), F.lit(1).alias("y0"), F.lit(7).alias("y1"))
    cols = ["k", *PARAMS, "np", "pairs", "f1"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    for rounds in (1, None):
        a = Ft.coordinate_search(src, tru, start, ["k"], ["k"], SN, rounds=rounds)
        # a second key that says nothing sends the same search through the joins
        b = Ft.coordinate_search(src.withColumn("z", F.lit(0)), tru, start.withColumn("z", F.lit(0)), ["k", "z"], ["k"], SN, rounds=rounds)
        assert rows(a) == rows(b) and len(rows(a)) == 14
    assert "MapInArrow" in Ft.climb_rows(Ft.search_tables(src, tru, ["k"], ["k"], SN), start, ["k"], ["k"], [(0,) * 6])._jdf.queryExecution().toString()
