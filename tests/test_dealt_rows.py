"""Rows that multiply are dealt over as many partitions as they need, not only over the shuffle partitions."""
from pyspark.sql import functions as F

from voxelflux.operators import fits as Ft
from voxelflux.session import dealt


def test_partitions_grow_with_the_rows(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 50)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(df, "k").rdd.getNumPartitions() == few == dealt(df, "k", rows=100, most=1000).rdd.getNumPartitions()
    assert dealt(df, "k", rows=1001, most=100).rdd.getNumPartitions() == 11


def test_velocity_search_names_its_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Ft, "dealt", lambda df, *keys, rows=0: seen.append(rows) or dealt(df, *keys, rows=rows))
    ev = spark.range(12).select((F.col("id") % 2).alias("k"), (F.col("id") % 4).alias("x"), (F.col("id") % 3).alias("y"), (F.col("id") / 12.0).alias("ts"),
                                F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(4).alias("bw"), F.lit(4).alias("bh"))
    assert Ft.variance_velocity(ev, ["k"], vmax=0.2, coarse=0.1, fine=0.05, margin=2).count() == 2
    assert seen == [12 * 25]
