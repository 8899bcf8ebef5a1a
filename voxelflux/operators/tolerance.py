"""Tolerance ladder: every event on a fine grid, motion plus one time offset per pixel, motion alone."""
from pyspark.sql import DataFrame, functions as F

from ..functions.cols import bin_middle, idiv, time_bin
from ..sensor import Sensor

GK = ["rec", "g"]


def cropped(ev: DataFrame, crops: DataFrame) -> DataFrame:
    """Events inside the half-open crop x0, y0, x1, y1 of their group."""
    return ev.join(crops.select(*GK, "x0", "y0", "x1", "y1"), GK).filter(
        (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))).drop(
        "x0", "y0", "x1", "y1")


def crop_blocks(crops: DataFrame, sensor: Sensor) -> DataFrame:
    """(rec, g, block) of the blocks that meet the crop."""
    rng = lambda a, b: F.sequence(idiv(a, sensor.block), idiv(F.col(b) - 1, sensor.block))            # noqa: E731
    c = crops.withColumn("_bx", F.explode(rng("x0", "x1"))).withColumn("_by", F.explode(rng("y0", "y1")))
    return c.select(*GK, (F.col("_by") * sensor.nbx() + F.col("_bx")).alias("block"))


def every_event(true: DataFrame, sensor: Sensor, k=256) -> DataFrame:
    return true.withColumn("tr", bin_middle(time_bin("tr", k, sensor.t0), k, sensor.t0))


def pixel_offsets(pred: DataFrame, true: DataFrame, sensor: Sensor, keys=GK) -> DataFrame:
    """(keys, x, y, p, sym): offset of the first true from the first predicted event in steps of t0 / 64; NULL = delete."""
    px = [*keys, "x", "y", "p"]
    both = pred.select(*px, F.col("tr").alias("q"), F.lit(None).cast("bigint").alias("t")).unionByName(
        true.select(*px, F.lit(None).cast("bigint").alias("q"), F.col("tr").alias("t")))
    f = both.groupBy(*px).agg(F.min("q").alias("q"), F.min("t").alias("t")).filter("q IS NOT NULL")
    step = sensor.t0 // 64
    return f.select(*px, F.rint((F.col("t") - F.col("q")) / F.lit(float(step))).cast("bigint").alias("_s"), F.col("t").isNull().alias("deleted")).select(*px, F.when(~F.col("deleted"), F.col("_s")).alias("sym"), "deleted")


def apply_offsets(pred: DataFrame, offsets: DataFrame, sensor: Sensor, keys=GK) -> DataFrame:
    px = [*keys, "x", "y", "p"]
    j = pred.join(offsets.filter(~F.col("deleted")), px)
    return j.withColumn("tr", F.col("tr") + F.col("sym") * (sensor.t0 // 64)).drop("sym", "deleted")
