"""Per-block regions of a group: what moved, how fast, how the box areas and the claimed pairs fall on them."""
from pyspark.sql import DataFrame, functions as F

from ..functions.cols import block_id
from ..sensor import Sensor
from . import boxes as B, shift as S, trains as T
from .codec import reconstruct

GB = ["rec", "g", "block"]


def block_facts(key: DataFrame, span: DataFrame, maps: DataFrame, boxes: DataFrame, sensor: Sensor, margin=10.0, static_px=1,
                min_pixels=5) -> DataFrame:
    """One row per active block: counts, static flag, speed, polarity share, event spacing and whether a box touches it."""
    n = key.groupBy(*GB).agg(F.count(F.lit(1)).alias("n_key"))
    d = F.greatest(F.abs("dx"), F.abs("dy"))
    shape = sum((F.abs(F.col(c)) for c in ("ib", "ic", "id")), F.abs(F.col("ia")))
    mp = maps.filter("m <= 3").groupBy(*GB).agg(((F.max(d) <= static_px) & (F.max(shape) == 0)).alias("static"),
                                                 (F.max(F.when(F.col("m") == 3, F.hypot("dx", "dy"))) / 3.0).alias("speed"))
    pol = T.both_polarities(key, ("rec", "g"), sensor)
    sp = T.block_spacing(span, ("rec", "g"), sensor, min_pixels)
    px = B.box_pixels(boxes, sensor, margin).withColumnRenamed("w", "g")
    touch = px.select("rec", "g", block_id("x", "y", sensor.block, sensor.width).alias("block")).distinct().withColumn("touch", F.lit(True))
    out = n.join(mp, GB, "left").join(pol, GB, "left").join(sp, GB, "left").join(touch, GB, "left")
    return out.select(*GB, "n_key", "static", "speed", F.col("both_share").alias("both_polarity"), "tau", "n_pix", "covered",
                      F.coalesce("touch", F.lit(False)).alias("touch"))


def block_claims(key: DataFrame, true: DataFrame, maps: DataFrame, sensor: Sensor, cells) -> DataFrame:
    """Claimed pairs and moved events per block, target and grid; blocks claim by falling key count."""
    from pyspark.sql import Window
    mv = reconstruct(key, maps, sensor).select(*GB, "m", "tr", "x", "y", "p")
    n = key.groupBy(*GB).agg(F.count(F.lit(1)).alias("n"))
    order = n.withColumn("rk", F.row_number().over(Window.partitionBy("rec", "g").orderBy(F.desc("n"), "block"))).drop("n")
    out = None
    for s, k in cells:
        c = S.claims(mv, true, order, ["rec", "g", "m"], (s, k), sensor).withColumns(
            {"s": F.lit(s).cast("bigint"), "k": F.lit(k).cast("bigint")})
        out = c if out is None else out.unionByName(c)
    return out
