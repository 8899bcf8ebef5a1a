"""Table functions that generate windows, groups, tiles and spans; events meet them by equi-joins on `w`."""
from pyspark.sql import DataFrame, functions as F

from ..functions.cols import idiv


def key_windows(ev: DataFrame, t0: int, first=30, spacing=90, reach=11) -> DataFrame:
    """(rec, w) with (w + reach) t0 <= last time."""
    last = ev.groupBy("rec").agg(F.max("t_us").alias("t_last"))
    stop = idiv("t_last", t0) - reach
    return last.filter(stop >= first).select("rec", F.explode(F.sequence(F.lit(first).cast("bigint"), stop,
                                                                         F.lit(spacing).cast("bigint"))).alias("w"))


def groups(keys: DataFrame, n: int) -> DataFrame:
    """(rec, g, m, w): window w = g + m of the group keyed at g."""
    return keys.select("rec", F.col("w").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("m")).select(
        "rec", "g", F.col("m").cast("bigint").alias("m"), (F.col("g") + F.col("m")).alias("w"))


def spans(keys: DataFrame, before: int) -> DataFrame:
    """(rec, g, w) for the windows max(0, g - before) .. g."""
    return keys.select("rec", F.col("w").alias("g"),
                       F.explode(F.sequence(F.greatest(F.lit(0), F.col("w") - before), F.col("w"))).alias("w"))


def tiles(ev: DataFrame, tile_us: int) -> DataFrame:
    return ev.withColumns({"tile": idiv("t_us", tile_us), "t_tile": F.col("t_us") % tile_us})


def probe_windows(ev: DataFrame, every: int, length: int) -> DataFrame:
    """Windows [j every, j every + length) that lie inside the life of the recording."""
    life = ev.groupBy("rec").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    lo, hi = idiv(F.col("a") + every - 1, every), idiv(F.col("b") - length + 1, every)
    return life.filter(hi >= lo).select("rec", F.explode(F.sequence(lo, hi)).alias("j"))


def probe_events(ev: DataFrame, probes: DataFrame, every: int, length: int) -> DataFrame:
    return ev.filter(F.col("t_us") % every < length).withColumn("j", idiv("t_us", every)).join(probes, ["rec", "j"])
