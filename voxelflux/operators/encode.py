"""Delta coding of event sets and of motion maps, and their sizes in bytes.

An event set is coded on a grid as the sorted voxel indices, each as the gap to the one before (repeats have gap 0), with
the number of events in front; every number takes its base-128 length. Sizes come from voxel counts alone. The ordered
windows here run over the occupied voxels of one window, so they are bounded by the grid, not by the event rate.
"""
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cols import idiv, time_bin, uleb_len, unzigzag, zigzag
from ..sensor import Sensor

PARAMS = ("dx", "dy", "ia", "ib", "ic", "id")


def voxel_index(ev: DataFrame, cell, sensor: Sensor, keys) -> DataFrame:
    """(keys, L, c): events per voxel index, time bin first, then polarity, row, column."""
    s, k = cell
    nx, ny = -(-sensor.width // s), -(-sensor.height // s)
    L = ((time_bin("tr", k, sensor.t0) * 2 + F.col("p")) * ny + idiv("y", s)) * nx + idiv("x", s)
    return ev.groupBy(*keys, L.alias("L")).agg(F.count(F.lit(1)).alias("c"))


def with_gaps(idx: DataFrame, keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("L")
    return idx.withColumn("gap", F.col("L") - F.coalesce(F.lag("L").over(w), F.lit(0)))


def set_bits(ev: DataFrame, cell, sensor: Sensor, keys=("rec", "w")) -> DataFrame:
    """(keys, n, bits) of every non-empty event set."""
    g = with_gaps(voxel_index(ev, cell, sensor, keys), keys)
    s = g.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(uleb_len("gap") + F.col("c") - 1).alias("_b"))
    return s.select(*keys, "n", ((F.col("_b") + uleb_len("n")) * 8).cast("bigint").alias("bits"))


def encode(ev: DataFrame, cell, sensor: Sensor, keys=("rec", "w")) -> DataFrame:
    """coded(keys, n, code ARRAY<STRUCT<gap, c>>, n_bytes): one entry per occupied voxel, at most one per grid cell."""
    g = with_gaps(voxel_index(ev, cell, sensor, keys), keys)
    s = g.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(uleb_len("gap") + F.col("c") - 1).alias("_b"),
                             F.array_sort(F.collect_list(F.struct("L", "gap", "c"))).alias("_v"))
    return s.select(*keys, "n", F.transform("_v", lambda v: F.struct(v.gap.alias("gap"), v.c.alias("c"))).alias("code"),
                    (F.col("_b") + uleb_len("n")).cast("bigint").alias("n_bytes"))


def decode(coded: DataFrame, cell, sensor: Sensor, keys=("rec", "w")) -> DataFrame:
    """Events at the origin of their voxel: keys, tr, x, y, p."""
    s, k = cell
    nx, ny = -(-sensor.width // s), -(-sensor.height // s)
    e = coded.select(*keys, F.posexplode("code").alias("_i", "_v"))
    w = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("L", F.sum("_v.gap").over(w))
    r = idiv("L", nx)
    q = idiv(r, ny)
    e = e.select(*keys, (F.col("L") % nx * s).alias("x"), (r % ny * s).alias("y"), (q % 2).alias("p"),
                 idiv(idiv(q, 2) * sensor.t0 + (k - 1), k).alias("tr"),
                 F.explode(F.sequence(F.lit(1), F.col("_v.c").cast("int"))).alias("_c"))
    return e.drop("_c")


def map_deltas(maps: DataFrame, params=PARAMS, keys=("rec", "g")) -> DataFrame:
    """First differences of each map parameter along the targets m of a block (10 rows at most), zigzag coded."""
    w = Window.partitionBy(*keys, "block").orderBy("m")
    return maps.select(*keys, "block", "m", *[zigzag(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c)
                                              for c in params])


def map_bits(maps: DataFrame, params=PARAMS, keys=("rec", "g")) -> DataFrame:
    z = map_deltas(maps, params, keys)
    n = sum((uleb_len(c) for c in params[1:]), uleb_len(params[0]))
    return z.groupBy(*keys).agg((F.sum(n) * 8).cast("bigint").alias("map_bits"))


def decode_maps(deltas: DataFrame, params=PARAMS, keys=("rec", "g")) -> DataFrame:
    w = Window.partitionBy(*keys, "block").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select(*keys, "block", "m", *[F.sum(unzigzag(c)).over(w).alias(c) for c in params])


def tile_sizes(ev: DataFrame, tile_us: int, keys=("rec",), address_bits=22) -> DataFrame:
    """Two plain layouts per payload tile: differential times plus packed addresses, and byte planes.

    Inside a tile the sum of lengths of time differences needs the order of times only, so events are first counted per
    time and the zero differences of ties added as one byte each."""
    t = ev.groupBy(*keys, idiv("t_us", tile_us).alias("tile"), (F.col("t_us") % tile_us).alias("r")).agg(
        F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys, "tile").orderBy("r")
    t = t.withColumn("dt", F.col("r") - F.coalesce(F.lag("r").over(w), F.lit(0)))
    g = t.groupBy(*keys, "tile").agg(F.sum("c").alias("n"), F.sum(uleb_len("dt") + F.col("c") - 1).alias("_b"))
    return g.select(*keys, "tile", "n", (F.col("_b") * 8 + F.col("n") * address_bits).alias("delta_bits"),
                    (F.col("n") * 64 + idiv(F.col("n") + 7, 8) * 8).alias("plane_bits"))
