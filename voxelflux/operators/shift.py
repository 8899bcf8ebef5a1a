"""Per-block motion by displacement votes, and events moved along it.

Instead of scoring candidate displacements one by one, every pair of a source pixel and a target pixel (or voxel) within
the radius votes for the displacement between them. Pixels are counted first, so a hot pixel is one row; pairs meet by an
equi-join on square tiles of the radius; each pair feeds exactly one displacement, and votes combine on the map side.
"""
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cols import block_id, idiv, time_bin
from ..sensor import Sensor
from ..session import dealt
from .windows import spans

PIX = ("x", "y", "p")


def _near(df, side, fx, fy, radius_tiles=1):
    """Rows repeated on the tiles around their own."""
    o = F.sequence(F.lit(-radius_tiles), F.lit(radius_tiles))
    return df.withColumns({"_tx": F.explode(F.transform(o, lambda i: F.floor(F.col(fx) / side) + i))}).withColumn(
        "_ty", F.explode(F.transform(o, lambda i: F.floor(F.col(fy) / side) + i)))


def votes(ref: DataFrame, tru: DataFrame, keys, radius: int, sensor: Sensor, rows=0) -> DataFrame:
    """scores(keys, block, dx, dy, score): pairs of the events of a block of `tru` with `ref` moved by (dx, dy). `rows` is about how many `ref` has: its tiles
    are dealt over as many partitions as the displacements need."""
    keys = list(keys)
    a = ref.groupBy(*keys, *PIX).agg(F.count(F.lit(1)).alias("c1")).withColumnsRenamed({"x": "_rx", "y": "_ry"})
    b = tru.groupBy(*keys, *PIX).agg(F.count(F.lit(1)).alias("c2"))
    side = max(1, radius)
    b = b.withColumns({"_tx": F.floor(F.col("x") / side), "_ty": F.floor(F.col("y") / side)})
    on = [*keys, "p", "_tx", "_ty"]
    j = b.join(dealt(_near(a, side, "_rx", "_ry"), *on, rows=rows * (2 * radius + 1) ** 2).hint("merge"), on)
    j = j.withColumns({"dx": F.col("x") - F.col("_rx"), "dy": F.col("y") - F.col("_ry")}).filter(
        (F.abs("dx") <= radius) & (F.abs("dy") <= radius))
    return j.groupBy(*keys, block_id("x", "y", sensor.block, sensor.width).alias("block"), "dx", "dy").agg(
        F.sum(F.least("c1", "c2")).alias("score"))


def voxel_votes(src: DataFrame, tru: DataFrame, keys, radius: int, cell, sensor: Sensor, by_block=("block",), centre=None,
                per_row_radius=None, bounds=None, rows=0) -> DataFrame:
    """scores(keys, by_block, dx, dy, score) on voxels of several pixels: the moved counts of a voxel are summed per
    displacement before the minimum with the true count is taken. `centre` = (cx, cy) columns of `src` shift the search;
    `per_row_radius` is a column of `src` no larger than `radius`; `bounds` = (x0, x1, y0, y1) columns of `src` hold the
    rectangle that moved pixels must stay in. `rows` is about how many `src` has: its tiles are dealt over as many partitions as the displacements need.

    A voxel of the truth lies on one tile, so its pairs are summed where the tile's rows met; only sums per displacement are shuffled."""
    s, k = cell
    keys, by_block = list(keys), list(by_block)
    extra = [c for c in (*(centre or ()), *((per_row_radius,) if per_row_radius else ()), *(bounds or ()))]
    a = src.groupBy(*keys, *by_block, *extra, "x", "y", "p", time_bin("tr", k, sensor.t0).alias("tb")).agg(
        F.count(F.lit(1)).alias("c1"))
    b = tru.groupBy(*keys, "p", time_bin("tr", k, sensor.t0).alias("tb"), idiv("y", s).alias("by"), idiv("x", s).alias("bx")).agg(
        F.count(F.lit(1)).alias("c2"))
    side = radius + s
    cx, cy = (F.col(c) for c in centre) if centre else (F.lit(0), F.lit(0))
    a = a.withColumns({"_px": F.col("x") + cx, "_py": F.col("y") + cy})
    b = b.withColumns({"_tx": F.floor(F.col("bx") * s / side), "_ty": F.floor(F.col("by") * s / side)})
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(s) for j in range(s)])).alias("_o")
    on = [*keys, "p", "tb", "_tx", "_ty"]
    j = b.join(dealt(_near(a, side, "_px", "_py"), *on, rows=rows * (2 * radius + 1) ** 2, most=1 << 21).hint("merge"), on).select("*", o)
    mx, my = F.col("bx") * s + F.col("_o.i"), F.col("by") * s + F.col("_o.j")
    r = F.col(per_row_radius) if per_row_radius else F.lit(radius)
    j = j.withColumns({"_mx": mx, "_my": my, "dx": mx - F.col("x"), "dy": my - F.col("y")}).filter(
        (F.abs(F.col("_mx") - F.col("_px")) <= r) & (F.abs(F.col("_my") - F.col("_py")) <= r)
        & (F.col("_mx") < sensor.width) & (F.col("_my") < sensor.height))
    if bounds:
        x0, x1, y0, y1 = bounds
        j = j.filter(F.col("_mx").between(F.col(x0), F.col(x1)) & F.col("_my").between(F.col(y0), F.col(y1)))
    v = j.groupBy(*keys, *by_block, "dx", "dy", "p", "tb", "_tx", "_ty", "by", "bx").agg(F.sum("c1").alias("c1"), F.max("c2").alias("c2"))
    return v.groupBy(*keys, *by_block, "dx", "dy").agg(F.sum(F.least("c1", "c2")).alias("score"))


def shortest(dx="dx", dy="dy"):
    return F.abs(F.col(dx)) + F.abs(F.col(dy))


def best_shift(scores: DataFrame, keys) -> DataFrame:
    """Most pairs; ties to the least |dx| + |dy|, then dy, then dx."""
    b = F.max_by(F.struct("dx", "dy", "score"), F.struct(F.col("score"), -shortest(), -F.col("dy"), -F.col("dx")))
    return scores.groupBy(*keys).agg(b.alias("_b")).select(*keys, "_b.dx", "_b.dy", "_b.score")


def near_tie_shift(scores: DataFrame, keys, sigmas=2.0) -> DataFrame:
    """Shortest displacement whose score is within `sigmas` square roots of the best, the best score, and the best score
    farther than one pixel from the choice as a share. Absent displacements score 0, so a best of at most sigmas^2 ties
    with no motion. The array holds one entry per displacement of the search square."""
    arr = F.collect_list(F.struct(shortest().alias("l"), F.col("dy").alias("dy"), F.col("dx").alias("dx"), F.col("score").alias("score")))
    g = scores.groupBy(*keys).agg(F.max("score").alias("pairs"), arr.alias("_a"))
    lim = F.col("pairs") - F.sqrt(F.col("pairs").cast("double")) * sigmas
    pick = F.get(F.array_sort(F.filter("_a", lambda v: v.score >= lim)), F.lit(0))
    g = g.withColumns({"dx": F.when(lim <= 0, F.lit(0).cast("bigint")).otherwise(pick.dx),
                       "dy": F.when(lim <= 0, F.lit(0).cast("bigint")).otherwise(pick.dy)})
    far = F.filter("_a", lambda v: F.greatest(F.abs(v.dx - F.col("dx")), F.abs(v.dy - F.col("dy"))) > 1)
    top = F.aggregate(far, F.lit(0).cast("bigint"), lambda m, v: F.greatest(m, v.score))
    return g.select(*keys, "dx", "dy", "pairs", (top / F.col("pairs")).alias("runner_up"))


def moved_into(ref: DataFrame, shifts: DataFrame, keys, sensor: Sensor) -> DataFrame:
    """Events of `ref` moved by the shift of a block (and its `delta` in time, if present) that land in that block and in
    the window. Each block asks only the source blocks that its shifted square touches."""
    B, nbx, nby = sensor.block, sensor.nbx(), sensor.nby()
    s = shifts.withColumns({"_x0": F.col("block") % nbx * B, "_y0": idiv("block", nbx) * B})

    def source(lo, d, n):
        a = F.floor((F.col(lo) - F.col(d)) / B)
        b = F.floor((F.col(lo) + (B - 1) - F.col(d)) / B)
        return F.filter(F.sequence(a, b), lambda i: (i >= 0) & (i < n))

    s = s.withColumn("_sx", F.explode(source("_x0", "dx", nbx))).withColumn("_sy", F.explode(source("_y0", "dy", nby)))
    e = ref.withColumns({"_sx": idiv("x", B), "_sy": idiv("y", B)})
    j = e.join(s, [*keys, "_sx", "_sy"]).withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    if "delta" in shifts.columns:
        j = j.withColumn("tr", F.col("tr") + F.col("delta"))
    inside = ((F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x0") + B) & (F.col("y") >= F.col("_y0"))
              & (F.col("y") < F.col("_y0") + B) & (F.col("tr") >= 0) & (F.col("tr") < sensor.t0))
    return j.filter(inside).drop("_sx", "_sy", "_x0", "_y0")


def best_delay(prev: DataFrame, cur: DataFrame, shifts: DataFrame, keys, delays, k: int, sensor: Sensor, rows=0) -> DataFrame:
    """Time offset of `delays` that pairs the most events of each block on (1 px, k bins); ties to the least |delta|. `rows` is about how many `prev` has.

    Delays multiply where the events of a pixel lie, and meet its counts there (a map of `k` bins at most): only sums per block and delay are shuffled."""
    keys = list(keys)
    m = moved_into(prev, shifts.select(*keys, "block", "dx", "dy"), keys, sensor)
    m = dealt(m.select(*keys, "block", *PIX, "tr"), *keys, *PIX, rows=rows * len(delays))
    m = m.withColumn("delta", F.explode(F.array(*[F.lit(int(v)).cast("bigint") for v in delays])))
    m = m.withColumn("tr", F.col("tr") + F.col("delta")).filter((F.col("tr") >= 0) & (F.col("tr") < sensor.t0))
    a = m.groupBy(*keys, "block", "delta", *PIX, time_bin("tr", k, sensor.t0).alias("tb")).agg(F.count(F.lit(1)).alias("c1"))
    b = cur.groupBy(*keys, *PIX, time_bin("tr", k, sensor.t0).alias("tb")).agg(F.count(F.lit(1)).alias("c2"))
    b = b.groupBy(*keys, *PIX).agg(F.map_from_entries(F.collect_list(F.struct("tb", "c2"))).alias("_b"))
    s = a.join(b.hint("merge"), [*keys, *PIX]).withColumn("c2", F.try_element_at("_b", F.col("tb"))).filter("c2 IS NOT NULL").groupBy(*keys, "block", "delta").agg(F.sum(F.least("c1", "c2")).alias("n"))
    return s.groupBy(*keys, "block").agg(F.max_by("delta", F.struct(F.col("n"), -F.abs("delta"), -F.col("delta"))).alias("delta"))


def neighbourhood(ev: DataFrame, blocks: DataFrame, keys, reach: int, sensor: Sensor) -> DataFrame:
    """Events of each listed block and of the blocks within `reach` of it."""
    nbx, nby = sensor.nbx(), sensor.nby()
    o = F.sequence(F.lit(-reach), F.lit(reach))
    b = blocks.withColumn("_sx", F.explode(F.transform(o, lambda i: F.col("block") % nbx + i))).withColumn(
        "_sy", F.explode(F.transform(o, lambda i: idiv("block", nbx) + i)))
    b = b.filter((F.col("_sx") >= 0) & (F.col("_sx") < nbx) & (F.col("_sy") >= 0) & (F.col("_sy") < nby))
    e = ev.withColumns({"_sx": idiv("x", sensor.block), "_sy": idiv("y", sensor.block)})
    return e.join(b, [*keys, "_sx", "_sy"]).drop("_sx", "_sy")


def claims(moved: DataFrame, true: DataFrame, order: DataFrame, keys, cell, sensor: Sensor) -> DataFrame:
    """Pairs of each block when blocks take true events in `order` (keys.., block, rk): per voxel, block j gets
    min(S_j, true) - min(S_{j-1}, true) with S the running moved count. The window runs over the blocks of one voxel."""
    s, k = cell
    keys = list(keys)
    vox = [*keys, "p", "tb", "by", "bx"]
    cols = {"tb": time_bin("tr", k, sensor.t0), "by": idiv("y", s), "bx": idiv("x", s)}
    a = moved.withColumns(cols).groupBy(*vox, "block").agg(F.count(F.lit(1)).alias("c"))
    b = true.withColumns(cols).groupBy(*vox).agg(F.count(F.lit(1)).alias("ct"))
    j = a.join(b, vox, "left").join(order, [c for c in order.columns if c != "rk"])
    w = Window.partitionBy(*vox).orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    S, ct = F.sum("c").over(w), F.coalesce("ct", F.lit(0))
    j = j.withColumn("_S", S).withColumn("got", F.least("_S", ct) - F.least(F.col("_S") - F.col("c"), ct))
    return j.groupBy(*keys, "block").agg(F.sum("c").alias("n_in"), F.sum("got").alias("got"))


def group_window_events(ev: DataFrame, ks: DataFrame, before: int, after: int) -> DataFrame:
    """Events of the windows g - before .. g + after of each key window: rec, g, rel, and the event columns."""
    a = spans(ks, before).withColumn("rel", F.col("w") - F.col("g"))
    if after:
        f = ks.select("rec", F.col("w").alias("g"), F.explode(F.sequence(F.lit(1), F.lit(after))).alias("rel"))
        a = a.unionByName(f.select("rec", "g", (F.col("g") + F.col("rel")).alias("w"), F.col("rel").cast("bigint").alias("rel")))
    return ev.join(a, ["rec", "w"])
