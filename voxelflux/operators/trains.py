"""Per-pixel event trains: spacing, regular intervals, onset, hot pixels, isolation, background, caps, orders.

Windows over (keys, x, y, p) are bounded: `keys` always holds a window or a span of a few windows, and a pixel cannot
emit more than one event per tick. Anything ordered over a whole recording goes through operators.scans.
"""
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cols import active_threshold, block_id, col, idiv
from ..sensor import Sensor
from .scans import ranked

PIXEL = ("x", "y", "p")


def intervals(ev: DataFrame, keys, t="t_us") -> DataFrame:
    w = Window.partitionBy(*keys, *PIXEL).orderBy(t, "seq")
    return ev.withColumn("d", F.col(t) - F.lag(t).over(w))


def median_spacing(ev: DataFrame, keys, t="t_us") -> DataFrame:
    """Median interval per pixel and polarity; NULL with fewer than two events."""
    return intervals(ev, keys, t).groupBy(*keys, *PIXEL).agg(F.median("d").alias("tau"), F.count(F.lit(1)).alias("n"))


def regular_flags(ev: DataFrame, keys, t0: int, rho=1.2, t="t_us") -> DataFrame:
    """Intervals `d` with `regular`: the interval and a neighbour of one train differ by at most rho and fit in t0."""
    w = Window.partitionBy(*keys, *PIXEL).orderBy(t, "seq")
    df = intervals(ev, keys, t)
    df = df.withColumns({"_n": F.lead("d").over(w), "_p": F.lag("d").over(w)})

    def pair(a, b):
        lo, hi = F.least(a, b), F.greatest(a, b)
        return F.coalesce(a.isNotNull() & b.isNotNull() & (lo > 0) & (hi <= lo * rho) & (a + b <= t0), F.lit(False))

    d = F.col("d")
    return df.withColumn("regular", pair(d, F.col("_n")) | pair(F.col("_p"), d)).drop("_n", "_p")


def regular_spacing(ev: DataFrame, keys, t0: int, rho=1.2, t="t_us") -> DataFrame:
    return regular_flags(ev, keys, t0, rho, t).filter("regular").groupBy(*keys, *PIXEL).agg(
        F.median("d").alias("tau"), F.count(F.lit(1)).alias("n_regular"))


def onset_delay(moved: DataFrame, true: DataFrame, keys, sensor: Sensor) -> DataFrame:
    """Median over pixels and polarities of first true - first moved, both at least t0 / 16 into the window.

    Both sides carry keys, x, y, p and `tr`. Rows exist only for keys with a common pixel; the delay of others is 0."""
    guard, half = sensor.t0 // 16, sensor.t0 // 2
    cols = [*keys, *PIXEL, "tr"]
    a = moved.filter(F.col("tr") >= guard).select(*cols, F.lit(True).alias("_m"))
    b = true.filter(F.col("tr") >= guard).select(*cols, F.lit(False).alias("_m"))
    px = a.unionByName(b).groupBy(*keys, *PIXEL).agg(F.min(F.when(F.col("_m"), F.col("tr"))).alias("fm"),
                                                     F.min(F.when(~F.col("_m"), F.col("tr"))).alias("ft"))
    px = px.filter("fm IS NOT NULL AND ft IS NOT NULL")
    return px.groupBy(*keys).agg(F.greatest(F.lit(-half), F.least(
        F.lit(half), F.rint(F.median(F.col("ft") - F.col("fm"))).cast("bigint"))).cast("bigint").alias("delta"))


def hot_pixels(span: DataFrame, keys, hot_min=10, factor=20.0) -> DataFrame:
    """Pixels whose count reaches max(hot_min, factor * median count of the pixels with events)."""
    px = span.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    med = px.groupBy(*keys).agg(F.median("c").alias("_med"))
    return px.join(med, list(keys)).filter(F.col("c") >= F.greatest(F.lit(float(hot_min)), F.col("_med") * factor)).select(
        *keys, "x", "y", "c")


def without_hot(ev: DataFrame, hot: DataFrame, keys) -> DataFrame:
    return ev.join(hot.select(*keys, "x", "y"), [*keys, "x", "y"], "left_anti")


def block_spacing(span: DataFrame, keys, sensor: Sensor, min_pixels=5) -> DataFrame:
    """Per block: median of the per-pixel medians (NULL below `min_pixels`), their number, the covered share."""
    px = median_spacing(span, keys).withColumn("block", block_id("x", "y", sensor.block, sensor.width))
    g = px.groupBy(*keys, "block").agg(F.count("tau").alias("n_pix"), F.count(F.lit(1)).alias("_all"),
                                       F.median("tau").alias("_tau"))
    return g.select(*keys, "block", F.when(F.col("n_pix") >= min_pixels, F.col("_tau")).alias("tau"), "n_pix",
                    (F.col("n_pix") / F.col("_all")).alias("covered"))


def both_polarities(ev: DataFrame, keys, sensor: Sensor) -> DataFrame:
    px = ev.groupBy(*keys, "x", "y").agg((F.min("p") != F.max("p")).alias("both"))
    return px.groupBy(*keys, block_id("x", "y", sensor.block, sensor.width).alias("block")).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.avg(F.col("both").cast("double")).alias("both_share"))


def lonely(ev: DataFrame, keys, sensor: Sensor, tau: int) -> DataFrame:
    """Events with no event of their polarity in the eight neighbour pixels within tau (both bounds closed).

    Events are first reduced to the earliest and latest time of each (pixel, polarity, bucket of tau): inside the own
    bucket any event is near, of the bucket before only the latest counts, of the one after only the earliest. The join
    is then one to one, whatever the density. It is a merge: the planner takes `near`, up to 24 rows a cell, for as small as the file of the events, and
    would send it through the driver."""
    cell = ev.withColumn("_b", idiv("t_us", tau)).groupBy(*keys, *PIXEL, "_b").agg(F.min("t_us").alias("lo"),
                                                                                     F.max("t_us").alias("hi"))
    offs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
                               for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) for k in (-1, 0, 1)]))
    near = cell.withColumn("_o", offs).select(
        *keys, "p", (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y"),
        (F.col("_b") + F.col("_o.k")).alias("_b"), F.col("_o.k").alias("k"), "lo", "hi")
    near = near.filter((F.col("x") >= 0) & (F.col("x") < sensor.width) & (F.col("y") >= 0) & (F.col("y") < sensor.height))
    near = near.groupBy(*keys, *PIXEL, "_b").agg(F.max(F.when(F.col("k") == 1, F.col("hi"))).alias("before"),
                                                 F.bool_or(F.col("k") == 0).alias("same"),
                                                 F.min(F.when(F.col("k") == -1, F.col("lo"))).alias("after"))
    e = ev.withColumn("_b", idiv("t_us", tau)).join(near.hint("merge"), [*keys, *PIXEL, "_b"], "left")
    has = (F.coalesce("same", F.lit(False)) | F.coalesce(F.col("before") >= F.col("t_us") - tau, F.lit(False))
           | F.coalesce(F.col("after") <= F.col("t_us") + tau, F.lit(False)))
    return e.filter(~has).drop("_b", "before", "same", "after")


def poisson_upper(phi, alpha=1e-3):
    """Smallest k with P(X > k) <= alpha for X ~ Poisson(phi).

    Weights relative to the least k that matters (12 deviations and 30 below phi) grow by phi / k, so none of them can vanish or overflow whatever
    phi is; dividing by their sum gives probabilities."""
    phi = F.col(phi) if isinstance(phi, str) else phi
    reach = F.sqrt(phi) * 12 + 30
    first = F.greatest(F.floor(phi - reach), F.lit(0)).cast("int")
    ks = F.sequence(first, F.ceil(phi + reach).cast("int"))
    weight = lambda a, k: F.when(k == first, F.lit(1.0)).otherwise(a.w * phi / k)               # noqa: E731
    total = F.aggregate(ks, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum")),
                        lambda a, k: F.struct(weight(a, k).alias("w"), (a.sum + weight(a, k)).alias("sum")), lambda a: a.sum)

    def step(a, k):
        left = a.left - weight(a, k)
        return F.struct(weight(a, k).alias("w"), left.alias("left"), F.when((a.k < 0) & (left <= a.all * alpha), k).otherwise(a.k).alias("k"), a.all.alias("all"))

    zero = F.transform(F.array(total), lambda t: F.struct(F.lit(0.0).alias("w"), t.alias("left"), F.lit(-1).alias("k"), t.alias("all")))[0]
    return F.aggregate(ks, zero, step, lambda a: a.k.cast("double"))


def background(ev: DataFrame, keys, bounds: DataFrame, sensor: Sensor, tau: int, hot_min=10, factor=20.0, alpha=1e-3,
               tick=1e-6) -> DataFrame:
    """Background rate beta per pixel and second, block level phi and threshold theta, for events of `keys` in [lo, hi).

    The isolated rate r solves beta exp(-8 tau beta) = r; the root is found by fixed Newton steps on
    ln beta - 8 tau beta - ln r, which approach it from one side on either branch."""
    B, n_px = sensor.block, sensor.width * sensor.height
    ev = ev.join(bounds, list(keys)).filter("t_us >= lo AND t_us < hi")
    hot = hot_pixels(ev, keys, hot_min, factor)
    ev = without_hot(ev, hot, keys)
    iso = lonely(ev, keys, sensor, tau).filter((F.col("t_us") >= F.col("lo") + tau) & (F.col("t_us") < F.col("hi") - tau))
    n_iso = iso.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_iso"))
    n_hot = hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hot"))
    blocks = ev.groupBy(*keys, block_id("x", "y", B, sensor.width).alias("block")).agg(F.count(F.lit(1)).alias("c"))
    every = bounds.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sensor.nbx() * sensor.nby() - 1)
                                                      .cast("bigint"))).alias("block"))
    med = every.join(blocks, [*keys, "block"], "left").groupBy(*keys).agg(
        F.median(F.coalesce("c", F.lit(0))).alias("bmed"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    g = bounds.join(med, list(keys)).join(n_iso, list(keys), "left").join(n_hot, list(keys), "left").na.fill(0)
    ts = tau * tick
    span = (F.col("hi") - F.col("lo")) * F.lit(tick)
    inner = F.greatest(span - 2 * ts, F.lit(0.0))
    g = g.withColumn("r", F.when((inner > 0) & (F.lit(n_px) > F.col("n_hot")),
                                 F.col("n_iso") / ((F.lit(n_px) - F.col("n_hot")) * inner)).otherwise(0.0))
    g = g.withColumn("beta_med", F.when(span > 0, F.col("bmed") / (span * float(B * B))).otherwise(0.0))
    cap = 1.0 / (8.0 * ts)
    g = g.withColumn("saturated", F.col("r") >= cap / 2.718281828459045)
    g = g.withColumn("branch", F.when(F.col("beta_med") > cap, -1).otherwise(0))
    r = F.col("r")
    start = F.when(F.col("branch") == -1, (F.lit(1.0) - F.ln(r / cap)) * (4.0 * cap)).otherwise(r)
    root = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start,
                       lambda b, i: b - (F.ln(b) - b / cap - F.ln(r)) / (1.0 / b - 1.0 / cap))
    g = g.withColumn("beta_iso", F.when(F.col("saturated"), F.lit(cap)).when(r > 0, root).otherwise(0.0))
    g = g.withColumn("beta", F.least("beta_iso", "beta_med"))
    g = g.withColumn("phi", F.greatest(F.lit(1.0), F.col("beta") * (B * B * sensor.t0 * tick)))
    return g.withColumn("near_saturation", r >= 0.9 * cap / 2.718281828459045).withColumn(
        "theta", poisson_upper("phi", alpha))


def surface(ev: DataFrame, keys, sensor=None) -> DataFrame:
    """Latest event time per pixel and polarity."""
    return ev.groupBy(*keys, *PIXEL).agg(F.max("t_us").alias("t_last"))


def cap_per_block(ev: DataFrame, n, sensor: Sensor, keys=("rec", "w"), slices=16) -> DataFrame:
    """At most n events per block at evenly spaced ranks ((2 j + 1) N) div (2 n) of the time order."""
    n = col(n)
    df = ev.withColumn("block", block_id("x", "y", sensor.block, sensor.width)).withColumn(
        "_chunk", idiv("tr", max(1, sensor.t0 // slices)))
    df = ranked(df, [*keys, "block"], ["t_us", "seq"], "_chunk", "rk", "_tot")
    N, r = F.col("_tot"), F.col("rk")
    j = idiv(n * 2 * r + N - 1, N * 2)
    return df.filter((N <= n) | ((j < n) & (idiv((j * 2 + 1) * N, n * 2) == r))).drop("_chunk", "_tot", "rk")


def every_kth(df: DataFrame, keys, order, chunk, most: int) -> DataFrame:
    """Rows 0, k, 2k, .. of each key with k = ceil(n / most): at most `most` rows of evenly spaced rank."""
    df = ranked(df, keys, order, chunk, "rk", "_tot")
    return df.filter(F.col("rk") % F.ceil(F.col("_tot") / most) == 0).drop("_tot")
