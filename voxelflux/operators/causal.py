"""Causal prediction of a window from the two before it, per block: scores by grid, and timing phase per pixel."""
import math

from pyspark.sql import DataFrame, functions as F

from ..functions.cols import bin_of, block_id, geometric_edges, is_flicker, shift_class, tau_bin, uniform
from ..sensor import Sensor
from ..session import cut_lineage, dealt
from . import shift as S, trains as T
from .voxels import VOXEL, on_cells

GK = ["rec", "g"]
# fixed values: (pixel side, time bins) of the scored grids
GRIDS = tuple((1, k) for k in (1, 3, 6, 12, 32, 64, 128, 256)) + tuple((2, k) for k in (1, 3, 6, 12, 32, 64))
TAU_EDGES = geometric_edges(125.0, 32000.0, 9)


def clean_groups(ev, ks, hot_min=10, factor=20.0, before=3):
    """Events of the span, the key window and the next one, without the hot pixels of the span."""
    eg = S.group_window_events(ev, ks, before, 1)
    hot = T.hot_pixels(eg.filter("rel <= 0"), GK, hot_min, factor)
    return cut_lineage(T.without_hot(eg, hot, GK))          # read by every later step


def candidate_blocks(eg, sensor, n_min):
    return eg.filter("rel = 1").groupBy(*GK, block_id("x", "y", sensor.block, sensor.width).alias("block")).agg(
        F.count(F.lit(1)).alias("n_true")).filter(F.col("n_true") >= n_min)


def in_blocks(ev, blocks, sensor):
    e = ev.withColumn("block", block_id("x", "y", sensor.block, sensor.width))
    return e.join(blocks.select(*GK, "block"), [*GK, "block"], "left_semi")


def fit_motion(eg: DataFrame, cand: DataFrame, sensor: Sensor, radius: int, rule="best", delays=(), fit_k=32, n_min=50,
               src_rel=-1, tgt_rel=0) -> DataFrame:
    """(rec, g, block, dx, dy, delta, pairs, runner_up) of each candidate block, from window `src_rel` onto `tgt_rel`.

    Rule `best`: most pairs, then the best of `delays`. Rule `near_tie`: the shortest of the near-best shifts, blocks
    without enough pairs dropped, then the onset delay."""
    prev, cur = eg.filter(F.col("rel") == src_rel), eg.filter(F.col("rel") == tgt_rel)
    key = [*GK, "block"]
    target = in_blocks(cur, cand, sensor)
    sc = S.votes(prev, target, GK, radius, sensor, prev.count())
    z = F.lit(0).cast("bigint")
    if rule == "best":
        b = S.best_shift(sc, key)
        d = cand.join(b, key, "left").select(*key, F.coalesce("dx", z).alias("dx"), F.coalesce("dy", z).alias("dy"),
                                             F.coalesce("score", z).alias("pairs"))
        d = cut_lineage(d)
        dl = S.best_delay(prev, target, d, GK, delays, fit_k, sensor, prev.count())
        return cut_lineage(d.join(dl, key, "left").withColumn("delta", F.coalesce("delta", z)))
    d = cut_lineage(S.near_tie_shift(sc, key).filter(F.col("pairs") >= n_min / 2))
    mv = S.moved_into(prev, d.select(*key, "dx", "dy"), GK, sensor)
    dl = T.onset_delay(mv, target, key, sensor)
    return cut_lineage(d.join(dl, key, "left").withColumn("delta", F.coalesce("delta", z)))


def predict(eg: DataFrame, motion: DataFrame, sensor: Sensor, n_min: int, seed=20261020):
    """True, predicted and random-time events of the next window in the blocks where both sets reach n_min."""
    key = [*GK, "block"]
    pred = S.moved_into(eg.filter("rel = 0"), motion.select(*key, "dx", "dy", "delta"), GK, sensor)
    n2 = pred.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pred")).filter(F.col("n_pred") >= n_min)
    cols = [*key, "tr", "x", "y", "p", "seq"]
    true = eg.filter("rel = 1").withColumn("block", block_id("x", "y", sensor.block, sensor.width))
    enter = motion.join(n2, key).select(*key, "dx", "dy", "delta", "n_pred")
    pick = lambda e: e.select(*cols).join(enter.select(*key), key, "left_semi")                     # noqa: E731
    pred, true = pick(pred), pick(true)
    null = pred.withColumn("tr", F.floor(uniform(seed, "seq", "block") * sensor.t0))
    return true, pred, null, enter


def score_cube(eg, motion, sensor: Sensor, grids=GRIDS, n_min=50, min_pixels=5, cover=0.8, flicker=None) -> DataFrame:
    """Sums N, N2, M, M0 by scope, flicker, speed class, grid and bin of (bin length / event spacing).

    One pass over the tagged events of the three sets serves all grids; scopes are two aggregations of the same voxels."""
    key = [*GK, "block"]
    true, pred, null, enter = predict(eg, motion, sensor, n_min)
    tag = lambda e, i: e.select(*key, "tr", "x", "y", "p", *[F.lit(int(i == k)).alias(f"_{k}") for k in range(3)])
    rows = tag(true, 0).unionByName(tag(pred, 1)).unionByName(tag(null, 2))
    rows = cut_lineage(rows)
    rows = dealt(rows, *key, rows=rows.count() * len(grids))            # grids multiply where the rows of a block lie
    v = on_cells(rows, grids, sensor).groupBy(*key, "s", "k", *VOXEL).agg(*[F.sum(f"_{k}").alias(f"c{k}") for k in range(3)])
    agg = [F.sum("c0").alias("N"), F.sum("c1").alias("N2"), F.sum(F.least("c0", "c1")).alias("M"), F.sum(F.least("c0", "c2")).alias("M0")]
    span = eg.filter("rel <= 0")
    fl = flicker or is_flicker
    sp = enter.select(*key, shift_class("dx", "dy").alias("speed"))
    dt = F.lit(float(sensor.t0)) / F.col("k")
    # pixel scope
    px = v.filter("s = 1").groupBy(*key, "s", "k", "p", F.col("by").alias("y"), F.col("bx").alias("x")).agg(*agg)
    tau = T.median_spacing(span, GK).select(*GK, "x", "y", "p", "tau")
    px = px.join(tau, [*GK, "x", "y", "p"], "left").join(sp, key)
    px = px.withColumns({"bin": bin_of(F.when(F.col("tau") > 0, dt / F.col("tau"))), "flicker": fl("tau").cast("int"),
                         "scope": F.lit("pixel")})
    # block scope
    bl = v.groupBy(*key, "s", "k").agg(*agg)
    bt = T.block_spacing(span, GK, sensor, min_pixels).filter((F.col("covered") >= cover) & F.col("tau").isNotNull())
    bl = bl.join(bt.select(*key, "tau"), key).join(sp, key)
    bl = bl.withColumns({"bin": bin_of(F.when(F.col("tau") > 0, dt / F.col("tau"))), "flicker": fl("tau").cast("int"),
                         "scope": F.lit("block")})
    out = ["scope", "rec", "flicker", "speed", "s", "k", "bin"]
    sums = ["N", "N2", "M", "M0"]
    both = px.select(*out, *sums).unionByName(bl.select(*out, *sums))
    return both.groupBy(*out).agg(*[F.sum(c).alias(c) for c in sums])


def pixel_phases(true: DataFrame, pred: DataFrame, keys, t0: int, rho=1.2) -> DataFrame:
    """Phase u in [0, 1) of the predicted train of a pixel against its regular true train: (keys, x, y, p, tau, u).

    Phasors are summed per pixel on each side and multiplied; pixels whose predicted phasors cancel are dropped."""
    k = [*keys, "x", "y", "p"]
    tau = T.regular_spacing(true, keys, t0, rho, "tr").select(*k, "tau")
    both = true.select(*k, "tr", F.lit(1).alias("_t")).unionByName(pred.select(*k, "tr", F.lit(0).alias("_t")))
    a = F.lit(2.0 * math.pi) * F.pmod(F.col("tr").cast("double"), F.col("tau")) / F.col("tau")
    z = lambda f, t: F.sum(F.when(F.col("_t") == t, f(a)).otherwise(0.0))                            # noqa: E731
    s = both.join(tau, k).groupBy(*k, "tau").agg(z(F.cos, 1).alias("tc"), z(F.sin, 1).alias("ts"), z(F.cos, 0).alias("qc"),
                                                 z(F.sin, 0).alias("qs"), F.count_if(F.col("_t") == 0).alias("nq"))
    s = s.filter((F.col("nq") > 0) & ((F.abs("qc") > 0) | (F.abs("qs") > 0)))
    re = F.col("qc") * F.col("tc") + F.col("qs") * F.col("ts")
    im = F.col("qs") * F.col("tc") - F.col("qc") * F.col("ts")
    return s.select(*k, "tau", F.pmod(F.atan2(im, re) / (2.0 * math.pi), F.lit(1.0)).alias("u"))


def group_phases(eg, motion, sensor: Sensor, n_min=50, seed=20261022) -> DataFrame:
    """Phases of the prediction and of its random-time null, per block: kind, rec, g, block, dx, dy, tau, u."""
    key = [*GK, "block"]
    true, pred, null, enter = predict(eg, motion, sensor, n_min, seed)
    kinds = F.explode(F.array(F.lit("pred"), F.lit("null"))).alias("kind")
    q = pred.withColumn("kind", F.lit("pred")).unionByName(null.withColumn("kind", F.lit("null")))
    ph = pixel_phases(true.select("*", kinds), q, ["kind", *key], sensor.t0)
    return ph.join(enter.select(*key, "dx", "dy"), key)


def phase_cube(phases: DataFrame, edges=TAU_EDGES, u_bins=20, flicker=None) -> DataFrame:
    fl = flicker or is_flicker
    two = 2.0 * math.pi
    return phases.groupBy(
        "kind", "rec", shift_class("dx", "dy").alias("speed"), ((F.col("dx") == 0) & (F.col("dy") == 0)).cast("int").alias("zero"),
        fl("tau").cast("int").alias("flicker"), tau_bin("tau", edges).alias("tbin"),
        F.least(F.floor(F.col("u") * u_bins), F.lit(u_bins - 1)).alias("ubin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.cos(F.col("u") * two)).alias("sum_cos"), F.sum(F.sin(F.col("u") * two)).alias("sum_sin"))


def block_phases(phases: DataFrame, lo, hi, flicker=None) -> DataFrame:
    """Rayleigh sums n, c, s of moving blocks for tau in [lo, hi) without flicker."""
    fl = flicker or is_flicker
    two = 2.0 * math.pi
    p = phases.filter(((F.col("dx") != 0) | (F.col("dy") != 0)) & (F.col("tau") >= lo) & (F.col("tau") < hi) & ~fl("tau"))
    return p.groupBy("kind", *GK, "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.cos(F.col("u") * two)).alias("c"),
                                               F.sum(F.sin(F.col("u") * two)).alias("s"))
