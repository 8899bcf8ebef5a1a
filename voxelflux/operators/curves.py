"""Curves of few points per key (a ladder of schemes): envelopes, interpolation, crossings.

A curve is one sorted array column, so that a hull or a lookup is a row expression and a curve is built by one aggregation.
"""
from pyspark.sql import DataFrame, Window, functions as F


def curve(x="share", y="bits", when=None):
    """Aggregate: the points (x, y) as a sorted array, with the cheapest point per x first."""
    pt = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return F.array_sort(F.collect_list(F.when(when, pt) if when is not None else pt))


def with_origin(points):
    """Origin added, one point per x (the cheapest)."""
    zero = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    p = F.array_sort(F.concat(zero, points))
    return F.filter(p, lambda v, i: (i == 0) | (F.get(p, i - 1).x != v.x))


def hull(points):
    """Points of the lower convex envelope: those with no chord of two other points on or below them."""
    def spanned(z):
        return F.exists(points, lambda a: (a.x < z.x) & F.exists(points, lambda b: (b.x > z.x) & (
            (z.x - a.x) * (b.y - a.y) <= (z.y - a.y) * (b.x - a.x))))
    return F.filter(points, lambda z: ~spanned(z))


def lookup(points, at, clamp=True):
    """Linear interpolation at `at`; beyond the ends the end value, or NULL with clamp off."""
    at = F.col(at) if isinstance(at, str) else at
    below, above = F.filter(points, lambda v: v.x <= at), F.filter(points, lambda v: v.x >= at)
    lo, hi = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    v = F.when(hi.x == lo.x, lo.y).otherwise(lo.y + (hi.y - lo.y) * (at - lo.x) / (hi.x - lo.x))
    return F.when(lo.isNull(), hi.y).when(hi.isNull(), lo.y).otherwise(v) if clamp else v


def first_crossing(ladder: DataFrame, keys, target, order="step", f="f", b="b") -> DataFrame:
    """b where the ladder first brackets `target` between consecutive steps, linear in f; no row if none does."""
    w = Window.partitionBy(*keys).orderBy(order)
    l = ladder.withColumns({"_f1": F.lead(f).over(w), "_b1": F.lead(b).over(w)})
    t = F.col(target) if isinstance(target, str) else F.lit(float(target))
    l = l.filter((F.least(f, "_f1") <= t) & (t <= F.greatest(f, "_f1")) & F.col("_f1").isNotNull())
    v = F.when(F.col("_f1") == F.col(f), F.col(b)).otherwise(
        F.col(b) + (F.col("_b1") - F.col(b)) * (t - F.col(f)) / (F.col("_f1") - F.col(f)))
    return l.groupBy(*keys).agg(F.min_by(v, order).alias("b_at"))
