"""Labelled boxes: tracks, interpolation, event-in-box joins, support rectangles, overlaps, dilated unions.

Interpolation is an as-of join turned into an equi-join: each pair of consecutive frames is one segment, a segment is
exploded into the windows (and, against events, into the square tiles) it covers, and the time test is a filter after the
join on (rec, w[, tile]).
"""
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cols import idiv, ratio
from ..sensor import Sensor
from .scans import lagged

BOX = ("x", "y", "w", "h")


def clean_labels(raw: DataFrame) -> DataFrame:
    """Duplicate frames of a track keep the first row."""
    first = F.min_by(F.struct("class_id", *BOX), "seq")
    return raw.groupBy("rec", "track_id", "t_us").agg(first.alias("b")).select(
        "rec", "track_id", "t_us", "b.*")


def tracks(labels: DataFrame) -> DataFrame:
    """Life and majority class (ties to the smallest) of each track."""
    per = labels.groupBy("rec", "track_id", "class_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    return per.groupBy("rec", "track_id").agg(
        F.max_by("class_id", F.struct(F.col("n"), -F.col("class_id"))).alias("class_id"), F.min("a").alias("t_first"),
        F.max("b").alias("t_last"), F.sum("n").alias("n_frames"))


def segments(labels: DataFrame, t0: int, chunk_windows=64) -> DataFrame:
    """Consecutive frames of a track: [ta, tb) with both boxes; the last frame is a segment with tb NULL."""
    df = labels.select("rec", "track_id", F.col("t_us").alias("ta"), *[F.col(c).alias(c + "a") for c in BOX])
    df = df.withColumn("_chunk", idiv("ta", t0 * chunk_windows))
    vals = ["ta", *[c + "a" for c in BOX]]
    df = lagged(df, ["rec", "track_id"], ["ta"], "_chunk", vals, "n_", ahead=True).drop("_chunk")
    return df.withColumnsRenamed({"n_ta": "tb", **{f"n_{c}a": c + "b" for c in BOX}})


def by_window(seg: DataFrame, t0: int) -> DataFrame:
    """One row per segment and window it touches."""
    last = F.coalesce(idiv(F.col("tb") - 1, t0), idiv("ta", t0))
    return seg.withColumn("w", F.explode(F.sequence(idiv("ta", t0), last)))


def covers(t):
    t = F.col(t) if isinstance(t, str) else t
    return (t >= F.col("ta")) & ((t < F.col("tb")) | (F.col("tb").isNull() & (t == F.col("ta"))))


def interpolated(t, prefix="b"):
    """Box columns at time t inside a segment row."""
    t = F.col(t) if isinstance(t, str) else t
    f = F.when(F.col("tb").isNull(), 0.0).otherwise((t - F.col("ta")).cast("double") / (F.col("tb") - F.col("ta")))
    return {prefix + c: F.col(c + "a") + f * (F.coalesce(c + "b", c + "a") - F.col(c + "a")) for c in BOX}


def box_at(points: DataFrame, seg: DataFrame, life: DataFrame, t0: int, t="t", prefix="b") -> DataFrame:
    """Box of (rec, track_id) at time `t`, held constant beyond the life of the track. Points of unknown tracks drop."""
    if "t_first" not in points.columns:
        points = points.join(life.select("rec", "track_id", "t_first", "t_last"), ["rec", "track_id"])
    tc = F.greatest(F.least(F.col(t).cast("double"), F.col("t_last")), F.col("t_first"))
    p = points.withColumn("_t", tc).withColumn("_w", F.floor(F.col("_t") / t0))
    s = by_window(seg, t0).withColumnRenamed("w", "_w")
    j = p.join(s, ["rec", "track_id", "_w"]).filter(covers("_t"))
    return j.withColumns(interpolated("_t", prefix)).select(*points.columns, *[prefix + c for c in BOX])


def box_centre(prefix="b"):
    return F.col(prefix + "x") + F.col(prefix + "w") * 0.5, F.col(prefix + "y") + F.col(prefix + "h") * 0.5


def velocity(points: DataFrame, seg: DataFrame, life: DataFrame, t0: int, span, t="t", tick=1e-6) -> DataFrame:
    """Mean centre velocity over [t - span, t] per second, 0 where the track has no past. Adds vx, vy and the box."""
    span = F.col(span) if isinstance(span, str) else F.lit(span)
    p = points if "t_first" in points.columns else points.join(
        life.select("rec", "track_id", "t_first", "t_last"), ["rec", "track_id"])
    p = box_at(p, seg, life, t0, t)
    p = p.withColumn("_t0", F.greatest(F.col("t_first"), F.col(t) - span))
    p = box_at(p, seg, life, t0, "_t0", "o")
    cx1, cy1 = box_centre("b")
    cx0, cy0 = box_centre("o")
    d = (F.col(t) - F.col("_t0")) * F.lit(tick)
    v = {"vx": F.when(d > 0, (cx1 - cx0) / d).otherwise(0.0), "vy": F.when(d > 0, (cy1 - cy0) / d).otherwise(0.0)}
    return p.withColumns(v).drop("_t0", *["o" + c for c in BOX])


def instants(life: DataFrame, min_life: int, first: int, step: int, tail: int) -> DataFrame:
    """Evaluation instants of the tracks that live long enough."""
    stop = F.col("t_last") - tail
    return life.filter((F.col("t_last") - F.col("t_first") >= min_life) & (stop >= F.col("t_first") + first)).withColumn(
        "t_e", F.explode(F.sequence(F.col("t_first") + first, stop, F.lit(step).cast("bigint"))))


def tile_range(lo, hi, side, n):
    lo, hi = F.floor(lo / side), F.floor(hi / side)
    return F.sequence(F.greatest(F.lit(0).cast("bigint"), lo), F.least(F.lit(n - 1).cast("bigint"), hi))


def in_box(ev: DataFrame, seg: DataFrame, sensor: Sensor, margin=0.0, tile=64) -> DataFrame:
    """Pairs (event, track) with the event inside the moving box dilated by `margin`, and inside the track's life."""
    ntx, nty = -(-sensor.width // tile), -(-sensor.height // tile)
    xa, xb = F.col("xa"), F.coalesce("xb", "xa")
    ya, yb = F.col("ya"), F.coalesce("yb", "ya")
    x1, y1 = F.greatest(xa + F.col("wa"), xb + F.coalesce("wb", "wa")), F.greatest(ya + F.col("ha"), yb + F.coalesce("hb", "ha"))
    lo_x, hi_x, lo_y, hi_y = F.least(xa, xb) - margin, x1 + margin, F.least(ya, yb) - margin, y1 + margin
    on = (hi_x >= 0) & (lo_x < sensor.width) & (hi_y >= 0) & (lo_y < sensor.height)
    s = by_window(seg.filter(on), sensor.t0)
    s = s.withColumn("tx", F.explode(tile_range(lo_x, hi_x, tile, ntx))).withColumn(
        "ty", F.explode(tile_range(lo_y, hi_y, tile, nty)))
    e = ev.withColumnsRenamed({"x": "ex", "y": "ey"}).withColumns({"tx": idiv("ex", tile), "ty": idiv("ey", tile)})
    j = e.join(s, ["rec", "w", "tx", "ty"]).filter(covers("t_us")).withColumns(interpolated("t_us"))
    m = F.lit(float(margin))
    inside = ((F.col("ex") >= F.col("bx") - m) & (F.col("ex") <= F.col("bx") + F.col("bw") + m)
              & (F.col("ey") >= F.col("by") - m) & (F.col("ey") <= F.col("by") + F.col("bh") + m))
    keep = [c for c in ev.columns if c not in ("x", "y")]
    return j.filter(inside).select(*keep, F.col("ex").alias("x"), F.col("ey").alias("y"), "track_id",
                                   *["b" + c for c in BOX])


def support_rect(inst: DataFrame, seg: DataFrame, life: DataFrame, sensor: Sensor, t1, d, t2: int, margin=2.0,
                 tick=1e-6) -> DataFrame:
    """Inclusive pixel rectangle sx0..sx1, sy0..sy1 around the box at the middle of [t_e + d, t_e + d + t2); NULL off the
    sensor. Adds vx, vy and speed."""
    p = velocity(inst, seg, life, sensor.t0, t1, "t_e", tick).drop(*["b" + c for c in BOX])
    d = F.col(d) if isinstance(d, str) else F.lit(d)
    p = p.withColumn("_mid", F.col("t_e") + d + F.lit(t2 / 2.0))
    p = box_at(p, seg, life, sensor.t0, "_mid").drop("_mid")
    p = p.withColumn("speed", F.hypot("vx", "vy"))
    grow = F.lit(float(margin)) + F.col("speed") * F.lit(0.5 * t2 * tick)
    x0 = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("bx") - grow))
    x1 = F.least(F.lit(sensor.width - 1).cast("bigint"), F.ceil(F.col("bx") + F.col("bw") + grow))
    y0 = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("by") - grow))
    y1 = F.least(F.lit(sensor.height - 1).cast("bigint"), F.ceil(F.col("by") + F.col("bh") + grow))
    ok = (x1 >= x0) & (y1 >= y0)
    return p.withColumns({n: F.when(ok, c) for n, c in (("sx0", x0), ("sx1", x1), ("sy0", y0), ("sy1", y1))})


def overlap_flag(rects: DataFrame, seg: DataFrame, sensor: Sensor, tile=64) -> DataFrame:
    """1 if the support rectangle meets another track's box at t_e, 0 if not, -1 without a rectangle."""
    ntx, nty = -(-sensor.width // tile), -(-sensor.height // tile)
    r = rects.filter("sx0 IS NOT NULL").select("rec", "track_id", "t_e", "sx0", "sx1", "sy0", "sy1",
                                               idiv("t_e", sensor.t0).alias("w"))
    r = r.withColumn("tx", F.explode(tile_range(F.col("sx0"), F.col("sx1"), tile, ntx))).withColumn(
        "ty", F.explode(tile_range(F.col("sy0"), F.col("sy1"), tile, nty))).distinct()
    xa, xb, ya, yb = F.col("xa"), F.coalesce("xb", "xa"), F.col("ya"), F.coalesce("yb", "ya")
    hx, hy = F.greatest(xa + F.col("wa"), xb + F.coalesce("wb", "wa")), F.greatest(ya + F.col("ha"), yb + F.coalesce("hb", "ha"))
    lx, ly = F.least(xa, xb), F.least(ya, yb)
    on = (hx >= 0) & (lx < sensor.width) & (hy >= 0) & (ly < sensor.height)
    s = by_window(seg.filter(on), sensor.t0).withColumn("tx", F.explode(tile_range(lx, hx, tile, ntx))).withColumn(
        "ty", F.explode(tile_range(ly, hy, tile, nty))).withColumnRenamed("track_id", "other")
    hit = r.join(s, ["rec", "w", "tx", "ty"]).filter((F.col("other") != F.col("track_id")) & covers("t_e"))
    hit = hit.withColumns(interpolated("t_e")).filter(
        (F.col("bx") <= F.col("sx1")) & (F.col("bx") + F.col("bw") >= F.col("sx0"))
        & (F.col("by") <= F.col("sy1")) & (F.col("by") + F.col("bh") >= F.col("sy0")))
    hit = hit.select("rec", "track_id", "t_e", "sx0", "sx1", "sy0", "sy1").distinct().withColumn("_hit", F.lit(1))
    return rects.join(hit, ["rec", "track_id", "t_e", "sx0", "sx1", "sy0", "sy1"], "left").withColumn(
        "overlap", F.when(F.col("sx0").isNull(), -1).otherwise(F.coalesce("_hit", F.lit(0)))).drop("_hit")


def clip_to_sensor(df: DataFrame, sensor: Sensor, prefix="b") -> DataFrame:
    x, y, w, h = (F.col(prefix + c) for c in BOX)
    x0, y0 = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    x1, y1 = F.least(F.lit(float(sensor.width)), x + w), F.least(F.lit(float(sensor.height)), y + h)
    df = df.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1}).filter("_x1 > _x0 AND _y1 > _y0")
    return df.withColumns({prefix + "x": F.col("_x0"), prefix + "y": F.col("_y0"), prefix + "w": F.col("_x1") - F.col("_x0"),
                           prefix + "h": F.col("_y1") - F.col("_y0")}).drop("_x0", "_y0", "_x1", "_y1")


def boxes_at_centres(seg: DataFrame, sensor: Sensor) -> DataFrame:
    """(rec, w, track_id, box) interpolated at each window centre in the life of a track, clipped to the sensor."""
    c = (F.col("w") + 0.5) * float(sensor.t0)
    s = by_window(seg, sensor.t0).withColumn("_c", c).filter(covers("_c")).withColumns(interpolated("_c"))
    return clip_to_sensor(s.select("rec", "w", "track_id", *["b" + k for k in BOX]), sensor)


def boxes_nearest(labels: DataFrame, sensor: Sensor) -> DataFrame:
    """Label frame nearest the centre of the window that holds it (the earlier one on a tie), clipped."""
    f = labels.withColumn("_wn", idiv("t_us", sensor.t0))
    c = (F.col("_wn") + 0.5) * float(sensor.t0)
    b = f.groupBy("rec", "_wn", "track_id").agg(F.min_by(F.struct("t_us", *BOX), F.struct(F.abs(F.col("t_us") - c), "t_us"))
                                                .alias("f"))
    b = b.select("rec", F.col("_wn").alias("w0"), "track_id", "f.t_us", *[F.col(f"f.{k}").alias("b" + k) for k in BOX])
    return clip_to_sensor(b.withColumnRenamed("w0", "w"), sensor)


def box_pixels(boxes: DataFrame, sensor: Sensor, margin=0.0, keys=("rec", "w"), closed=False) -> DataFrame:
    """Distinct pixels of the union of the boxes dilated by `margin` (ceil at both ends, half open; with `closed`, from
    the ceiling to the floor, both included)."""
    lo = lambda c: F.greatest(F.lit(0).cast("bigint"), F.ceil(c - margin))                    # noqa: E731
    if closed:
        hi = lambda c, n: F.least(F.lit(n - 1).cast("bigint"), F.floor(c + margin))           # noqa: E731
    else:
        hi = lambda c, n: F.least(F.lit(n).cast("bigint"), F.ceil(c + margin)) - 1            # noqa: E731
    b = boxes.withColumns({"_xa": lo(F.col("bx")), "_xb": hi(F.col("bx") + F.col("bw"), sensor.width),
                           "_ya": lo(F.col("by")), "_yb": hi(F.col("by") + F.col("bh"), sensor.height)})
    b = b.filter("_xb >= _xa AND _yb >= _ya").select(*keys, "_xa", "_xb", "_ya", "_yb").distinct()
    return b.withColumn("x", F.explode(F.sequence("_xa", "_xb"))).withColumn("y", F.explode(F.sequence("_ya", "_yb"))).select(
        *keys, "x", "y").distinct()


def pixel_bounds(boxes: DataFrame, sensor: Sensor, margin=0.0, prefix="_") -> DataFrame:
    """First and last column and row (xa, xb, ya, yb) of the pixels of each box dilated by `margin`, as `box_pixels` takes them."""
    lo = lambda c: F.greatest(F.lit(0).cast("bigint"), F.ceil(c - margin))                    # noqa: E731
    hi = lambda c, n: F.least(F.lit(n).cast("bigint"), F.ceil(c + margin)) - 1                # noqa: E731
    return boxes.withColumns({prefix + "xa": lo(F.col("bx")), prefix + "xb": hi(F.col("bx") + F.col("bw"), sensor.width),
                              prefix + "ya": lo(F.col("by")), prefix + "yb": hi(F.col("by") + F.col("bh"), sensor.height)})


def bounds_area(prefix):
    side = lambda a, b: F.greatest(F.lit(0).cast("bigint"), F.col(prefix + b) - F.col(prefix + a) + 1)
    return side("xa", "xb") * side("ya", "yb")


def in_bounds(prefix):
    return F.col("x").between(F.col(prefix + "xa"), F.col(prefix + "xb")) & F.col("y").between(F.col(prefix + "ya"), F.col(prefix + "yb"))


def events_in_rects(ev: DataFrame, boxes: DataFrame, keys=("rec", "w"), tile=64, sensor: Sensor = None) -> DataFrame:
    """Pairs (event, box) with half-open bounds; boxes carry bx, by, bw, bh and an id column set."""
    ntx, nty = -(-sensor.width // tile), -(-sensor.height // tile)
    b = boxes.withColumn("_tx", F.explode(tile_range(F.col("bx"), F.col("bx") + F.col("bw"), tile, ntx))).withColumn(
        "_ty", F.explode(tile_range(F.col("by"), F.col("by") + F.col("bh"), tile, nty)))
    e = ev.withColumns({"_tx": idiv("x", tile), "_ty": idiv("y", tile)})
    return e.join(b, [*keys, "_tx", "_ty"]).filter(
        (F.col("x") >= F.col("bx")) & (F.col("x") < F.col("bx") + F.col("bw"))
        & (F.col("y") >= F.col("by")) & (F.col("y") < F.col("by") + F.col("bh"))).drop("_tx", "_ty")


def top_squares(ev: DataFrame, side: int, sensor: Sensor, least=200, most=10, keys=("rec", "w")) -> DataFrame:
    """Densest full squares of a fixed raster; ties to the smaller index."""
    nx, ny = sensor.width // side, sensor.height // side
    e = ev.filter((F.col("x") < nx * side) & (F.col("y") < ny * side))
    c = e.groupBy(*keys, (idiv("y", side) * nx + idiv("x", side)).alias("square")).agg(F.count(F.lit(1)).alias("n"))
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "square"))
    return c.filter(F.col("n") >= least).withColumn("rk", rk).filter(F.col("rk") <= most)


def densest_crop(ev: DataFrame, cw: int, ch: int, step: int, sensor: Sensor, keys=("rec", "w")) -> DataFrame:
    """Crop of cw x ch on a lattice of `step` with the most events; ties to the smaller row, then column.

    Each lattice cell is added to the crops that contain it: a fixed fan-out of (cw/step)(ch/step) per counted cell."""
    cell = ev.groupBy(*keys, idiv("x", step).alias("cx"), idiv("y", step).alias("cy")).agg(F.count(F.lit(1)).alias("c"))
    kx, ky = cw // step, ch // step
    mx, my = (sensor.width - cw) // step, (sensor.height - ch) // step
    rng = lambda c, k, m: F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col(c) - k + 1),     # noqa: E731
                                     F.least(F.lit(m).cast("bigint"), F.col(c)))
    ok = (F.col("cx") - kx + 1 <= mx) & (F.col("cy") - ky + 1 <= my)
    cell = cell.filter(ok).withColumn("ix", F.explode(rng("cx", kx, mx))).withColumn("iy", F.explode(rng("cy", ky, my)))
    s = cell.groupBy(*keys, "ix", "iy").agg(F.sum("c").alias("n"))
    best = s.groupBy(*keys).agg(F.max_by(F.struct("ix", "iy", "n"), F.struct(F.col("n"), -F.col("iy"), -F.col("ix")))
                                .alias("b"))
    return best.select(*keys, (F.col("b.ix") * step).alias("x0"), (F.col("b.iy") * step).alias("y0"), F.col("b.n").alias("n"))


def density_ratio(inside, ring, a_in, a_ring):
    return F.when((a_in > 0) & (a_ring > 0), F.when(ring > 0, ratio(inside / a_in, ring / a_ring)).otherwise(
        F.lit(float("inf"))))
