"""Motion fits: block maps by votes, coordinate search with candidates as rows, image-variance and sharpness searches.

A search step scores all candidates of all keys in one join-aggregate; steps are cut with checkpoints so that plans stay
short. No Python runs per group and no group is collected.
"""
import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.cols import move_affine, ratio0, time_bin
from ..sensor import Sensor
from ..session import cut_lineage, dealt
from .encode import PARAMS
from .local_search import FRAME, climb_rows, fitted_in_order, graded
from .shift import best_shift, voxel_votes
from .velocity_search import sharpest_step

# fixed move list: a common stretch of both axes, then ia, id, ib, ic, dx, dy
MOVES = ((0, 0, 1, 0, 0, 1), (0, 0, 1, 0, 0, 0), (0, 0, 0, 0, 0, 1), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 1, 0),
         (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0))
OFFSETS = (-1, 1, -2, 2)


def group_targets(ev: DataFrame, ks: DataFrame, K: int) -> DataFrame:
    gw = ks.select("rec", F.col("w").alias("g"), F.explode(F.sequence(F.lit(1), F.lit(K - 1))).alias("m"))
    gw = gw.select("rec", "g", F.col("m").cast("bigint").alias("m"), (F.col("g") + F.col("m")).alias("w"))
    return ev.join(gw, ["rec", "w"])


def block_maps(key: DataFrame, ev: DataFrame, ks: DataFrame, sensor: Sensor, K: int, radius: int, cell=(2, 3)) -> DataFrame:
    """Translation map of each block of `key` (rec, g, block, tr, x, y, p) onto each target window, by voxel votes. Blocks
    are fitted independently; no motion wins ties, so a map never pairs fewer events than the static one."""
    k = ["rec", "g", "m"]
    src = key.withColumn("m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(K - 1).cast("bigint"))))
    tru = group_targets(ev, ks, K).select(*k, "tr", "x", "y", "p")
    b = best_shift(voxel_votes(src, tru, k, radius, cell, sensor, rows=key.count() * (K - 1)), [*k, "block"])
    every = src.select(*k, "block").distinct().join(b, [*k, "block"], "left")
    z = F.lit(0).cast("bigint")
    return every.select(*k, "block", F.coalesce("dx", z).alias("dx"), F.coalesce("dy", z).alias("dy"), z.alias("ia"), z.alias("ib"),
                        z.alias("ic"), z.alias("id"))


def search_tables(src: DataFrame, tru: DataFrame, src_keys, true_keys, sensor: Sensor, cell=(2, 3)):
    """(pixel counts of the source, voxel counts of the truth, their sums, block side): what `candidate_scores` compares. Cut, as every step reads them."""
    s, k = cell
    vox = {"tb": time_bin("tr", k, sensor.t0), "by": F.floor(F.col("y") / s), "bx": F.floor(F.col("x") / s)}
    t = cut_lineage(tru.withColumns(vox).groupBy(*true_keys, "p", "tb", "by", "bx").agg(F.count(F.lit(1)).alias("c2")))
    nt = cut_lineage(t.groupBy(*true_keys).agg(F.sum("c2").alias("nt")))
    pix = src.groupBy(*src_keys, "x", "y", "p", time_bin("tr", k, sensor.t0).alias("tb")).agg(F.count(F.lit(1)).alias("c"))
    return cut_lineage(pix), t, nt, s


def candidate_scores(tables, c: DataFrame, keys, true_keys, src_keys, rows=0) -> DataFrame:
    """(keys, _i, np, pairs, f1) of candidate maps `c` (keys, _i, PARAMS, frame, bounds); one that moves no event into its bounds is absent. With `rows`, about
    how many pixels of candidates there are, pixels and voxels are dealt over as many partitions as they need."""
    pix, t, nt, s = tables
    on = [*true_keys, "p", "tb", "by", "bx"]
    j = dealt(pix, *src_keys, rows=rows).join(c.hint("merge"), list(src_keys))
    x, y = move_affine("x", "y", "cx", "cy", "hx", "hy", PARAMS)
    j = j.withColumns({"x": x, "y": y}).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    v = j.withColumns({"by": F.floor(F.col("y") / s), "bx": F.floor(F.col("x") / s)}).groupBy(*keys, "_i", "p", "tb", "by", "bx").agg(
        F.sum("c").alias("c1"))
    m = dealt(v, *on, rows=rows).join(t.hint("merge"), on, "left").groupBy(*keys, "_i").agg(
        F.sum("c1").alias("np"), F.sum(F.least("c1", F.coalesce("c2", F.lit(0)))).alias("pairs"))
    return m.join(nt, list(true_keys), "left").withColumn("f1", ratio0(F.col("pairs") * 2.0, F.col("np") + F.coalesce("nt", F.lit(0))))


def climb(tables, cur: DataFrame, keys, true_keys, src_keys, rounds=None, offsets=OFFSETS) -> DataFrame:
    """Steps of `coordinate_search` over prepared tables. Keys that own their truth climb in one pass, each in its row. Others share truth that is too large to
    repeat per key: there a round is a join, a key that doesn't move is done, and later rounds hold the keys that still move."""
    steps = [(0,) * 6] + [tuple(v * o for v in mv) for mv in MOVES for o in offsets]
    if set(keys) == set(true_keys):
        return cut_lineage(climb_rows(tables, cur, keys, src_keys, steps, rounds))
    cand = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias("d" + n) for n, v in zip(PARAMS, st)])
                               for i, st in enumerate(steps)])).alias("_s")
    left, done = rounds, None
    cur = cut_lineage(cur)
    live, pixels = cur.count(), tables[0].count() * len(steps)
    most = max(live, 1)
    while left is None or left > 0:
        c = cur.select("*", cand)
        c = c.withColumns({n: F.col(n) + F.col(f"_s.d{n}") for n in PARAMS}).withColumn("_i", F.col("_s.i")).drop("_s", "f1", "pairs", "np")
        m = candidate_scores(tables, c, keys, true_keys, src_keys, -(-pixels * live // most))
        best = m.groupBy(*keys).agg(F.max_by(F.struct("_i", "f1", "pairs", "np"), F.struct(F.col("f1"), -F.col("_i"))).alias("_b"))
        keep = [n for n in cur.columns if n not in (*PARAMS, "f1", "pairs", "np")]
        d = F.array(*[F.array(*[F.lit(v) for v in st]) for st in steps])
        row = F.get(d, F.coalesce(F.col("_b._i"), F.lit(0)))
        cur = cur.join(best, keys, "left").select(
            *keep, *[(F.col(n) + F.get(row, F.lit(i))).cast("bigint").alias(n) for i, n in enumerate(PARAMS)],
            F.coalesce("_b.f1", F.lit(0.0)).alias("f1"), F.coalesce("_b.pairs", F.lit(0)).alias("pairs"),
            F.coalesce("_b.np", F.lit(0)).alias("np"), (F.coalesce(F.col("_b._i"), F.lit(0)) > 0).alias("_moved"))
        cur = cut_lineage(cur)
        stay, cur = cur.filter("NOT _moved").drop("_moved"), cur.filter("_moved").drop("_moved")
        done = stay if done is None else done.unionByName(stay)
        live = cur.count()
        if not live:
            return done
        left = None if left is None else left - 1
    return cur if done is None else done.unionByName(cur)


def coordinate_search(src: DataFrame, tru: DataFrame, start: DataFrame, keys, true_keys, sensor: Sensor, cell=(2, 3), rounds=None,
                      offsets=OFFSETS) -> DataFrame:
    """Improve maps `start` (keys, PARAMS, cx, cy, hx, hy, x0, x1, y0, y1) by steps along MOVES.

    `src` has the keys, tr, x, y, p; `tru` has `true_keys` (a subset of the keys), tr, x, y, p and is restricted by the caller.
    A round scores every candidate of every key at once and takes the best; a candidate must beat the current map, ties go
    to the earlier candidate. The score is F1 within the bounds. Rounds end when no key moves any more (a score only grows, so they do),
    or after `rounds`."""
    keys, true_keys = list(keys), list(true_keys)
    return climb(search_tables(src, tru, keys, true_keys, sensor, cell), start, keys, true_keys, keys, rounds, offsets)


# fixed values: grid cell and offsets of each stage, from coarse to fine; the last cell is the one that is judged
STAGES = (((8, 1), (-2, 2, -4, 4, -8, 8)), ((4, 1), (-1, 1, -2, 2, -4, 4)), ((2, 3), (-1, 1, -2, 2)))


def staged_affine(src: DataFrame, tru: DataFrame, start: DataFrame, group, shift, sensor: Sensor, stages=STAGES) -> DataFrame:
    """Affine maps of the targets m = 1, 2, ... of each group, by coordinate searches from coarse to fine.

    `src` (group, tr, x, y, p) is shared by the targets, `tru` has (group, m, tr, x, y, p), `start` (group, m, PARAMS, frame, bounds) the translation of
    each target with no shape, `shift` is a Column over m: the time by which a target's events move. A search begins at the better of two maps: the translation,
    and the translation with the shape fitted for m - 1 scaled by the ratio of the shifts (the translation on a tie, and where m - 1 is absent). A result
    that does not beat the translation on the last stage's cell is dropped for it, so no target ends below it. Returns `start` with fitted
    PARAMS, np, pairs, f1 and start_f1.

    A group's source pixels and the truth of its targets are one row, and its targets are fitted one after the other in a task (`fitted_in_order`), the same target
    of all groups of a batch at once; nothing is shuffled between targets or stages."""
    group = list(group)
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in start.schema if f.name not in PARAMS]
    moves = [np.array([(0,) * 6] + [tuple(v * o for v in mv) for mv in MOVES for o in offsets], np.int64) for _, offsets in stages]
    names = [f.name for f in start.schema if f.name not in PARAMS] + [*PARAMS, "np", "pairs", "f1", "start_f1"]
    schema = ", ".join([*out, *[f"{n} bigint" for n in (*PARAMS, "np", "pairs")], "f1 double", "start_f1 double"])
    start = start.withColumn("_shift", shift.cast("double"))
    rows = target_rows(src, tru, start, group, [k for (_, k), _ in stages], sensor, PARAMS, ("_shift",))
    return cut_lineage(rows.mapInArrow(fitted_in_order(stages, moves, names), schema))


def target_rows(src: DataFrame, tru: DataFrame, to: DataFrame, group, bins, sensor: Sensor, maps, more=()) -> DataFrame:
    """One row per group: its pixels and its targets `to` (group, m, frame, bounds, `maps`, `more`) with their truth, each with the time bins of `bins`."""
    tb = {f"tb{i}": time_bin("tr", k, sensor.t0) for i, k in enumerate(bins)}
    cells = lambda df, keys, name: df.groupBy(*keys, "x", "y", "p", *[b.alias(c) for c, b in tb.items()]).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(
        F.collect_list(F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("x", "y", "p", "c", *tb)])).alias(name))
    to = to.join(cells(tru, [*group, "m"], "_t").hint("merge"), [*group, "m"], "left").groupBy(*group).agg(
        F.collect_list(F.struct("m", *more, *[F.col(n).cast("bigint").alias(n) for n in maps], *FRAME, "_t")).alias("_to"))
    return dealt(to.join(cells(src, group, "_px").hint("merge"), group, "left"), *group)


def target_grades(src: DataFrame, tru: DataFrame, maps: DataFrame, models, group, cells, sensor: Sensor) -> DataFrame:
    """(group, m, model, s, k, n1, n2, pairs) of the maps of each target on each grid of `cells`, as `voxels.match` counts them. `maps` has the group, m, frame, bounds and
    the columns of `models` (name to its six columns). A group is one row, so neither models nor grids are shuffled."""
    group = list(group)
    rows = target_rows(src, tru, maps, group, [k for _, k in cells], sensor, [c for names in models.values() for c in names])
    kept = [f for f in maps.schema if f.name in (*group, "m")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["model string", *[f"{c} bigint" for c in ("s", "k", "n1", "n2", "pairs")]])
    return rows.mapInArrow(graded(cells, models, [f.name for f in kept] + ["model", "s", "k", "n1", "n2", "pairs"]), schema)


def variance_velocity(ev: DataFrame, keys, vmax=0.6, coarse=0.1, fine=0.02, margin=20) -> DataFrame:
    """Velocity (px per unit of `ts`) that maximises the variance of the warped image of each key.

    Rows: keys, x, y, ts (time since the reference), and the region bx, by, bw, bh. Empty pixels count through the area
    (bw + 2 margin)(bh + 2 margin). The first best candidate in raster order wins; the fine stage must improve."""
    keys = list(keys)
    n = int(round(vmax / coarse))
    grid = [(i * coarse, j * coarse) for i in range(-n, n + 1) for j in range(-n, n + 1)]
    k = int(round(coarse / fine))
    sub = [(i * fine, j * fine) for i in range(-k, k + 1) for j in range(-k, k + 1)]

    def stage(df, cands, vx0, vy0):
        c = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in
                                enumerate(cands)])).alias("_c")
        e = df.select("*", c).withColumns({"_vx": vx0 + F.col("_c.a"), "_vy": vy0 + F.col("_c.b")})
        e = e.withColumns({"_wx": F.rint(F.col("x") - F.col("_vx") * F.col("ts")) - F.col("bx") + margin,
                           "_wy": F.rint(F.col("y") - F.col("_vy") * F.col("ts")) - F.col("by") + margin,
                           "_A": (F.col("bw") + 2 * margin) * (F.col("bh") + 2 * margin)})
        e = e.filter((F.col("_wx") >= 0) & (F.col("_wx") < F.col("bw") + 2 * margin) & (F.col("_wy") >= 0)
                     & (F.col("_wy") < F.col("bh") + 2 * margin))
        s = e.groupBy(*keys, "_c.i", "_vx", "_vy", "_A", "_wx", "_wy").agg(F.count(F.lit(1)).alias("c"))
        s = s.groupBy(*keys, "i", "_vx", "_vy", "_A").agg(F.sum("c").alias("s1"), F.sum(F.col("c") * F.col("c")).alias("s2"))
        var = F.col("s2") / F.col("_A") - (F.col("s1") / F.col("_A")) * (F.col("s1") / F.col("_A"))
        s = s.withColumn("var", var)
        return s.groupBy(*keys).agg(F.max_by(F.struct(F.col("_vx").alias("vx"), F.col("_vy").alias("vy"), "var"),
                                             F.struct(F.col("var"), -F.col("i"))).alias("_b")).select(*keys, "_b.*")

    ev = cut_lineage(ev)
    ev = dealt(ev, *keys, rows=ev.count() * len(grid))                     # candidates of a key are counted where its events lie
    a = cut_lineage(stage(ev, grid, F.lit(0.0), F.lit(0.0)))
    b = stage(ev.join(a.select(*keys, F.col("vx").alias("_v0"), F.col("vy").alias("_v1")).hint("merge"), keys), sub, F.col("_v0"), F.col("_v1"))
    b = b.withColumnsRenamed({"vx": "fx", "vy": "fy", "var": "fv"})
    up = F.col("fv") > F.col("var")
    return a.join(b, keys).select(*keys, F.when(up, F.col("fx")).otherwise(F.col("vx")).alias("vx"),
                                  F.when(up, F.col("fy")).otherwise(F.col("vy")).alias("vy"),
                                  F.greatest("var", "fv").alias("var"))


#: Stages of the velocity search: candidates on either side of the best so far, and their spacing as a share of the start's uncertainty.
HALVING = ((4, 1 / 4), (2, 1 / 8), (2, 1 / 16), (2, 1 / 32), (2, 1 / 64))


def velocity_square(side: int, spacing):
    """The (2 side + 1)^2 velocities around columns vx, vy, as rows: d2, i, j order ties from the centre outwards."""
    cells = [(i * i + j * j, i, j) for i in range(-side, side + 1) for j in range(-side, side + 1)]
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, ("d2", "i", "j"))], (F.col("vx") + spacing * c[1]).alias("vx"),
                                        (F.col("vy") + spacing * c[2]).alias("vy")) for c in cells])).alias("_v")


def velocity_sharpness(ev: DataFrame, best: DataFrame, keys, side: int, spacing, tick) -> DataFrame:
    """Sharpness of each velocity of the square around a key's best (columns vx, vy and a site size `site`): mean number of events at the site of an event,
    per polarity, after each event went back along the velocity.

    Events meet one row per key and multiply behind that join, where the rows of a key lie together: neither they nor the candidates are shuffled."""
    at = lambda c, v: F.rint((F.col(c) - F.col(v) * F.col("dt") * F.lit(tick)) / F.col("site"))
    c = ["vx", "vy", "d2", "i", "j"]
    e = dealt(ev, *keys).join(best.hint("merge"), list(keys)).select(*keys, "x", "y", "p", "dt", "site", velocity_square(side, spacing))
    e = e.select(*keys, "x", "y", "p", "dt", "site", *[f"_v.{n}" for n in c])
    e = e.groupBy(*keys, *c, "p", at("x", "vx").alias("_a"), at("y", "vy").alias("_b")).agg(F.count(F.lit(1)).alias("c"))
    return e.groupBy(*keys, *c).agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("score"))


def sharpness_velocity(ev: DataFrame, keys, init: DataFrame, tick=1e-6, floor=30.0, schedule=HALVING) -> DataFrame:
    """Velocity (px/s) that maximises template sharpness (`velocity_sharpness`), by stages; a stage reads the events once, sorted by key.

    Rows: keys, x, y, p, dt (ticks since the reference). `init` holds keys, vx, vy. The start is uncertain by half its speed, `floor` at least. A site
    is as wide as the spacing moves events over their time span, one pixel at least; equal scores go to the candidate nearest the centre."""
    keys = list(keys)
    ev = cut_lineage(ev)
    span = ev.groupBy(*keys).agg(((F.max("dt") - F.min("dt")) * F.lit(tick)).alias("_span"))
    best = init.join(span, keys).select(*keys, *[F.col(c).cast("double").alias(c) for c in ("vx", "vy", "_span")])
    best = best.withColumn("_unsure", F.greatest(F.lit(float(floor)), F.hypot("vx", "vy") * 0.5))
    for side, share in schedule:
        spacing = F.col("_unsure") * share
        site = F.greatest(F.lit(1.0), spacing * F.greatest("_span", F.lit(1e-6)))
        best = cut_lineage(sharpest_step(ev, cut_lineage(best.withColumns({"spacing": spacing, "site": site})), keys, side, tick))
    return best.select(*keys, "vx", "vy")
