"""Counts on space-time grids and their comparison.

Matching never joins events: both sets are tagged, counted per voxel in one aggregation (combined on the map side) and
the minimum of the two counts is summed. One shuffle on the voxel key, one small one on the group key; a voxel key
spreads a hot recording over all tasks.
"""
import math

from pyspark.sql import DataFrame, functions as F

from ..functions.cols import block_id, idiv, ratio, ratio0, time_bin, with_voxel
from ..sensor import Sensor
from ..session import dealt

VOXEL = ("p", "tb", "by", "bx")


def cells_table(df: DataFrame, cells) -> DataFrame:
    """Each row once per grid (s, k); the grid list is a literal, so no join is made."""
    arr = F.array(*[F.struct(F.lit(int(s)).cast("bigint").alias("s"), F.lit(int(k)).cast("bigint").alias("k"))
                    for s, k in cells])
    return df.withColumn("_c", F.explode(arr)).select("*", "_c.s", "_c.k").drop("_c")


def on_cells(ev: DataFrame, cells, sensor: Sensor, tr="tr") -> DataFrame:
    df = cells_table(ev, cells)
    return df.withColumns({"tb": time_bin(tr, "k", sensor.t0), "by": idiv("y", "s"), "bx": idiv("x", "s")})


def voxel_counts(ev: DataFrame, cells, sensor: Sensor, keys=("rec", "w")) -> DataFrame:
    return on_cells(ev, cells, sensor).groupBy(*keys, "s", "k", *VOXEL).agg(F.count(F.lit(1)).alias("c"))


def block_counts(ev: DataFrame, sensor: Sensor, keys=("rec", "w"), side=None) -> DataFrame:
    side = side or sensor.block
    return ev.groupBy(*keys, block_id("x", "y", side, sensor.width).alias("block")).agg(F.count(F.lit(1)).alias("n"))


def census(ev: DataFrame, sensor: Sensor, sides, rhos, keys=("rec", "w")) -> DataFrame:
    """Active blocks per side and density."""
    arr = F.array(*[F.lit(int(b)).cast("bigint") for b in sides])
    per = ev.withColumn("side", F.explode(arr)).withColumn(
        "block", idiv("y", "side") * F.ceil(F.lit(sensor.width) / F.col("side")) + idiv("x", "side")).groupBy(
        *keys, "side", "block").agg(F.count(F.lit(1)).alias("n"))
    rho = F.explode(F.array(*[F.lit(float(r)) for r in rhos])).alias("rho")
    per = per.select(*keys, "side", "n", rho)
    thr = F.greatest(F.lit(1), F.ceil(F.col("rho") * F.col("side") * F.col("side")))
    return per.groupBy(*keys, "side", "rho").agg(F.max(thr).cast("bigint").alias("threshold"),
                                                 F.count_if(F.col("n") >= thr).alias("n_active"))


def pair_counts(pred: DataFrame, true: DataFrame, cells, sensor: Sensor, keys=("rec", "w"), extra=()) -> DataFrame:
    """Per voxel the counts c1 of `pred` and c2 of `true`. Both need keys, tr, x, y, p (and `extra` of pixel space)."""
    cols = [*dict.fromkeys([*keys, "tr", "x", "y", "p", *extra])]
    a = pred.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = true.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    both = on_cells(a.unionByName(b), cells, sensor)
    return both.groupBy(*[c for c in dict.fromkeys([*keys, "s", "k", *VOXEL, *extra])]).agg(
        F.sum("_a").alias("c1"), F.sum("_b").alias("c2"))


def repeated_pair_counts(ev: DataFrame, cells, sensor: Sensor, lead=1, keys=("rec", "w")) -> DataFrame:
    """`pair_counts` of every window against the window `lead` before it, from one scan: each event counts once as itself
    and once as its own repetition."""
    o = F.explode(F.array(F.struct((F.col("w") + lead).alias("w"), F.lit(1).alias("a"), F.lit(0).alias("b")),
                          F.struct(F.col("w").alias("w"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("_o")
    rest = [*dict.fromkeys([*(k for k in keys if k != "w"), "tr", "x", "y", "p"])]
    e = ev.select(*rest, o).select(*rest, "_o.w", F.col("_o.a").alias("_a"), F.col("_o.b").alias("_b"))
    return on_cells(e, cells, sensor).groupBy(*keys, "s", "k", *VOXEL).agg(F.sum("_a").alias("c1"), F.sum("_b").alias("c2"))


def named_pair_counts(pred: DataFrame, names, true: DataFrame, cells, sensor: Sensor, keys, name="scheme", rows=0) -> DataFrame:
    """Per voxel the count c2 of `true`, which all sets of `pred` share, and c1_0, c1_1, ... of the sets that column `name` of `pred` tells apart.

    The truth is counted once, and a voxel is one row whatever the number of sets. Rows of a key lie together before they multiply by the grids; `rows` is about how
    many there are."""
    cols = [*keys, "tr", "x", "y", "p"]
    at = F.coalesce(*[F.when(F.col(name) == n, F.lit(i)) for i, n in enumerate(names)])
    both = pred.select(*cols, at.alias("_n")).unionByName(true.select(*cols, F.lit(-1).alias("_n")))
    both = on_cells(dealt(both, *keys, rows=rows * len(cells)), cells, sensor)
    return both.groupBy(*keys, "s", "k", *VOXEL).agg(F.count_if(F.col("_n") == -1).alias("c2"), *[F.count_if(F.col("_n") == i).alias(f"c1_{i}") for i in range(len(names))])


def by_name(v: DataFrame, names, cols, name="scheme") -> DataFrame:
    """One row per name with the columns `cols` of its set (<col>_0, <col>_1, ...)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias(name), *[F.col(f"{c}_{i}").alias(c) for c in cols]) for i, n in enumerate(names)])).alias("_s")
    out = v.select("*", each).drop(*[f"{c}_{i}" for c in cols for i in range(len(names))])
    return out.select(F.col(f"_s.{name}").alias(name), *[c for c in out.columns if c != "_s"], *[f"_s.{c}" for c in cols])


def matched_by_name(v: DataFrame, names, keys, name="scheme") -> DataFrame:
    """(name, keys, s, k, n1, n2, pairs) from `named_pair_counts`."""
    sums = [s for i in range(len(names)) for s in (F.sum(f"c1_{i}").alias(f"n1_{i}"), F.sum(F.least(f"c1_{i}", "c2")).alias(f"pairs_{i}"))]
    return by_name(v.groupBy(*keys, "s", "k").agg(F.sum("c2").alias("n2"), *sums), names, ("n1", "pairs"), name)


def matched(pairs: DataFrame, keys=("rec", "w")) -> DataFrame:
    """(keys, s, k, n1, n2, pairs) from voxel rows with c1 and c2."""
    return pairs.groupBy(*keys, "s", "k").agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"),
                                              F.sum(F.least("c1", "c2")).alias("pairs"))


def match(pred: DataFrame, true: DataFrame, cells, sensor: Sensor, keys=("rec", "w")) -> DataFrame:
    """(keys, s, k, n1, n2, pairs): sizes and matched events on each grid."""
    return matched(pair_counts(pred, true, cells, sensor, keys), keys)


def match_repeated(ev: DataFrame, cells, sensor: Sensor, lead=1) -> DataFrame:
    """How much of each window the window `lead` before it predicts."""
    return matched(repeated_pair_counts(ev, cells, sensor, lead))


def scores(m: DataFrame) -> DataFrame:
    hit = F.col("pairs").cast("double")
    return m.withColumns({"f1": ratio0(hit * 2.0, F.col("n1") + F.col("n2")), "precision": ratio0(hit, F.col("n1")),
                          "recall": ratio0(hit, F.col("n2"))})


def repeated(ev: DataFrame, lead=1) -> DataFrame:
    """Static prediction: every event again `lead` windows later."""
    return ev.withColumn("w", F.col("w") + lead)


def group_summary(df: DataFrame, n_key="n_key", n_rec="n_rec", n_true="n_true", m="pairs") -> DataFrame:
    """F, share, q_eq and gamma from sums over a group; n_true includes the key window, pairs and n_rec do not."""
    den = F.col(n_key) + F.col(n_rec) + F.col(n_true)
    df = df.withColumn("F", ratio0((F.col(n_key) + F.col(m)) * 2.0, den))
    df = df.withColumn("share", ratio(F.col(n_key).cast("double"), n_true))
    df = df.withColumn("q_eq", F.col("F") / (F.lit(2.0) - F.col("F")))
    return df.withColumn("gamma", ratio("q_eq", "share"))


def window_sums(pred: DataFrame, true: DataFrame, sensor: Sensor, keys=("rec", "w"), grid=(2, 3), hell=(8, 1),
                phi=1.0, theta=0.0) -> DataFrame:
    """N, N2, M, M20, H, Dsnr, Lsnr of a rebuilt window against the true one, from one pass over the tagged events.

    `phi` and `theta` are numbers or names of columns that depend on the keys only."""
    return voxel_sums(pair_counts(pred, true, [grid, hell, (sensor.block, 1)], sensor, keys), sensor, keys, grid, hell, phi, theta)


def named_window_sums(pred: DataFrame, names, true: DataFrame, sensor: Sensor, keys, grid=(2, 3), hell=(8, 1), phi=1.0, theta=0.0, rows=0) -> DataFrame:
    """`window_sums` of each set that `scheme` tells apart, against one truth."""
    v = by_name(named_pair_counts(pred, names, true, [grid, hell, (sensor.block, 1)], sensor, keys, rows=rows), names, ("c1",))
    return voxel_sums(v.filter("c1 > 0 OR c2 > 0"), sensor, (*keys, "scheme"), grid, hell, phi, theta)


def voxel_sums(v: DataFrame, sensor: Sensor, keys, grid, hell, phi, theta) -> DataFrame:
    """`window_sums` from voxel rows with c1 and c2 on its three grids."""
    B = sensor.block
    sq = (F.col("s") == grid[0]) & (F.col("k") == grid[1])
    isB = (F.col("s") == B) & (F.col("k") == 1)
    isH = (F.col("s") == hell[0]) & (F.col("k") == hell[1])
    least = F.least("c1", "c2")
    size = F.col("s")
    v = v.withColumn("block", idiv(F.col("by") * size, B) * sensor.nbx() + idiv(F.col("bx") * size, B))
    z = lambda c, x: F.sum(F.when(c, x).otherwise(0))                       # noqa: E731
    per = v.groupBy(*keys, "block").agg(
        z(sq, F.col("c2")).alias("bn"), z(sq, F.col("c1")).alias("bn2"), z(sq, least).alias("bm"),
        z(isB, least).alias("m20"), z(isH, F.sqrt((F.col("c1") * F.col("c2")).cast("double"))).alias("h"))
    phi = F.col(phi) if isinstance(phi, str) else F.lit(float(phi))
    theta = F.col(theta) if isinstance(theta, str) else F.lit(float(theta))
    enter = (F.col("bn") > theta) | (F.col("bn2") > theta)
    l1, l2, lm = (F.log1p(F.col(c) / phi) for c in ("bn", "bn2", "bm"))
    return per.groupBy(*keys).agg(
        F.sum("bn").alias("N"), F.sum("bn2").alias("N2"), F.sum("bm").alias("M"), F.sum("m20").alias("M20"),
        (F.sum("h") * 2.0).alias("H"),
        F.coalesce(F.sum(F.when(enter, l1 + l2 - lm * 2.0)), F.lit(0.0)).alias("Dsnr"),
        F.coalesce(F.sum(F.when(enter, l1 + l2)), F.lit(0.0)).alias("Lsnr"))


def fidelities(sums: DataFrame, keys) -> DataFrame:
    """The four fidelities from sums over windows (sums first, ratio last)."""
    names = ("N", "N2", "M", "M20", "H", "Dsnr", "Lsnr")
    a = sums.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    den = F.col("N") + F.col("N2")
    snr = F.when(F.col("Lsnr") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.col("Dsnr") / F.col("Lsnr"))))
    return a.select(*keys, "N", "N2", "M", ratio0(F.col("M") * 2.0, den).alias("F"),
                    ratio0(F.col("M20") * 2.0, den).alias("F20"), ratio0("H", den).alias("FH"),
                    F.coalesce(snr, F.lit(0.0)).alias("Fsnr"))


def count_errors(pairs: DataFrame, keys) -> DataFrame:
    """Differences of two count tables given as voxel rows with c1 (in) and c2 (out), 0 where absent."""
    a, b = F.col("c1"), F.col("c2")
    s = lambda c, x: F.sum(F.when(c, x).otherwise(0))                       # noqa: E731
    both = (a > 0) & (b > 0)
    out = pairs.groupBy(*keys).agg(
        F.sum("c1").alias("in_events"), F.sum("c2").alias("out_events"),
        F.count_if(a == 1).alias("in_vox1"), F.count_if(a >= 2).alias("in_vox2"),
        s((a == 1) & (b == 0), a).alias("removed1"), s((a >= 2) & (b == 0), a).alias("removed2"),
        s(both, a).alias("kept"), s(both, F.greatest(a - b, F.lit(0))).alias("lowered"),
        s(both, F.greatest(b - a, F.lit(0))).alias("raised"), s((a == 0) & (b > 0), b).alias("added"),
        F.count_if((a == 0) & (b > 0)).alias("added_vox"))
    return out.withColumn("balanced",
                          (F.col("removed1") + F.col("removed2") + F.col("kept") == F.col("in_events"))
                          & (F.col("kept") - F.col("lowered") + F.col("raised") + F.col("added") == F.col("out_events")))


def clipped(vox: DataFrame, cmax: int) -> DataFrame:
    return vox.withColumns({"lost": F.greatest(F.col("c") - cmax, F.lit(0)), "c": F.least(F.col("c"), F.lit(cmax))})


def shifted_prediction(ev: DataFrame, u: int, s: int, k: int, sensor: Sensor) -> DataFrame:
    """Counts of window w - 1 moved by u px against those of w, on the columns whose source lies on the sensor."""
    if u % s:
        raise ValueError("u must be a multiple of s")
    d, nx = u // s, -(-sensor.width // s)
    v = with_voxel(ev, s, k, sensor)
    prev = v.select("rec", (F.col("w") + 1).alias("w"), "p", "tb", "by", (F.col("bx") + d).alias("bx"),
                    F.lit(1).alias("a"), F.lit(0).alias("b"))
    cur = v.select("rec", "w", "p", "tb", "by", "bx", F.lit(0).alias("a"), F.lit(1).alias("b"))
    lo, hi = max(d, 0), nx + min(d, 0)
    per = prev.unionByName(cur).filter((F.col("bx") >= lo) & (F.col("bx") < hi)).groupBy(
        "rec", "w", "p", "tb", "by", "bx").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    per = per.groupBy("rec", "w").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("l1"),
                                      F.sum(F.col("a") + F.col("b")).alias("tot"))
    life = ev.groupBy("rec").agg(F.min("w").alias("w0"), F.max("w").alias("w1"))
    per = per.join(life, "rec").filter((F.col("w") > F.col("w0")) & (F.col("w") <= F.col("w1")))
    return per.groupBy("rec").agg(F.sum("l1").alias("l1"), F.sum("tot").alias("tot")).withColumn(
        "F", F.lit(1.0) - ratio(F.col("l1").cast("double"), "tot"))


def from_voxels(vox: DataFrame, sensor: Sensor, placement="start") -> DataFrame:
    """Events of counts: `c` copies at the origin or at the centre of each voxel. Columns s, k, tb, by, bx, p, c."""
    if placement == "start":
        tr = idiv(F.col("tb") * sensor.t0 + F.col("k") - 1, "k")
        x, y = F.col("bx") * F.col("s"), F.col("by") * F.col("s")
    elif placement == "center":
        tr = idiv((F.col("tb") * 2 + 1) * sensor.t0, F.col("k") * 2)
        half = idiv("s", 2)
        x = F.least(F.col("bx") * F.col("s") + half, F.lit(sensor.width - 1))
        y = F.least(F.col("by") * F.col("s") + half, F.lit(sensor.height - 1))
    else:
        raise ValueError(placement)
    drop = ("tb", "by", "bx", "c")
    return vox.withColumns({"tr": tr, "x": x, "y": y}).withColumn(
        "_i", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).drop("_i", *drop)


def log2(c):
    return F.ln(c) / math.log(2.0)
