"""Group codec: key events in active blocks, moved by block maps, against subset schemes at the same fidelity."""
from pyspark.sql import DataFrame, functions as F

from ..functions.cols import active_threshold, block_centre, move_affine, ratio
from ..sensor import Sensor
from . import curves
from .encode import PARAMS, map_bits, set_bits
from .subsets import match_variants, subset_table, with_block_count
from .voxels import group_summary
from .windows import groups

Q_KEY, GRID = (1, 3), (2, 3)


def key_events(ev: DataFrame, ks: DataFrame, rhos, sensor: Sensor) -> DataFrame:
    """Events of the key windows in the active blocks, once per density `rho`; the window is `g`."""
    key = with_block_count(ev.join(ks, ["rec", "w"], "left_semi"), sensor).withColumnRenamed("w", "g")
    r = F.array_compact(F.array(*[F.when(F.col("n_block") >= active_threshold(sensor.block, x), F.lit(float(x)))
                                  for x in rhos]))
    return key.withColumn("rho", F.explode(r))


def reconstruct(key: DataFrame, maps: DataFrame, sensor: Sensor) -> DataFrame:
    """Key events (rec, g, block, x, y) moved by maps(rec, g, m, block, ..): rows per target m, on the sensor only."""
    cx, cy = block_centre("block", sensor.block, sensor.width)
    j = key.join(maps, ["rec", "g", "block"])
    x, y = move_affine("x", "y", cx, cy, sensor.block / 2.0, sensor.block / 2.0, PARAMS)
    j = j.withColumns({"x": x, "y": y}).filter((F.col("x") >= 0) & (F.col("x") < sensor.width) & (F.col("y") >= 0)
                                                & (F.col("y") < sensor.height))
    return j.withColumn("w", F.col("g") + F.col("m")).drop(*PARAMS)


def static_maps(key: DataFrame, K: int) -> DataFrame:
    zero = {p: F.lit(0).cast("bigint") for p in PARAMS}
    b = key.select("rec", "g", "block").distinct()
    return b.withColumn("m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(K - 1).cast("bigint")))).withColumns(zero)


def group_counts(ev: DataFrame, key: DataFrame, maps: DataFrame, ks: DataFrame, sensor: Sensor, K: int, cell=GRID,
                 params=PARAMS) -> DataFrame:
    """Per (rec, rho, g): n_key, n_rec, n_true, pairs and the bits of key events and maps."""
    pred = reconstruct(key, maps.filter(F.col("m") < K), sensor)
    mt = match_variants(pred, ev, cell, sensor, ("rho", "g", "m")).groupBy("rec", "rho", "g").agg(
        F.sum("n1").alias("n_rec"), F.sum("pairs").alias("pairs"))
    bits = set_bits(key, Q_KEY, sensor, ("rec", "rho", "g")).withColumnRenamed("n", "n_key")
    if params:
        used = key.select("rec", "rho", "g", "block").distinct().join(maps.filter(F.col("m") < K), ["rec", "g", "block"])
        bits = bits.join(map_bits(used, params, ("rec", "rho", "g")), ["rec", "rho", "g"]).withColumn(
            "bits", F.col("bits") + F.col("map_bits")).drop("map_bits")
    n = ev.groupBy("rec", "w").agg(F.count(F.lit(1)).alias("n"))
    true = groups(ks, K).join(n, ["rec", "w"]).groupBy("rec", "g").agg(F.sum("n").alias("n_true"))
    rho = key.select("rho").distinct()
    out = true.join(bits, ["rec", "g"]).join(mt, ["rec", "rho", "g"], "left")
    return out.select("rec", "rho", "g", "n_key", F.coalesce("n_rec", F.lit(0)).alias("n_rec"), "n_true",
                      F.coalesce("pairs", F.lit(0)).alias("pairs"), "bits")


def scheme_points(ev: DataFrame, ks: DataFrame, sensor: Sensor, K: int, shares, rhos, caps=()) -> DataFrame:
    """Per (rec, scheme): kept events and bits over all group windows, as share and bits per true event."""
    gw = groups(ks, K)
    sub = subset_table(ev.join(gw.select("rec", "w").distinct(), ["rec", "w"], "left_semi"), sensor, shares, rhos, caps)
    b = set_bits(sub, GRID, sensor, ("scheme", "rec", "w")).join(gw, ["rec", "w"]).groupBy("rec", "scheme").agg(
        F.sum("n").alias("n_kept"), F.sum("bits").alias("bits"))
    n = ev.groupBy("rec", "w").agg(F.count(F.lit(1)).alias("n"))
    n = gw.join(n, ["rec", "w"]).groupBy("rec").agg(F.sum("n").alias("n_true"))
    return b.join(n, "rec").select("rec", "scheme", (F.col("n_kept") / F.col("n_true")).alias("share"),
                                   (F.col("bits") / F.col("n_true")).alias("bits"))


def summarize(counts: DataFrame, points: DataFrame) -> DataFrame:
    """Per (rec, rho): fidelity, bits per true event, bits of the baselines at the same share, gains."""
    s = counts.groupBy("rec", "rho").agg(*[F.sum(c).alias(c) for c in ("n_key", "n_rec", "n_true", "pairs", "bits")])
    s = group_summary(s).withColumn("bits", F.col("bits") / F.col("n_true"))
    sch = F.col("scheme")
    c = points.groupBy("rec").agg(
        F.max(F.when(sch == "direct", F.col("bits"))).alias("bits_direct"),
        curves.curve(when=(sch == "direct") | sch.startswith("thin")).alias("_thin"),
        curves.curve(when=~sch.startswith("cap")).alias("_all"))
    c = c.select("rec", "bits_direct", curves.with_origin(F.col("_thin")).alias("_thin"),
                 curves.with_origin(F.col("_all")).alias("_all"))
    c = c.withColumn("_hull", curves.hull(F.col("_all"))).drop("_all")
    s = s.join(c, "rec").withColumns({"bits_thin": curves.lookup(F.col("_thin"), "q_eq"),
                                      "bits_base": curves.lookup(F.col("_hull"), "q_eq")}).drop("_thin", "_hull")
    return s.withColumns({"gain": ratio("bits_base", "bits"), "gain_thin": ratio("bits_thin", "bits"),
                          "J": ratio(F.col("bits_base") - F.col("bits"), "bits_direct")})
