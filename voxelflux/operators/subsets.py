"""Subset schemes: thinning, active blocks, caps, a bit budget, and one long table of all of them."""
from pyspark.sql import DataFrame, functions as F

from ..functions.cols import block_id, uniform
from ..sensor import Sensor
from .trains import cap_per_block
from .voxels import voxel_counts

SEED = 20261016


def thin(ev: DataFrame, chi, seed=SEED) -> DataFrame:
    """Keep each event with probability chi; the draw is a hash of the row, so subsets are nested in chi."""
    chi = F.col(chi) if isinstance(chi, str) else F.lit(float(chi))
    return ev.filter(uniform(seed, "seq", "w") < chi)


def with_block_count(ev: DataFrame, sensor: Sensor, keys=("rec", "w"), side=None) -> DataFrame:
    side = side or sensor.block
    ev = ev.withColumn("block", block_id("x", "y", side, sensor.width))
    n = ev.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n_block"))
    return ev.join(n, [*keys, "block"])


def subset_table(ev: DataFrame, sensor: Sensor, shares, rhos, caps, keys=("rec", "w"), seed=SEED) -> DataFrame:
    """One row per (scheme, kept event). Direct, thinned and selected subsets are decided per row with one pass; caps need
    ranks and are added as further rows."""
    import math
    e = with_block_count(ev, sensor, keys)
    u = uniform(seed, "seq", "w")
    names = [F.lit("direct")] + [F.when(u < float(c), F.lit(f"thin_{c}")) for c in shares]
    names += [F.when(F.col("n_block") >= max(1, math.ceil(r * sensor.block ** 2)), F.lit(f"select_{r}")) for r in rhos]
    out = e.withColumn("scheme", F.explode(F.array_compact(F.array(*names)))).drop("block", "n_block")
    if caps:
        c = F.explode(F.array(*[F.lit(n).cast("bigint") for n in caps])).alias("_n")
        k = cap_per_block(ev.select("*", c), "_n", sensor, ("_n", *keys))
        k = k.withColumn("scheme", F.concat(F.lit("cap_"), F.col("_n").cast("string"))).drop("_n", "block")
        out = out.unionByName(k.select(*out.columns))
    return out


def match_variants(pred: DataFrame, true: DataFrame, cell, sensor: Sensor, variants, keys=("rec", "w")) -> DataFrame:
    """(variants, keys, n1, n2, pairs) with the true set counted once for all variants."""
    p = voxel_counts(pred, [cell], sensor, (*variants, *keys)).withColumnRenamed("c", "c1")
    t = voxel_counts(true, [cell], sensor, keys).withColumnRenamed("c", "c2")
    n2 = t.groupBy(*keys).agg(F.sum("c2").alias("n2"))
    vox = [*keys, "s", "k", "p", "tb", "by", "bx"]
    m = p.join(t, vox, "left").groupBy(*variants, *keys).agg(
        F.sum("c1").alias("n1"), F.coalesce(F.sum(F.least("c1", F.coalesce("c2", F.lit(0)))), F.lit(0)).alias("pairs"))
    return m.join(n2, list(keys), "left").select(*variants, *keys, "n1", F.coalesce("n2", F.lit(0)).alias("n2"), "pairs")
