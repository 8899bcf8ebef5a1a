"""Aggregation over recordings: strata, gates, bootstrap intervals, pooled ratios, rank correlation, decisions.

Rows here are windows, instants or recordings, never events. Bootstrap multiplicities are a hash of (recording, replicate), so a
recomputed task draws the same sample.
"""
import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cols import idiv, ratio
from ..session import cut_lineage
from .scans import ranked, running

BOOT_SEED, BOOT_N = 20261016, 2000


def strata_levels(rows: DataFrame) -> DataFrame:
    """Each row once per stratum it belongs to: group, speed class and overlap, each with 'all', and the merged 20-300."""
    sp = F.col("speed_bin")
    names = F.when(sp == 0, "0-20").when(sp == 1, "20-100").when(sp == 2, "100-300").when(sp == 3, "300-inf")
    speed = F.array_compact(F.array(F.lit("all"), names, F.when(sp.isin(1, 2), F.lit("20-300"))))
    over = F.array_compact(F.array(F.lit("all"), F.when(F.col("overlap") == 0, F.lit("isolated")).when(
        F.col("overlap") == 1, F.lit("overlapping"))))
    r = rows.withColumn("group_level", F.explode(F.array(F.lit("all"), F.col("grp"))))
    return r.withColumn("speed_level", F.explode(speed)).withColumn("overlap_level", F.explode(over))


SPLITS = 64


def exact_quantiles(rows: DataFrame, keys, value, qs) -> DataFrame:
    """(keys, n, q0, q1, ..): exact interpolated quantiles of groups of any size.

    A group is never gathered: equal values are counted first, the running count is taken in two phases over value chunks,
    and each order statistic is the least value whose running count passes its rank - a plain aggregate. Chunks end at
    approximate percentiles of the group's own distinct values, so they are even however narrow its range is. NULL and NaN do not
    enter; infinities are values like others. No join goes through the driver: there may be as many groups as rows."""
    keys = list(keys)
    v = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    c = cut_lineage(v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))       # the rows are read once
    cuts = F.percentile_approx("_v", [i / SPLITS for i in range(1, SPLITS)], 10 * SPLITS)
    n = c.groupBy(*keys).agg(F.sum("_c").alias("n"), cuts.alias("_cuts"))
    chunked = c.join(n.hint("merge"), keys).withColumn("_ck", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    r = running(chunked, [*keys, "n"], ["_v"], "_ck", "_c", F.sum, "_cum")
    at = {}
    for i, q in enumerate(qs):
        pos = (F.col("n") - 1) * F.lit(float(q))
        for e, f in (("l", F.floor), ("h", F.ceil)):
            at[f"_{e}{i}"] = F.min(F.when(F.col("_cum") > f(pos), F.col("_v")))
    g = r.groupBy(*keys, "n").agg(*[a.alias(k) for k, a in at.items()])
    out = []
    for i, q in enumerate(qs):
        pos = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_l{i}"), F.col(f"_h{i}")
        between = F.when((lo == hi) | (pos == F.floor(pos)), lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos)))
        out.append(between.alias(f"q{i}"))
    return g.select(*keys, "n", *out)


def medians(rows: DataFrame, keys, columns) -> DataFrame:
    """(keys, columns): the exact median of each column per key, all columns in one pass; NULL without a value."""
    keys = list(keys)
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
                       .alias("_e")).select(*keys, F.col("_e.c").alias("_col"), F.col("_e.v").alias("_val"))
    q = exact_quantiles(long, [*keys, "_col"], "_val", [0.5])
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("_col") == c, F.col("q0"))).alias(c) for c in columns])


def per_recording(rows: DataFrame, keys, medians_of=(), shares=()) -> DataFrame:
    """Row counts, medians and shares per key. A recording may hold most rows, so medians use the distributed form."""
    a = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in shares])
    return a.join(medians(rows, keys, medians_of).hint("merge"), list(keys), "left") if medians_of else a


def multiplicity(seed, rec, b):
    """How often a recording is drawn in replicate `b`: a Poisson number of mean 1 by a hash of (seed, recording, replicate), so that no replicate needs to
    know the other recordings."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(rec), F.col(b).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return sum(((u >= t).cast("bigint") for t in POISSON[1:]), (u >= POISSON[0]).cast("bigint"))


def poisson_cuts(bits=32):
    """Distribution function of a Poisson number of mean 1 at 0, 1, .., as numbers of `bits` bits; ends where the next would be all of them."""
    out, total, term, k = [], 0.0, math.exp(-1.0), 0
    while True:
        total += term
        cut = math.floor(total * (1 << bits))
        if cut >= (1 << bits) - 1:
            return out
        out.append(cut)
        k += 1
        term /= k


POISSON, PART, RANKS = poisson_cuts(), 50, 1024


def _parts(n_boot):
    return F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // PART))).alias("_part")


def replicated(rows: DataFrame, n_boot=BOOT_N, seed=BOOT_SEED) -> DataFrame:
    """`rows` (with `rec` and `_part`, a number of PART successive replicates) once per replicate `b` that draws the recording, with its multiplicity `m`."""
    r = rows.withColumn("b", F.explode(F.sequence(F.col("_part") * PART, F.least(F.lit(n_boot), (F.col("_part") + 1) * PART) - 1)))
    return r.withColumn("m", multiplicity(seed, "rec", "b")).filter("m > 0")


def spread(rows: DataFrame, n_boot=BOOT_N) -> DataFrame:
    """`rows` once per part of the replicates, dealt over all tasks before they multiply."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("*", _parts(n_boot)).repartition(n, "rec", "_part")


def _ci(v):
    return F.percentile(v, F.lit(0.025)).alias("lo"), F.percentile(v, F.lit(0.975)).alias("hi")


def boot_median(per_rec: DataFrame, keys, value, gate=None, n_boot=BOOT_N, seed=BOOT_SEED) -> DataFrame:
    """Median over recordings with a 95 % interval; recordings below the gate and NULL values do not enter. `per_rec` has one row per recording and key.

    No task holds a stratum: recordings are ranked once per key and cut into runs of RANKS; each replicate adds up the multiplicities of each run (combined
    on the map side), which names the run that holds its median, and only that run is looked at. An empty replicate does not count."""
    keys = list(keys)
    r = per_rec.filter(F.col(value).isNotNull())
    if gate is not None:
        r = r.filter(gate)
    r = cut_lineage(r.select(*keys, "rec", F.col(value).cast("double").alias("_v")))
    cuts = r.groupBy(*keys).agg(F.percentile_approx("_v", [i / SPLITS for i in range(1, SPLITS)], 10 * SPLITS).alias("_cuts"))
    r = r.join(cuts, keys).withColumn("_ck", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    r = ranked(r, keys, ["_v", "rec"], "_ck", "_rk", "n_recordings").drop("_ck")
    r = cut_lineage(r.withColumn("_run", idiv("_rk", RANKS)))
    low, high = idiv(F.col("n_recordings") - 1, 2), idiv("n_recordings", 2)
    mid = r.filter(F.col("_rk").isin(low, high)).groupBy(*keys).agg(F.avg("_v").alias("median"), F.first("n_recordings").alias("n_recordings"))
    w = replicated(spread(r.select(*keys, "rec", "_run"), n_boot), n_boot, seed).groupBy(*keys, "b", "_run").agg(F.sum("m").alias("_w"))
    of = Window.partitionBy(*keys, "b")
    w = w.withColumns({"_before": F.sum("_w").over(of.orderBy("_run")) - F.col("_w"), "_n": F.sum("_w").over(of)})
    w = w.withColumn("_at", F.explode(F.array_distinct(F.array(idiv(F.col("_n") - 1, 2), idiv("_n", 2)))))
    w = cut_lineage(w.filter("_before <= _at AND _at < _before + _w").select(*keys, "b", "_run", "_before", "_at", idiv("b", PART).cast("int").alias("_part")))
    some = r.join(w.select(*keys, "_run").distinct(), [*keys, "_run"], "left_semi").select(*keys, "rec", "_v", "_rk", "_run", _parts(n_boot))
    j = some.join(w, [*keys, "_run", "_part"]).withColumn("m", multiplicity(seed, "rec", "b"))
    cum = F.sum("m").over(Window.partitionBy(*keys, "b", "_at").orderBy("_rk"))
    b = j.withColumn("_cum", F.col("_before") + cum).groupBy(*keys, "b", "_at").agg(F.min(F.when(F.col("_cum") > F.col("_at"), F.col("_v"))).alias("_v"))
    b = b.groupBy(*keys, "b").agg(F.avg("_v").alias("_m"))
    return mid.join(b.groupBy(*keys).agg(*_ci("_m")), keys, "left")


def boot_ratio(per_rec: DataFrame, keys, num, den, n_boot=BOOT_N, seed=BOOT_SEED) -> DataFrame:
    """Pooled sum(num) / sum(den) with a 95 % interval over resampled recordings: one weighted sum per replicate. `per_rec` has one row per recording and
    key (recordings without a share have den 0 and count); a replicate with den 0 does not count."""
    keys = list(keys)
    p = cut_lineage(per_rec.select(*keys, "rec", F.col(num).alias("_num"), F.col(den).alias("_den")))
    mid = p.groupBy(*keys).agg(ratio(F.sum("_num").cast("double"), F.sum("_den")).alias("value"), F.count(F.lit(1)).alias("n_recordings"),
                               F.sum("_den").alias("n"))
    b = replicated(spread(p, n_boot), n_boot, seed).groupBy(*keys, "b").agg(
        ratio(F.sum(F.col("m") * F.col("_num")).cast("double"), F.sum(F.col("m") * F.col("_den"))).alias("_r"))
    return mid.join(b.groupBy(*keys).agg(*_ci("_r")), keys, "left")


def rayleigh(blocks: DataFrame, keys, m_min=5) -> DataFrame:
    """Mean of (C^2 + S^2) / n over blocks with n >= m_min, and the share above ln 100. Columns n, c, s."""
    z = (F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")
    return blocks.filter(F.col("n") >= m_min).withColumn("_z", z).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("pixels"), F.avg("_z").alias("mean_Z"),
        F.avg((F.col("_z") > 4.605170185988092).cast("double")).alias("share_above"))


def kendall_tau_b(rows: DataFrame, keys, item, a, b) -> DataFrame:
    """Kendall tau-b over the items of a key (a handful of schemes each)."""
    r = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    l = r.select(*keys, F.col(item).alias("_i"), F.col(a).alias("_a1"), F.col(b).alias("_b1"))
    o = r.select(*keys, F.col(item).alias("_j"), F.col(a).alias("_a2"), F.col(b).alias("_b2"))
    p = l.join(o, list(keys)).filter("_i < _j")
    sa, sb = F.signum(F.col("_a1") - F.col("_a2")), F.signum(F.col("_b1") - F.col("_b2"))
    g = p.groupBy(*keys).agg(F.sum(sa * sb).alias("_s"), F.sum(F.abs(sa)).alias("_na"), F.sum(F.abs(sb)).alias("_nb"))
    return g.select(*keys, ratio(F.col("_s"), F.sqrt(F.col("_na") * F.col("_nb"))).alias("tau_b"))


def classed_quantiles(rows: DataFrame, keys, value, qs) -> DataFrame:
    q = exact_quantiles(rows, keys, value, qs)
    return q.select(*keys, F.col("n").alias("n_rows"), *[F.col(f"q{i}").alias(f"q{int(round(x * 100)):02d}") for i, x in enumerate(qs)])


def edges_class(c, edges):
    """Index of [edges[i], edges[i+1]), NULL outside; the last edge may be None for infinity."""
    out = None
    for i in range(len(edges) - 1):
        cond = F.col(c) >= edges[i]
        if edges[i + 1] is not None:
            cond = cond & (F.col(c) < edges[i + 1])
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def decision(day, night):
    d, n = F.col(day), F.col(night)
    return F.when(d.isNull() | n.isNull(), "UNDEFINED").when((d >= 3) & (n >= 3), "GO").when((d < 1) & (n < 1), "NO-GO") \
        .otherwise("INTERMEDIATE")


def reading_share(lo, hi):
    return F.when(F.col(hi) < 0.1, "independent").when(F.col(lo) > 0.3, "correlated").otherwise("partial")


def reading_lock(lo, hi):
    return F.when(F.col(hi) < 2, "no lock within blocks").when(F.col(lo) > 5, "lock within blocks").otherwise("partial")


def nearest_to_median(rows: DataFrame, keys, value, ties) -> DataFrame:
    """Row of each key closest to the median of the key; ties by the given columns."""
    med = medians(rows, keys, [value]).withColumnRenamed(value, "_med")
    r = rows.join(med, list(keys))
    best = F.min_by(F.struct(*ties, value), F.struct(F.abs(F.col(value) - F.col("_med")), *ties))
    return r.groupBy(*keys).agg(best.alias("_b"), F.first("_med").alias("median")).select(*keys, "_b.*", "median")


def compare_stages(a: DataFrame, b: DataFrame, keys, columns) -> DataFrame:
    """Rows only left, only right, common, and unequal per column, of two stages of one computation."""
    l = a.select(*keys, F.struct(*columns).alias("_l"))
    r = b.select(*keys, F.struct(*columns).alias("_r"))
    j = l.join(r, list(keys), "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
                 F.count_if(both).alias("common"),
                 *[F.count_if(both & ~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))).alias("unequal_" + c) for c in columns])


def differing(a: DataFrame, b: DataFrame, keys, columns) -> DataFrame:
    """(keys, n_left, n_right, violations): rows of two tables per key, and how many are left over when equal rows are struck out one against one. One
    aggregation of both, combined on the map side, so a key with most rows is no hot task; NULLs are equal."""
    cols = [*keys, *columns]
    u = a.select(*cols, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(b.select(*cols, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    g = u.groupBy(*cols).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return g.groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"), F.sum(F.abs(F.col("_l") - F.col("_r"))).alias("violations"))
