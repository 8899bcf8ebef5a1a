"""Counts, matching and fidelities."""
from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import voxels as V
from ..operators.stats import exact_quantiles
from ..sensor import DAY, DEMO
from ..session import cut_lineage
from ..sources.ingest import lighting
from ..sources.tables import events
from .q_ingest import EV, KEYS, keys, r6
from .registry import query
from .sqltext import h

CELLS = [(1, 1), (1, 3), (2, 3), (2, 1), (4, 1), (8, 1)]
CELLS_SQL = "cells(s, k) AS (VALUES " + ", ".join(f"({s}::BIGINT,{k}::BIGINT)" for s, k in CELLS) + ")"


def vox_sql(src, keys="rec, w", x="x"):
    return (f"SELECT {keys}, s, k, p, least(k-1, tr*k//86400000000) AS tb, y//s AS by, {x}//s AS bx, count(*) AS c "
            f"FROM {src}, cells GROUP BY ALL")


@query("a1_voxel_counts", f"WITH {EV}, {CELLS_SQL} {vox_sql('ev')}")
def a1(spark, d):
    return V.voxel_counts(events(spark, d), CELLS, DEMO)


@query("a2_block_counts", f"WITH {EV} SELECT rec, w, (y//4)*4 + x//4 AS block, count(*) AS n FROM ev GROUP BY ALL")
def a2(spark, d):
    return V.block_counts(events(spark, d), DEMO)


@query("a2_census", f"""WITH {EV}, {KEYS}, s(side) AS (VALUES (2::BIGINT),(4)), r(rho) AS (VALUES (0.125::DOUBLE),(0.5)),
 b AS (SELECT rec, w, side, (y//side)*(16//side) + x//side AS block, count(*) AS n FROM ev SEMI JOIN keys USING (rec, w), s
 GROUP BY ALL) SELECT rec, w, side, rho, CAST(max(greatest(1, ceil(rho*side*side))) AS BIGINT) AS threshold,
 count(*) FILTER (n >= greatest(1, ceil(rho*side*side))) AS n_active FROM b, r GROUP BY ALL""")
def a2c(spark, d):
    ev = events(spark, d)
    return V.census(ev.join(keys(ev), ["rec", "w"], "left_semi"), DEMO, (2, 4), (1 / 8, 1 / 2))


# ---- the flagship: how much of each window is predicted by repeating the one before

J1_SQL = f"""WITH {EV}, {CELLS_SQL}, v AS ({vox_sql('ev')}), t AS (SELECT rec, w, s, k, p, tb, by, bx, 0 AS c1, c AS c2
 FROM v UNION ALL SELECT rec, w+1, s, k, p, tb, by, bx, c, 0 FROM v), u AS (SELECT rec, w, s, k, p, tb, by, bx,
 sum(c1) AS c1, sum(c2) AS c2 FROM t GROUP BY ALL), mm AS (SELECT rec, w, s, k, CAST(sum(c1) AS BIGINT) AS n1,
 CAST(sum(c2) AS BIGINT) AS n2, CAST(sum(least(c1,c2)) AS BIGINT) AS m FROM u GROUP BY ALL)"""


@query("j1_static_match", J1_SQL + """ SELECT rec, w, s, k, n1, n2, m AS pairs, round(2.0*m/(n1+n2), 6) AS f1,
 CASE WHEN n1 = 0 THEN 0.0::DOUBLE ELSE round(m/n1, 6) END AS precision,
 CASE WHEN n2 = 0 THEN 0.0::DOUBLE ELSE round(m/n2, 6) END AS recall FROM mm""")
def j1(spark, d):
    ev = events(spark, d)
    m = V.scores(V.match_repeated(ev, CELLS, DEMO))
    return m.withColumns({c: r6(c) for c in ("f1", "precision", "recall")})


@query("entry_repeat_share", J1_SQL + """, g AS (SELECT rec, w, n1, n2, m, 2.0*m/(n1+n2) AS f FROM mm WHERE s = 2 AND k = 3
 AND n1 > 0 AND n2 > 0) SELECT rec, CASE WHEN rec LIKE 'day%' THEN 'day' ELSE 'night' END AS lighting, count(*) AS n_windows,
 CAST(sum(m) AS BIGINT) AS pairs, round(2.0*sum(m)/sum(n1+n2), 6) AS f_pooled, round(median(f), 6) AS f_median FROM g GROUP BY
 rec""")
def entry_query(spark, d):
    ev = events(spark, d)
    m = cut_lineage(V.scores(V.match_repeated(ev, [(2, 3)], DEMO)).filter("n1 > 0 AND n2 > 0"))   # one row per window
    g = m.groupBy("rec").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("pairs").alias("pairs"),
                             r6(F.sum("pairs") * 2.0 / F.sum(F.col("n1") + F.col("n2")), "f_pooled"))
    q = exact_quantiles(m, ["rec"], "f1", [0.5]).select("rec", r6("q0", "f_median"))
    return g.join(q, "rec").select("rec", lighting().alias("lighting"), "n_windows", "pairs", "f_pooled", "f_median")


@query("j1_moved_match", f"""WITH {EV}, sh(d) AS (SELECT * FROM range(0::BIGINT, 5)), a AS (SELECT rec, w+1 AS w, d, p,
 least(2, tr*3//86400000000) AS tb, y, x + d AS x, count(*) AS c FROM ev, sh WHERE x + d < 16 GROUP BY ALL), b AS (SELECT
 rec, w, p, least(2, tr*3//86400000000) AS tb, y, x, count(*) AS c FROM ev GROUP BY ALL) SELECT rec, w, d, CAST(sum(least(
 a.c, b.c)) AS BIGINT) AS m FROM a JOIN b USING (rec, w, p, tb, y, x) GROUP BY ALL""")
def j1m(spark, d):
    ev = events(spark, d)
    sh = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("d")
    a = ev.select((F.col("w") + 1).alias("w"), "rec", "tr", "x", "y", "p", sh).withColumn("x", F.col("x") + F.col("d"))
    a = C_with(a.filter("x < 16"), ["d"]).withColumnRenamed("c", "c1")
    b = C_with(ev, []).withColumnRenamed("c", "c2")
    return a.join(b, ["rec", "w", "p", "tb", "y", "x"]).groupBy("rec", "w", "d").agg(
        F.sum(F.least("c1", "c2")).alias("m"))


def C_with(ev, extra):
    return ev.groupBy("rec", "w", *extra, "p", C.time_bin("tr", 3, DAY).alias("tb"), "y", "x").agg(
        F.count(F.lit(1)).alias("c"))


@query("j2_pixel_pairs", f"""WITH {EV}, v AS (SELECT rec, w, x, y, p, least(7, tr*8//86400000000) AS tb, count(*) AS c FROM ev
 GROUP BY ALL) SELECT a.rec, b.w, a.x + 2 AS x, a.y, a.p, CAST(sum(least(a.c,b.c)) AS BIGINT) AS pairs FROM v a JOIN v b
 ON a.rec=b.rec AND a.w+1=b.w AND a.x+2=b.x AND a.y=b.y AND a.p=b.p AND a.tb=b.tb GROUP BY ALL""")
def j2(spark, d):
    ev = events(spark, d)
    v = V.pair_counts(V.repeated(ev).withColumn("x", F.col("x") + 2), ev, [(1, 8)], DEMO)
    v = v.filter("c1 > 0 AND c2 > 0")
    return v.groupBy("rec", "w", F.col("bx").alias("x"), F.col("by").alias("y"), "p").agg(
        F.sum(F.least("c1", "c2")).alias("pairs"))


@query("j3_in_blocks", f"""WITH {EV}, a AS (SELECT rec, w, (y//4)*4 + x//4 AS block FROM ev GROUP BY ALL HAVING count(*) >= 8)
 SELECT rec, w, count(*) AS n FROM ev SEMI JOIN a ON ev.rec = a.rec AND ev.w = a.w AND (y//4)*4 + x//4 = a.block
 GROUP BY ALL""")
def j3(spark, d):
    ev = events(spark, d).withColumn("block", C.block_id("x", "y", 4, 16))
    act = V.block_counts(ev, DEMO).filter("n >= 8").select("rec", "w", "block")
    return ev.join(act, ["rec", "w", "block"], "left_semi").groupBy("rec", "w").agg(F.count(F.lit(1)).alias("n"))


# ---- group fidelity of the static model: key window w repeated on w+1 .. w+3

A3_SQL = f"""WITH {EV}, {KEYS}, kv AS (SELECT rec, w AS g, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx,
 count(*) AS c FROM ev SEMI JOIN keys USING (rec, w) GROUP BY ALL), tv AS (SELECT k.rec, k.w AS g, ev.w - k.w AS m, p,
 least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM keys k JOIN ev ON ev.rec = k.rec AND
 ev.w BETWEEN k.w AND k.w+3 GROUP BY ALL), nk AS (SELECT rec, g, sum(c) AS n_key FROM kv GROUP BY ALL), nt AS (SELECT rec, g,
 sum(c) AS n_true FROM tv GROUP BY ALL), ma AS (SELECT rec, g, sum(least(kv.c, tv.c)) AS m FROM kv JOIN tv USING (rec, g, p,
 tb, by, bx) WHERE tv.m > 0 GROUP BY ALL), s AS (SELECT rec, g, n_key, 3*n_key AS n_rec, n_true, coalesce(m, 0) AS m FROM nk
 JOIN nt USING (rec, g) LEFT JOIN ma USING (rec, g)), f AS (SELECT *, 2.0*(n_key+m)/(n_key+n_rec+n_true) AS F FROM s)"""


@query("a3_group_fidelity", A3_SQL + """ SELECT rec, g, CAST(n_key AS BIGINT) AS n_key, CAST(n_rec AS BIGINT) AS n_rec,
 CAST(n_true AS BIGINT) AS n_true, CAST(m AS BIGINT) AS pairs, round(F,6) AS F, round(n_key/n_true,6) AS share,
 round(F/(2-F),6) AS q_eq, round((F/(2-F))/(n_key/n_true),6) AS gamma FROM f""")
def a3(spark, d):
    return a3_table(events(spark, d)).select(
        "rec", "g", "n_key", "n_rec", "n_true", "pairs", *[r6(c, c) for c in ("F", "share", "q_eq", "gamma")])


def static_groups(ev, n=4):
    """Key events repeated on the n windows of their group, and the true events of those windows: keys rec, g, m."""
    ks = keys(ev)
    m = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("m")
    cols = ("tr", "x", "y", "p", "seq")
    key = ev.join(ks, ["rec", "w"], "left_semi").select("rec", F.col("w").alias("g"), *cols, m)
    gw = ks.select("rec", F.col("w").alias("g"), m).withColumn("w", F.col("g") + F.col("m"))
    true = ev.join(gw, ["rec", "w"]).select("rec", "g", "m", *cols)
    return key, true


def a3_table(ev, n=4):
    """One row per group of the static model."""
    key, true = static_groups(ev, n)
    mt = V.match(key, true, [(2, 3)], DEMO, keys=("rec", "g", "m"))
    z = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))                # noqa: E731
    s = mt.groupBy("rec", "g").agg(z(F.col("m") == 0, "n1").alias("n_key"), z(F.col("m") > 0, "n1").alias("n_rec"),
                                   F.sum("n2").alias("n_true"), z(F.col("m") > 0, "pairs").alias("pairs"))
    return V.group_summary(s)


# ---- candidate fidelities of the repeated window

SUMS_SQL = f"""WITH {EV}, t AS (SELECT rec, w+1 AS w, tr, x, y, p, 1 AS a, 0 AS b FROM ev UNION ALL SELECT rec, w, tr, x, y,
 p, 0, 1 FROM ev), c(s,k) AS (VALUES (2::BIGINT,3::BIGINT),(8,1),(4,1)), v AS (SELECT rec, w, s, k, p,
 least(k-1, tr*k//86400000000) AS tb, y//s AS by, x//s AS bx, sum(a) AS c1, sum(b) AS c2 FROM t, c GROUP BY ALL),
 pb AS (SELECT rec, w, (by*s//4)*4 + bx*s//4 AS block, sum(CASE WHEN s=2 THEN c2 ELSE 0 END) AS bn,
 sum(CASE WHEN s=2 THEN c1 ELSE 0 END) AS bn2, sum(CASE WHEN s=2 THEN least(c1,c2) ELSE 0 END) AS bm,
 sum(CASE WHEN s=4 THEN least(c1,c2) ELSE 0 END) AS m20, sum(CASE WHEN s=8 THEN sqrt(CAST(c1*c2 AS DOUBLE)) ELSE 0 END) AS h
 FROM v GROUP BY ALL), ws AS (SELECT rec, w, sum(bn) AS N, sum(bn2) AS N2, sum(bm) AS M, sum(m20) AS M20, 2*sum(h) AS H,
 coalesce(sum(CASE WHEN bn > 3 OR bn2 > 3 THEN ln(1+bn/2.0) + ln(1+bn2/2.0) - 2*ln(1+bm/2.0) END), 0) AS D,
 coalesce(sum(CASE WHEN bn > 3 OR bn2 > 3 THEN ln(1+bn/2.0) + ln(1+bn2/2.0) END), 0) AS L FROM pb GROUP BY ALL)"""


@query("a4_fidelities", SUMS_SQL + """ SELECT rec, CAST(sum(N) AS BIGINT) AS N, CAST(sum(N2) AS BIGINT) AS N2, CAST(sum(M)
 AS BIGINT) AS M, round(2.0*sum(M)/sum(N+N2),6) AS F, round(2.0*sum(M20)/sum(N+N2),6) AS F20, round(sum(H)/sum(N+N2),6) AS FH,
 round(CASE WHEN sum(L) > 0 THEN least(1.0, greatest(0.0, 1 - sum(D)/sum(L))) ELSE 0.0 END, 6) AS Fsnr FROM ws GROUP BY rec""")
def a4(spark, d):
    ev = events(spark, d)
    s = V.window_sums(V.repeated(ev), ev, DEMO, phi=2.0, theta=3.0)
    f = V.fidelities(s, ["rec"])
    return f.select("rec", "N", "N2", "M", *[r6(c, c) for c in ("F", "F20", "FH", "Fsnr")])


@query("a4_sums_on_grid", f"""WITH {EV}, t AS (SELECT rec, w+1 AS w, tr, x, y, p, 1 AS a, 0 AS b FROM ev UNION ALL SELECT rec,
 w, tr, x, y, p, 0, 1 FROM ev), v AS (SELECT rec, w, p, least(7, tr*8//86400000000) AS tb, y, x, sum(a) AS c1, sum(b) AS c2
 FROM t GROUP BY ALL), pb AS (SELECT rec, w, (y//4)*4+x//4 AS block, sum(c2) AS bn, sum(c1) AS bn2, sum(least(c1,c2)) AS bm
 FROM v GROUP BY ALL) SELECT rec, w, CAST(sum(bn) AS BIGINT) AS N, CAST(sum(bn2) AS BIGINT) AS N2, CAST(sum(bm) AS BIGINT) AS
 M, round(coalesce(sum(CASE WHEN bn > 0 OR bn2 > 0 THEN ln(1+bn) + ln(1+bn2) - 2*ln(1+bm) END), 0),6) AS Dsnr,
 round(coalesce(sum(CASE WHEN bn > 0 OR bn2 > 0 THEN ln(1+bn) + ln(1+bn2) END), 0),6) AS Lsnr FROM pb GROUP BY ALL""")
def a4g(spark, d):
    ev = events(spark, d)
    s = V.window_sums(V.repeated(ev), ev, DEMO, grid=(1, 8), hell=(8, 1))
    return s.select("rec", "w", "N", "N2", "M", r6("Dsnr", "Dsnr"), r6("Lsnr", "Lsnr"))


# ---- differences of counts, clipping, shifted counts, round trips

@query("a16_count_errors", f"""WITH {EV}, v AS (SELECT rec, w, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx,
 count(*) AS c FROM ev GROUP BY ALL), u AS (SELECT rec, w, p, tb, by, bx, c AS c1, 0 AS c2 FROM v UNION ALL SELECT rec, w-1,
 p, tb, by, bx, 0, c FROM v), g AS (SELECT rec, w, p, tb, by, bx, sum(c1) AS c1, sum(c2) AS c2 FROM u GROUP BY ALL)
 SELECT rec, CAST(sum(c1) AS BIGINT) AS in_events, CAST(sum(c2) AS BIGINT) AS out_events, count(*) FILTER (c1 = 1) AS in_vox1,
 count(*) FILTER (c1 >= 2) AS in_vox2, CAST(coalesce(sum(c1) FILTER (c1 = 1 AND c2 = 0),0) AS BIGINT) AS removed1,
 CAST(coalesce(sum(c1) FILTER (c1 >= 2 AND c2 = 0),0) AS BIGINT) AS removed2, CAST(coalesce(sum(c1) FILTER (c1 > 0 AND c2 > 0)
 ,0) AS BIGINT) AS kept, CAST(coalesce(sum(greatest(c1-c2,0)) FILTER (c1 > 0 AND c2 > 0),0) AS BIGINT) AS lowered,
 CAST(coalesce(sum(greatest(c2-c1,0)) FILTER (c1 > 0 AND c2 > 0),0) AS BIGINT) AS raised, CAST(coalesce(sum(c2) FILTER (c1 = 0),0)
 AS BIGINT) AS added, count(*) FILTER (c1 = 0 AND c2 > 0) AS added_vox, true AS balanced FROM g GROUP BY rec""")
def a16(spark, d):
    ev = events(spark, d)
    return V.count_errors(swap(V.repeated_pair_counts(ev, [(2, 3)], DEMO, -1)), ["rec"])


def swap(pairs):
    """The true counts as input and the repeated ones as output."""
    return pairs.select("rec", F.col("c2").alias("c1"), F.col("c1").alias("c2"))


@query("a17_clipped_counts", f"""WITH {EV}, c(cmax) AS (VALUES (1::BIGINT),(2),(15)), v AS (SELECT rec, w, p, y//4 AS by, x//4
 AS bx, count(*) AS c FROM ev GROUP BY ALL), s AS (SELECT rec, cmax, sum(c) AS n, sum(least(c,cmax)) AS n2,
 sum(greatest(c-cmax,0)) AS lost, max(c) AS raw_max FROM v, c GROUP BY ALL) SELECT rec, cmax, CAST(n AS BIGINT) AS n,
 CAST(n2 AS BIGINT) AS n2, CAST(lost AS BIGINT) AS lost, raw_max, round(2.0*n2/(n+n2),6) AS F FROM s""")
def a17(spark, d):
    v = V.voxel_counts(events(spark, d), [(4, 1)], DEMO)
    cm = F.explode(F.array(*[F.lit(c).cast("bigint") for c in (1, 2, 15)])).alias("cmax")
    s = v.select("rec", "c", cm).groupBy("rec", "cmax").agg(
        F.sum("c").alias("n"), F.sum(F.least("c", "cmax")).alias("n2"),
        F.sum(F.greatest(F.col("c") - F.col("cmax"), F.lit(0))).alias("lost"), F.max("c").alias("raw_max"))
    return s.withColumn("F", r6(C.ratio0(F.col("n2") * 2.0, F.col("n") + F.col("n2"))))


@query("a18_shifted_counts", f"""WITH {EV}, v AS (SELECT rec, w, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx,
 count(*) AS c FROM ev GROUP BY ALL), life AS (SELECT rec, min(w) AS a, max(w) AS b FROM ev GROUP BY rec), u AS (SELECT rec,
 w+1 AS w, p, tb, by, bx+1 AS bx, c AS c1, 0 AS c2 FROM v UNION ALL SELECT rec, w, p, tb, by, bx, 0, c FROM v), g AS (SELECT
 rec, w, p, tb, by, bx, sum(c1) AS c1, sum(c2) AS c2 FROM u WHERE bx >= 1 AND bx < 8 GROUP BY ALL), s AS (SELECT rec,
 sum(abs(c1-c2)) AS l1, sum(c1+c2) AS tot FROM g JOIN life USING (rec) WHERE w > a AND w <= b GROUP BY rec) SELECT rec,
 CAST(l1 AS BIGINT) AS l1, CAST(tot AS BIGINT) AS tot, round(1 - l1/tot, 6) AS F FROM s""")
def a18(spark, d):
    return V.shifted_prediction(events(spark, d), 2, 2, 3, DEMO).withColumn("F", r6("F"))


@query("m23_round_trip", f"""WITH {EV}, v AS (SELECT rec, w, p, least(2, tr*3//86400000000) AS tb, y//3 AS by, x//3 AS bx,
 count(*) AS c FROM ev GROUP BY ALL), pl AS (SELECT 'start' AS placement, rec, w, (tb*86400000000+2)//3 AS tr, bx*3 AS x,
 by*3 AS y, p, c FROM v UNION ALL SELECT 'center', rec, w, (2*tb+1)*86400000000//6, least(bx*3+1, 15), least(by*3+1, 7), p, c
 FROM v) SELECT placement, rec, x, y, p, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c*(tr//1000000)) AS BIGINT) AS t_check FROM pl
 GROUP BY ALL""")
def m23(spark, d):
    v = V.voxel_counts(events(spark, d), [(3, 3)], DEMO)
    a = V.from_voxels(v, DEMO, "start").withColumn("placement", F.lit("start"))
    b = V.from_voxels(v, DEMO, "center").withColumn("placement", F.lit("center"))
    return a.unionByName(b).groupBy("placement", "rec", "x", "y", "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum(C.idiv("tr", 1_000_000)).alias("t_check"))


@query("b7_nulls", f"""WITH {EV}, u AS (SELECT 'uniform' AS kind, rec, w+1 AS w, {h(31, 'seq', '1')}*16//2147483648 AS x,
 {h(31, 'seq', '2')}*8//2147483648 AS y, {h(31, 'seq', '3')}*3//2147483648 AS tb, {h(31, 'seq', '4')}*2//2147483648 AS p
 FROM ev UNION ALL SELECT 'random_time', rec, w+1, x, y, {h(31, 'seq', '3')}*3//2147483648, p FROM ev), a AS (SELECT kind, rec,
 w, tb, y//2 AS by, x//2 AS bx, p, count(*) AS c FROM u GROUP BY ALL), b AS (SELECT rec, w, least(2, tr*3//86400000000) AS tb,
 y//2 AS by, x//2 AS bx, p, count(*) AS c FROM ev GROUP BY ALL) SELECT kind, rec, CAST(sum(least(a.c,b.c)) AS BIGINT) AS pairs
 FROM a JOIN b USING (rec, w, tb, by, bx, p) GROUP BY ALL""")
def b7(spark, d):
    ev = events(spark, d)
    draw = lambda j, n: C.idiv(C.mix(31, "seq", F.lit(j)) * n, 2147483648)
    # a tick inside the drawn third of the window
    t = C.idiv(draw(3, 3) * DAY + 2, 3)
    rep = V.repeated(ev)
    uni = rep.withColumns({"x": draw(1, 16), "y": draw(2, 8), "p": draw(4, 2), "tr": t, "kind": F.lit("uniform")})
    rnd = rep.withColumns({"tr": t, "kind": F.lit("random_time")})
    kinds = F.explode(F.array(F.lit("uniform"), F.lit("random_time"))).alias("kind")
    true = ev.select("rec", "w", "tr", "x", "y", "p", kinds)
    m = V.match(uni.unionByName(rnd), true, [(2, 3)], DEMO, keys=("kind", "rec", "w"))
    return m.groupBy("kind", "rec").agg(F.sum("pairs").alias("pairs"))


@query("a35_signed_frames", f"""WITH {EV}, f AS (SELECT rec, w, x, y, CASE WHEN p = 1 THEN 1 ELSE -1 END AS v, tr FROM ev),
 u AS (SELECT rec, w, 0::BIGINT AS f, x, y, v FROM f UNION ALL SELECT rec, w, 1 + (tr - 32400000000)//5400000000, x, y, v
 FROM f WHERE tr >= 32400000000 AND tr < 54000000000) SELECT rec, w, f, x, y, CAST(sum(v) AS BIGINT) AS v FROM u
 GROUP BY ALL""")
def a35(spark, d):
    return signed_frames(events(spark, d), DEMO)


def signed_frames(ev, sensor, n_frames=4):
    """Signed count images: frame 0 is the whole window, then n centred slices of t0 / 16."""
    step = sensor.t0 // 16
    start = sensor.t0 // 2 - n_frames * step // 2
    inside = (F.col("tr") >= start) & (F.col("tr") < start + n_frames * step)
    f = F.when(inside, F.array(F.lit(0).cast("bigint"), C.idiv(F.col("tr") - start, step) + 1)).otherwise(
        F.array(F.lit(0).cast("bigint")))
    e = ev.select("rec", "w", "x", "y", F.when(F.col("p") == 1, 1).otherwise(-1).alias("v"), F.explode(f).alias("f"))
    return e.groupBy("rec", "w", "f", "x", "y").agg(F.sum("v").alias("v"))


@query("a37_stream_profile", f"""WITH {EV}, l AS (SELECT *, lag(t_us // 3600000000) OVER (PARTITION BY rec ORDER BY seq) AS tp
 FROM ev), px AS (SELECT rec, y*16+x AS pix, count(*) AS c FROM ev GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY
 rec ORDER BY c DESC, pix) AS r FROM px), g AS (SELECT rec, count(*) AS n, (max(t_us)-min(t_us))*1e-6::DOUBLE AS dur, avg(p) AS
 on_share, sum(CASE WHEN tp = t_us // 3600000000 THEN 1 ELSE 0 END) AS n_tie FROM l GROUP BY rec), t AS (SELECT rec, count(*) AS
 active, max(c) AS cmax, sum(CASE WHEN r <= 3 THEN c ELSE 0 END) AS ctop FROM rk GROUP BY rec) SELECT rec, n,
 round(n/dur, 9) AS rate, round(on_share,6) AS on_share, round(n_tie/(n-1),6) AS tie_share, active AS active_pixels,
 round(ctop/n,6) AS top_share, round(cmax/dur,9) AS max_pixel_rate FROM g JOIN t USING (rec)""")
def a37(spark, d):
    return stream_profile(events(spark, d), DEMO, tick=3_600_000_000, top=3).select(
        "rec", "n", F.round("rate", 9).alias("rate"), r6("on_share", "on_share"), r6("tie_share", "tie_share"),
        "active_pixels", r6("top_share", "top_share"), F.round("max_pixel_rate", 9).alias("max_pixel_rate"))


def stream_profile(ev, sensor, tick=1, top=None, second=1e-6):
    """Rate, polarity share, share of events on the tick of the event before, and how uneven the pixels are.

    A tie is an event that is not the first of its tick, so it is counted by an aggregate and needs no ordering."""
    from pyspark.sql import Window
    top = top or max(1, sensor.width * sensor.height // 1000)
    ticks = ev.groupBy("rec", C.idiv("t_us", tick).alias("_k")).agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("on"),
                                                                     F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    g = ticks.groupBy("rec").agg(F.sum("c").alias("n"), F.sum("on").alias("on"), F.sum(F.col("c") - 1).alias("tie"),
                                 ((F.max("b") - F.min("a")) * F.lit(second)).alias("dur"))
    px = ev.groupBy("rec", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    rk = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("c"), "y", "x"))
    px = px.withColumn("r", rk).groupBy("rec").agg(
        F.count(F.lit(1)).alias("active_pixels"), F.max("c").alias("cmax"),
        F.sum(F.when(F.col("r") <= top, F.col("c")).otherwise(0)).alias("ctop"))
    return g.join(px, "rec").select("rec", "n", (F.col("n") / F.col("dur")).alias("rate"), (F.col("on") / F.col("n")).alias(
        "on_share"), (F.col("tie") / (F.col("n") - 1)).alias("tie_share"), "active_pixels",
        (F.col("ctop") / F.col("n")).alias("top_share"), (F.col("cmax") / F.col("dur")).alias("max_pixel_rate"))
