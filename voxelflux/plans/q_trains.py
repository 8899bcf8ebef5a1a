"""Event trains, orders, hot pixels, isolation and background."""
from pyspark.sql import Window, functions as F

from ..functions import cols as C
from ..operators import boxes as B, scans as S, trains as Tr, voxels as V, windows as Wn
from ..sensor import DAY, DEMO
from ..sources.ingest import lighting
from ..sources.tables import events
from .q_ingest import EV, KEYS, keys, r6
from .registry import query
from .sqltext import h

SPAN = KEYS + """, span AS (SELECT s.g, ev.* FROM (SELECT rec, w AS g, unnest(generate_series(greatest(0, w-3), w)) AS w
 FROM keys) s JOIN ev USING (rec, w))"""
GK = ("rec", "g")


def span_events(ev, before=3):
    return ev.join(Wn.spans(keys(ev), before), ["rec", "w"])


@query("w1_median_spacing", f"""WITH {EV}, {SPAN}, i AS (SELECT rec, g, x, y, p, t_us - lag(t_us) OVER (PARTITION BY rec, g, x, y, p
 ORDER BY t_us, seq) AS d FROM span) SELECT rec, g, x, y, p, median(d) AS tau, count(*) AS n FROM i GROUP BY ALL
 HAVING count(*) >= 2""")
def w1(spark, d):
    return Tr.median_spacing(span_events(events(spark, d)), GK).filter("n >= 2")


REG = """i AS (SELECT *, t_us - lag(t_us) OVER q AS d FROM span WINDOW q AS (PARTITION BY rec, g, x, y, p ORDER BY t_us, seq)),
 i2 AS (SELECT *, lead(d) OVER q AS dn, lag(d) OVER q AS dp FROM i WINDOW q AS (PARTITION BY rec, g, x, y, p ORDER BY t_us, seq)),
 rg AS (SELECT *, coalesce(d > 0 AND dn > 0 AND greatest(d,dn) <= 1.2::DOUBLE*least(d,dn) AND d+dn <= 86400000000, false) OR
 coalesce(d > 0 AND dp > 0 AND greatest(d,dp) <= 1.2::DOUBLE*least(d,dp) AND d+dp <= 86400000000, false) AS regular FROM i2)"""


@query("w2_regular_spacing", f"""WITH {EV}, {SPAN}, {REG} SELECT rec, g, x, y, p, median(d) AS tau, count(*) AS n_regular FROM rg
 WHERE regular GROUP BY ALL""")
def w2(spark, d):
    return Tr.regular_spacing(span_events(events(spark, d)), GK, DAY)


@query("w3_onset_delay", f"""WITH {EV}, a AS (SELECT rec, w+1 AS w, x+2 AS x, y, p, min(tr) AS fm FROM ev WHERE tr >= 5400000000
 GROUP BY ALL), b AS (SELECT rec, w, x, y, p, min(tr) AS ft FROM ev WHERE tr >= 5400000000 GROUP BY ALL) SELECT rec, w,
 CAST(greatest(-43200000000, least(43200000000, round_even(median(ft - fm), 0))) AS BIGINT) AS delta FROM a JOIN b
 USING (rec, w, x, y, p) GROUP BY ALL""")
def w3(spark, d):
    ev = events(spark, d)
    return Tr.onset_delay(V.repeated(ev).withColumn("x", F.col("x") + 2), ev, ("rec", "w"), DEMO)


@query("w4_cap", f"""WITH {EV}, b AS (SELECT *, (y//4)*4 + x//4 AS block, row_number() OVER (PARTITION BY rec, w, (y//4)*4 + x//4
 ORDER BY t_us, seq) - 1 AS r, count(*) OVER (PARTITION BY rec, w, (y//4)*4 + x//4) AS nb FROM ev), c(n) AS (VALUES (1::BIGINT),
 (2),(4),(8)), k AS (SELECT n, nb, unnest(list_transform(range(n), lambda j: ((2*j+1)*nb)//(2*n))) AS r FROM (SELECT DISTINCT
 nb FROM b), c WHERE nb > n) SELECT n, rec, count(*) AS n_kept, CAST(sum(seq) AS BIGINT) AS seq_sum FROM (SELECT n, rec, seq FROM
 b, c WHERE nb <= n UNION ALL SELECT n, rec, seq FROM b JOIN k USING (nb, r)) GROUP BY ALL""")
def w4(spark, d):
    ev = events(spark, d)
    caps = F.explode(F.array(*[F.lit(n).cast("bigint") for n in (1, 2, 4, 8)])).alias("n")
    kept = Tr.cap_per_block(ev.select("*", caps), "n", DEMO, keys=("n", "rec", "w"))
    return kept.groupBy("n", "rec").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("seq").alias("seq_sum"))


@query("w11_canonical_order", f"""WITH {EV}, t AS (SELECT rec, seq, t_us//3600000000 AS t, x, y, p FROM ev) SELECT rec, seq,
 row_number() OVER (PARTITION BY rec ORDER BY t, y, x, p, seq) - 1 AS rank_canonical, row_number() OVER (PARTITION BY rec
 ORDER BY t, {h(3, 'seq', 'x')}, seq) - 1 AS rank_shuffled FROM t""")
def w11(spark, d):
    t = events(spark, d).select("rec", "seq", C.idiv("t_us", 3_600_000_000).alias("t"), "x", "y", "p").withColumn(
        "_chunk", C.idiv("t", 24)).withColumn("_h", C.mix(3, "seq", "x"))
    a = S.ranked(t, ["rec"], ["t", "y", "x", "p", "seq"], "_chunk", "rank_canonical")
    return S.ranked(a, ["rec"], ["t", "_h", "seq"], "_chunk", "rank_shuffled").select(
        "rec", "seq", "rank_canonical", "rank_shuffled")


@query("w13_surface", f"""WITH {EV}, {SPAN} SELECT rec, g, x, y, p, max(t_us) AS t_last FROM span WHERE w >= g - 1 GROUP BY ALL""")
def w13(spark, d):
    return Tr.surface(span_events(events(spark, d), 1), GK)


@query("w14_every_kth", f"""WITH {EV}, r AS (SELECT rec, w, seq, row_number() OVER (PARTITION BY rec, w ORDER BY t_us, seq) - 1 AS
 rk, count(*) OVER (PARTITION BY rec, w) AS n FROM ev) SELECT rec, w, seq, rk FROM r WHERE rk % CAST(ceil(n/20.0) AS BIGINT) = 0""")
def w14(spark, d):
    ev = events(spark, d).withColumn("_chunk", C.idiv("tr", DAY // 8))
    return Tr.every_kth(ev, ["rec", "w"], ["t_us", "seq"], "_chunk", 20).select("rec", "w", "seq", "rk")


@query("w14_first_per_stratum", f"""WITH {EV}, r AS (SELECT DISTINCT rec, CASE WHEN rec LIKE 'day%' THEN 'day' ELSE 'night' END AS
 stratum FROM ev) SELECT stratum, rec, rk FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rec) AS rk FROM r)
 WHERE rk <= 5""")
def w14b(spark, d):
    r = events(spark, d).select("rec").distinct().withColumn("stratum", lighting())
    rk = F.row_number().over(Window.partitionBy("stratum").orderBy("rec")).cast("bigint")
    return r.withColumn("rk", rk).filter("rk <= 5")


HOT = """hpx AS (SELECT rec, g, x, y, count(*) AS c FROM span GROUP BY ALL), hmed AS (SELECT rec, g, median(c) AS med FROM hpx
 GROUP BY ALL), hot AS (SELECT rec, g, x, y, c FROM hpx JOIN hmed USING (rec, g) WHERE c >= greatest(6.0, 3.0*med))"""


def hot(span):
    return Tr.hot_pixels(span, GK, 6, 3.0)


@query("a5_hot_pixels", f"WITH {EV}, {SPAN}, {HOT} SELECT rec, g, x, y, c FROM hot")
def a5(spark, d):
    return hot(span_events(events(spark, d)))


@query("a5_without_hot", f"""WITH {EV}, {SPAN}, {HOT} SELECT rec, g, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM span
 ANTI JOIN hot USING (rec, g, x, y) GROUP BY ALL""")
def a5b(spark, d):
    sp = span_events(events(spark, d))
    return Tr.without_hot(sp, hot(sp), GK).groupBy("rec", "g").agg(F.count(F.lit(1)).alias("n"),
                                                                   F.sum("seq").alias("seq_sum"))


BSP = """bi AS (SELECT rec, g, x, y, p, t_us - lag(t_us) OVER (PARTITION BY rec, g, x, y, p ORDER BY t_us, seq) AS d FROM span),
 bpx AS (SELECT rec, g, x, y, p, median(d) AS tau FROM bi GROUP BY ALL), bsp AS (SELECT rec, g, (y//4)*4 + x//4 AS block,
 CASE WHEN count(tau) >= 2 THEN median(tau) END AS tau, count(tau) AS n_pix, count(tau)/count(*) AS covered FROM bpx
 GROUP BY ALL)"""


@query("a7_block_spacing", f"""WITH {EV}, {SPAN}, {BSP} SELECT rec, g, block, tau, n_pix, round(covered,6) AS covered FROM bsp""")
def a7(spark, d):
    return Tr.block_spacing(span_events(events(spark, d)), GK, DEMO, min_pixels=2).withColumn("covered", r6("covered"))


@query("a8_both_polarities", f"""WITH {EV}, px AS (SELECT rec, w, x, y, min(p) <> max(p) AS bp FROM ev GROUP BY ALL) SELECT rec, w,
 (y//4)*4 + x//4 AS block, count(*) AS n_pixels, round(avg(CASE WHEN bp THEN 1 ELSE 0 END),6) AS both_share FROM px
 GROUP BY ALL""")
def a8(spark, d):
    return Tr.both_polarities(events(spark, d), ("rec", "w"), DEMO).withColumn("both_share", r6("both_share"))


@query("j13_lonely", f"""WITH {EV} SELECT rec, count(*) AS n_lonely, CAST(sum(seq) AS BIGINT) AS seq_sum FROM ev a WHERE NOT EXISTS
 (SELECT 1 FROM ev b WHERE a.rec = b.rec AND a.p = b.p AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND (a.x <> b.x OR
 a.y <> b.y) AND abs(a.t_us - b.t_us) <= 14400000000) GROUP BY rec""")
def j13(spark, d):
    return Tr.lonely(events(spark, d), ("rec",), DEMO, 14_400_000_000).groupBy("rec").agg(
        F.count(F.lit(1)).alias("n_lonely"), F.sum("seq").alias("seq_sum"))


BG_TAU = 10_800_000_000
A6_SQL = f"""WITH {EV}, {KEYS}, span AS (SELECT s.g, ev.* FROM (SELECT rec, w AS g, unnest(generate_series(w-1, w)) AS w FROM keys) s
 JOIN ev USING (rec, w)), {HOT}, sp AS (SELECT *, t_us - (g-1)*86400000000 AS t FROM span ANTI JOIN hot USING (rec, g, x, y)),
 iso AS (SELECT rec, g, count(*) AS n_iso FROM sp a WHERE t >= {BG_TAU} AND t < 172800000000 - {BG_TAU} AND NOT EXISTS (SELECT 1
 FROM sp b WHERE a.rec=b.rec AND a.g=b.g AND a.p=b.p AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND (a.x<>b.x OR a.y<>b.y) AND
 abs(a.t-b.t) <= {BG_TAU}) GROUP BY ALL), nh AS (SELECT rec, g, count(*) AS n_hot FROM hot GROUP BY ALL), bl AS (SELECT rec, g,
 (y//4)*4+x//4 AS block, count(*) AS c FROM sp GROUP BY ALL), md AS (SELECT k.rec, k.w AS g, median(coalesce(c,0)) AS bmed,
 CAST(sum(coalesce(c,0)) AS BIGINT) AS n FROM (SELECT * FROM keys, range(8) b(block)) k LEFT JOIN bl ON bl.rec=k.rec AND
 bl.g=k.w AND bl.block=k.block GROUP BY ALL), q AS (SELECT rec, g, n, coalesce(n_hot,0) AS n_hot, coalesce(n_iso,0) AS n_iso,
 bmed/32.0 AS beta_med, coalesce(n_iso,0)/((128-coalesce(n_hot,0))*1.75) AS r FROM md LEFT JOIN iso USING (rec,g) LEFT JOIN nh
 USING (rec,g)), z AS (SELECT *, 1.0::DOUBLE AS cap FROM q), z2 AS (SELECT *, r >= cap/2.718281828459045 AS saturated,
 CASE WHEN beta_med > cap THEN -1 ELSE 0 END AS branch FROM z), z3 AS (SELECT *, CASE WHEN saturated THEN cap WHEN r > 0 THEN
 list_reduce(list_prepend(CASE WHEN branch=-1 THEN (1-ln(r/cap))*4*cap ELSE r END, list_transform(range(60), lambda i:
 0.0::DOUBLE)), lambda b, i: b - (ln(b) - b/cap - ln(r))/(1.0/b - 1.0/cap)) ELSE 0.0 END AS beta_iso FROM z2), z4 AS (SELECT *,
 least(beta_iso, beta_med) AS beta FROM z3), z5 AS (SELECT *, greatest(1.0, beta*16) AS phi FROM z4)
 SELECT rec, g, n, n_hot, n_iso, round(beta,6) AS beta, round(beta_iso,6) AS beta_iso, round(beta_med,6) AS beta_med,
 saturated, CAST(branch AS INTEGER) AS branch, round(phi,6) AS phi, (SELECT CAST(min(k) AS DOUBLE) FROM (SELECT k, sum(exp(-phi + k*ln(phi) -
 lgamma(k+1))) OVER (ORDER BY k) AS cdf FROM range(200) t(k)) WHERE 1 - cdf <= 1e-3::DOUBLE) AS theta FROM z5"""


@query("a6_background", A6_SQL)
def a6(spark, d):
    ev = events(spark, d)
    sp = span_events(ev, 1)
    bounds = keys(ev).select("rec", F.col("w").alias("g"), ((F.col("w") - 1) * DAY).alias("lo"),
                             ((F.col("w") + 1) * DAY).alias("hi"))
    b = Tr.background(sp, GK, bounds, DEMO, BG_TAU, 6, 3.0, tick=1.0 / DAY)
    return b.select("rec", "g", "n", "n_hot", "n_iso", r6("beta", "beta"), r6("beta_iso", "beta_iso"),
                    r6("beta_med", "beta_med"), "saturated", "branch", r6("phi", "phi"), "theta")


@query("t1_fitting_order", f"""WITH {EV}, b AS (SELECT rec, w, (y//4)*4+x//4 AS block, count(*) AS n FROM ev GROUP BY ALL) SELECT rec,
 w, block, n, row_number() OVER (PARTITION BY rec, w ORDER BY n DESC, block) AS rk FROM b""")
def t1(spark, d):
    return fitting_order(V.block_counts(events(spark, d), DEMO))


def fitting_order(blocks, key_cols=("rec", "w")):
    """Blocks of one window by falling count, then index: at most one row per block of the sensor in a window."""
    return blocks.withColumn("rk", F.row_number().over(Window.partitionBy(*key_cols).orderBy(F.desc("n"), "block")).cast(
        "bigint"))


@query("t2_top_squares", f"""WITH {EV}, s AS (SELECT rec, w, (y//3)*5 + x//3 AS square, count(*) AS n FROM ev WHERE x < 15 AND y < 6
 GROUP BY ALL HAVING count(*) >= 4), r AS (SELECT *, row_number() OVER (PARTITION BY rec, w ORDER BY n DESC, square) AS rk FROM
 s) SELECT rec, w, square, n, rk FROM r WHERE rk <= 3""")
def t2(spark, d):
    return B.top_squares(events(spark, d), 3, DEMO, least=4, most=3).withColumn("rk", F.col("rk").cast("bigint"))


@query("t3_densest_crop", f"""WITH {EV}, o AS (SELECT ix*2 AS x0, iy*2 AS y0 FROM range(0::BIGINT,6) a(ix), range(0::BIGINT,3) b(iy)),
 s AS (SELECT rec, w, x0, y0, count(*) AS n FROM ev JOIN o ON x >= x0 AND x < x0+6 AND y >= y0 AND y < y0+4 GROUP BY ALL) SELECT
 rec, w, x0, y0, n FROM (SELECT *, row_number() OVER (PARTITION BY rec, w ORDER BY n DESC, y0, x0) AS rk FROM s) WHERE rk = 1""")
def t3(spark, d):
    return B.densest_crop(events(spark, d), 6, 4, 2, DEMO)


@query("t7_split", f"""WITH {EV}, r AS (SELECT DISTINCT rec, CASE WHEN rec LIKE 'day%' THEN 'day' ELSE 'night' END AS stratum FROM ev),
 k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rec) - 1 AS pos FROM r) SELECT rec, stratum, pos,
 CASE WHEN pos % 10 = 0 AND pos <= 50 THEN 'tuning' ELSE 'reporting' END AS part FROM k""")
def t7(spark, d):
    r = events(spark, d).select("rec").distinct().withColumn("stratum", lighting())
    pos = (F.row_number().over(Window.partitionBy("stratum").orderBy("rec")) - 1).cast("bigint")
    tune = (F.col("pos") % 10 == 0) & (F.col("pos") <= 50)
    return r.withColumn("pos", pos).withColumn("part", F.when(tune, "tuning").otherwise("reporting"))


@query("t8_common_and_missing", f"""WITH {EV}, {KEYS}, v AS (SELECT DISTINCT rec, w, p, least(2, tr*3//86400000000) AS tb, y//2 AS by,
 x//2 AS bx FROM ev), c AS (SELECT rec, w, p, tb, by, bx FROM v INTERSECT SELECT rec, w+1, p, tb, by, bx FROM v), q AS (SELECT rec,
 'common_voxels' AS kind, count(*) AS n FROM c GROUP BY rec), e AS (SELECT rec, w FROM keys EXCEPT ALL SELECT rec, w FROM (SELECT
 rec, w FROM ev GROUP BY ALL HAVING count(*) >= 65)) SELECT * FROM q UNION ALL SELECT rec, 'missing_groups', count(*) FROM e
 GROUP BY rec""")
def t8(spark, d):
    ev = events(spark, d)
    v = V.voxel_counts(ev, [(2, 3)], DEMO).select("rec", "w", *V.VOXEL)
    com = v.intersect(v.withColumn("w", F.col("w") + 1)).groupBy("rec").agg(F.lit("common_voxels").alias("kind"),
                                                                            F.count(F.lit(1)).alias("n"))
    full = ev.groupBy("rec", "w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 65").select("rec", "w")
    miss = keys(ev).exceptAll(full).groupBy("rec").agg(F.lit("missing_groups").alias("kind"), F.count(F.lit(1)).alias("n"))
    return com.unionByName(miss)
