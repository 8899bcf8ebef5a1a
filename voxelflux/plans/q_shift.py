"""Votes, shifts, delays, claims, causal prediction and phase."""
from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import causal as Ca, codec as K, shift as S, stats as St, trains as Tr, voxels as V
from ..sensor import DAY, DEMO
from ..sources.tables import events
from .q_ingest import EV, KEYS, bin_sql, keys, r6
from .q_trains import fitting_order
from .registry import query
from .sqltext import h

R, N_MIN = 4, 4
GRIDS = list(Ca.GRIDS)
DELAYS = tuple(j * (DAY // 64) for j in range(-32, 33))
FLICK = (DAY / 24.0, DAY / 12.0)


def flick(tau):
    return C.is_flicker(tau, FLICK, 0.1)


FLICK_SQL = "coalesce(abs({t} - 3600000000.0::DOUBLE) <= 0.1::DOUBLE*3600000000.0::DOUBLE OR abs({t} - 7200000000.0::DOUBLE) <= 0.1::DOUBLE*7200000000.0::DOUBLE, false)"

EG = f"""{KEYS}, rl AS (SELECT rec, w AS g, unnest(generate_series(-least(w,3), 1)) AS rel FROM keys), eg0 AS (SELECT rl.g, rl.rel, ev.* FROM rl JOIN
 ev ON ev.rec = rl.rec AND ev.w = rl.g + rl.rel), hpx AS (SELECT rec, g, x, y, count(*) AS c FROM eg0 WHERE rel <= 0 GROUP BY ALL), hmed AS (SELECT
 rec, g, median(c) AS med FROM hpx GROUP BY ALL), hot AS (SELECT rec, g, x, y FROM hpx JOIN hmed USING (rec, g) WHERE c >= greatest(12.0, 6.0*med)),
 eg AS (SELECT *, (y//4)*4 + x//4 AS block FROM eg0 ANTI JOIN hot USING (rec, g, x, y)), cand AS (SELECT rec, g, block, count(*) AS n_true FROM eg
 WHERE rel = 1 GROUP BY ALL HAVING count(*) >= {N_MIN}), tgt AS (SELECT eg.* FROM eg SEMI JOIN cand USING (rec, g, block) WHERE rel = 0), pc AS (SELECT
 rec, g, x, y, p, count(*) AS c FROM eg WHERE rel = -1 GROUP BY ALL), tc AS (SELECT rec, g, block, x, y, p, count(*) AS c FROM tgt GROUP BY ALL), vt AS
 (SELECT a.rec, a.g, b.block, b.x-a.x AS dx, b.y-a.y AS dy, CAST(sum(least(a.c,b.c)) AS BIGINT) AS score FROM pc a JOIN tc b ON a.rec=b.rec AND a.g=b.g
 AND a.p=b.p AND abs(b.x-a.x) <= {R} AND abs(b.y-a.y) <= {R} GROUP BY ALL)"""

BEST = """bsh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec, g, block ORDER BY score DESC, abs(dx)+abs(dy), dy, dx) AS rk FROM vt) WHERE
 rk = 1), sh AS (SELECT cand.rec, cand.g, cand.block, coalesce(dx,0) AS dx, coalesce(dy,0) AS dy, coalesce(score,0) AS pairs FROM cand LEFT JOIN bsh
 USING (rec, g, block))"""


def moved_sql(src, shifts, dt="0"):
    return (f"(SELECT e.rec, e.g, s.block, e.seq, e.tr + ({dt}) AS tr, e.x + s.dx AS x, e.y + s.dy AS y, e.p, s.dx, s.dy FROM {src} e JOIN {shifts} s ON "
            f"s.rec = e.rec AND s.g = e.g AND ((e.y+s.dy)//4)*4 + (e.x+s.dx)//4 = s.block AND e.x+s.dx >= 0 AND e.x+s.dx < 16 AND e.y+s.dy >= 0 AND "
            f"e.y+s.dy < 8 WHERE e.tr + ({dt}) >= 0 AND e.tr + ({dt}) < 86400000000)")


def groups_of(spark, d):
    ev = events(spark, d)
    return Ca.clean_groups(ev, keys(ev), 12, 6.0)


def setup(spark, d):
    eg = groups_of(spark, d)
    return eg, Ca.candidate_blocks(eg, DEMO, N_MIN)


@query("j14_neighbourhood", f"""WITH {EV}, {EG}, b AS (SELECT rec, g, block, unnest(range(-1,2)) AS i FROM cand), b2 AS (SELECT *, unnest(range(-1,2)) AS j FROM b),
 b3 AS (SELECT rec, g, block, block%4 + i AS sx, block//4 + j AS sy FROM b2) SELECT b3.rec, b3.g, b3.block, count(*) AS n, CAST(sum(seq) AS BIGINT) AS
 seq_sum FROM b3 JOIN eg ON eg.rec=b3.rec AND eg.g=b3.g AND eg.x//4 = sx AND eg.y//4 = sy AND eg.rel = 0 GROUP BY ALL""")
def j14(spark, d):
    eg, cand = setup(spark, d)
    n = S.neighbourhood(eg.filter("rel = 0"), cand.select("rec", "g", "block"), ["rec", "g"], 1, DEMO)
    return n.groupBy("rec", "g", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query("j15_block_shift", f"WITH {EV}, {EG}, {BEST} SELECT rec, g, block, dx, dy, pairs FROM sh")
def j15(spark, d):
    eg, cand = setup(spark, d)
    sc = S.votes(eg.filter("rel = -1"), Ca.in_blocks(eg.filter("rel = 0"), cand, DEMO), ["rec", "g"], R, DEMO)
    b = S.best_shift(sc, ["rec", "g", "block"])
    z = F.lit(0)
    return cand.join(b, ["rec", "g", "block"], "left").select(
        "rec", "g", "block", F.coalesce("dx", z).alias("dx"), F.coalesce("dy", z).alias("dy"), F.coalesce("score", z).alias("pairs"))


DELAY = f"""dl(delta) AS (VALUES {', '.join(f'({v}::BIGINT)' for v in DELAYS)}), mvd AS (SELECT m.rec, m.g, m.block, delta, x, y, p, least(31, (tr+delta)*32
 //86400000000) AS tb, count(*) AS c FROM {moved_sql("(SELECT * FROM eg WHERE rel = -1)", 'sh')} m, dl WHERE tr+delta >= 0 AND tr+delta < 86400000000
 GROUP BY ALL), tv AS (SELECT rec, g, x, y, p, least(31, tr*32//86400000000) AS tb, count(*) AS c FROM tgt GROUP BY ALL), ds AS (SELECT rec, g, block,
 delta, sum(least(mvd.c, tv.c)) AS n FROM mvd JOIN tv USING (rec, g, x, y, p, tb) GROUP BY ALL), dbest AS (SELECT rec, g, block, delta FROM (SELECT *,
 row_number() OVER (PARTITION BY rec, g, block ORDER BY n DESC, abs(delta), delta) AS rk FROM ds) WHERE rk = 1), mot AS (SELECT sh.*, coalesce(delta,0)
 AS delta FROM sh LEFT JOIN dbest USING (rec, g, block))"""


@query("j16_best_delay", f"WITH {EV}, {EG}, {BEST}, {DELAY} SELECT rec, g, block, dx, dy, delta FROM mot")
def j16(spark, d):
    eg, cand = setup(spark, d)
    return Ca.fit_motion(eg, cand, DEMO, R, "best", DELAYS, 32).select("rec", "g", "block", "dx", "dy", "delta")


def pred_sql(mot, seed):
    null = f"CAST(floor({h(seed, 'seq', 'block')}/2147483648.0::DOUBLE*86400000000) AS BIGINT)"
    return f"""pr0 AS {moved_sql("(SELECT * FROM eg WHERE rel = 0)", mot, 's.delta')}, ent AS (SELECT rec, g, block FROM pr0 GROUP BY ALL HAVING
 count(*) >= {N_MIN}), prd AS (SELECT pr0.* FROM pr0 SEMI JOIN ent USING (rec, g, block)), tru AS (SELECT eg.rec, eg.g, eg.block, seq, tr, x, y, p FROM
 eg SEMI JOIN ent USING (rec, g, block) WHERE rel = 1), nul AS (SELECT * REPLACE ({null} AS tr) FROM prd), sp AS (SELECT {mot}.rec, {mot}.g,
 {mot}.block, dx, dy, CASE WHEN greatest(abs(dx),abs(dy)) <= 1 THEN 0 WHEN greatest(abs(dx),abs(dy)) <= 5 THEN 1 ELSE 2 END AS speed FROM {mot} JOIN
 ent USING (rec, g, block))"""


SPACING = """si AS (SELECT rec, g, x, y, p, t_us - lag(t_us) OVER (PARTITION BY rec, g, x, y, p ORDER BY t_us, seq) AS d FROM eg WHERE rel <= 0), ptau AS
 (SELECT rec, g, x, y, p, median(d) AS tau FROM si GROUP BY ALL), btau AS (SELECT rec, g, (y//4)*4+x//4 AS block, CASE WHEN count(tau) >= 2 THEN
 median(tau) END AS tau, count(tau)/count(*) AS covered FROM ptau GROUP BY ALL)"""

CUBE = f"""{pred_sql('mot', 20261020)}, {SPACING}, gr(s,k) AS (VALUES {', '.join(f'({a}::BIGINT,{b}::BIGINT)' for a, b in GRIDS)}), al AS (SELECT rec, g,
 block, tr, x, y, p, 1 AS a, 0 AS b, 0 AS c FROM tru UNION ALL SELECT rec, g, block, tr, x, y, p, 0, 1, 0 FROM prd UNION ALL SELECT rec, g, block, tr, x,
 y, p, 0, 0, 1 FROM nul), vx AS (SELECT rec, g, block, s, k, p, least(k-1, tr*k//86400000000) AS tb, y//s AS by, x//s AS bx, sum(a) AS a, sum(b) AS b,
 sum(c) AS c FROM al, gr GROUP BY ALL), pxs AS (SELECT rec, g, block, s, k, p, by AS y, bx AS x, sum(a) AS N, sum(b) AS N2, sum(least(a,b)) AS M,
 sum(least(a,c)) AS M0 FROM vx WHERE s = 1 GROUP BY ALL), bls AS (SELECT rec, g, block, s, k, sum(a) AS N, sum(b) AS N2, sum(least(a,b)) AS M,
 sum(least(a,c)) AS M0 FROM vx GROUP BY ALL), rws AS (SELECT 'pixel' AS scope, pxs.rec, s, k, N, N2, M, M0, speed, tau, CASE WHEN tau > 0 THEN
 (86400000000.0::DOUBLE/k)/tau END AS r FROM pxs LEFT JOIN ptau USING (rec, g, x, y, p) JOIN sp USING (rec, g, block) UNION ALL SELECT 'block',
 bls.rec, s, k, N, N2, M, M0, speed, tau, CASE WHEN tau > 0 THEN (86400000000.0::DOUBLE/k)/tau END FROM bls JOIN btau USING (rec, g, block) JOIN sp
 USING (rec, g, block) WHERE covered >= 0.4 AND tau IS NOT NULL), cube AS (SELECT scope, rec, CASE WHEN {FLICK_SQL.format(t='tau')} THEN 1 ELSE 0 END AS
 flicker, speed, s, k, CAST({bin_sql('r')} AS INTEGER) AS bin, CAST(sum(N) AS BIGINT) AS N, CAST(sum(N2) AS BIGINT) AS N2, CAST(sum(M) AS BIGINT) AS M,
 CAST(sum(M0) AS BIGINT) AS M0 FROM rws GROUP BY ALL)"""


def cube(spark, d):
    eg, cand = setup(spark, d)
    m = Ca.fit_motion(eg, cand, DEMO, R, "best", DELAYS, 32)
    return Ca.score_cube(eg, m, DEMO, GRIDS, N_MIN, 2, 0.4, flick)


@query("m15_causal_prediction", f"WITH {EV}, {EG}, {BEST}, {DELAY}, {CUBE} SELECT * FROM cube")
def m15(spark, d):
    return cube(spark, d)


@query("a42_spacing_table", f"""WITH {EV}, {EG}, {BEST}, {DELAY}, {CUBE}, rv AS (SELECT rec, k, bin, sum(N) AS N, sum(N2) AS N2, sum(M) AS M, sum(M0) AS M0 FROM cube
 WHERE scope = 'pixel' AND flicker = 0 GROUP BY ALL), f AS (SELECT *, 2.0*M/(N+N2) AS F, 2.0*M0/(N+N2) AS F0 FROM rv), po AS (SELECT k, bin,
 2.0*sum(M)/sum(N+N2) AS Fp, 2.0*sum(M0)/sum(N+N2) AS F0p, CAST(sum(N) AS BIGINT) AS n_pooled FROM rv GROUP BY ALL), md AS (SELECT k, bin, count(*) AS
 n_recordings, median(F) AS F, median(F0) AS F0, median(F-F0) AS dif FROM f WHERE N >= 10 GROUP BY ALL) SELECT k, bin, n_pooled, coalesce(n_recordings,0)
 AS n_recordings, round(coalesce(F,Fp),6) AS F, round(coalesce(F0,F0p),6) AS F0, round(coalesce(dif,Fp-F0p),6) AS diff, F IS NULL AS pooled FROM po
 LEFT JOIN md USING (k, bin)""")
def a42(spark, d):
    c = cube(spark, d).filter("scope = 'pixel' AND flicker = 0")
    return spacing_table(c, ["k", "bin"], 10)


def spacing_table(cube_rows, keys, gate):
    """Median fidelity over recordings with N >= gate, else the pooled one, per spacing bin."""
    rv = cube_rows.groupBy("rec", *keys).agg(*[F.sum(c).alias(c) for c in ("N", "N2", "M", "M0")])
    den = F.col("N") + F.col("N2")
    rv = rv.withColumns({"f": C.ratio(F.col("M") * 2.0, den), "f0": C.ratio(F.col("M0") * 2.0, den)})
    ok = F.col("N") >= gate
    g = rv.groupBy(*keys).agg(
        F.sum("N").alias("n_pooled"), F.count_if(ok).alias("n_recordings"), C.ratio(F.sum("M") * 2.0, F.sum(den)).alias("_p"),
        C.ratio(F.sum("M0") * 2.0, F.sum(den)).alias("_p0"), F.median(F.when(ok, F.col("f"))).alias("_m"),
        F.median(F.when(ok, F.col("f0"))).alias("_m0"), F.median(F.when(ok, F.col("f") - F.col("f0"))).alias("_d"))
    return g.select(*keys, "n_pooled", "n_recordings", r6(F.coalesce("_m", "_p"), "F"), r6(F.coalesce("_m0", "_p0"), "F0"),
                    r6(F.coalesce(F.col("_d"), F.col("_p") - F.col("_p0")), "diff"), F.col("_m").isNull().alias("pooled"))


# ---- near-tie shifts, onset delays and phases

NEAR = """mx AS (SELECT rec, g, block, max(score) AS pairs FROM vt GROUP BY ALL), el AS (SELECT vt.*, pairs, row_number() OVER (PARTITION BY rec, g, block
 ORDER BY abs(dx)+abs(dy), dy, dx) AS rk FROM vt JOIN mx USING (rec, g, block) WHERE score >= pairs - 2.0*sqrt(pairs)), nt AS (SELECT rec, g, block,
 CASE WHEN pairs - 2.0*sqrt(pairs) <= 0 THEN 0 ELSE dx END AS dx, CASE WHEN pairs - 2.0*sqrt(pairs) <= 0 THEN 0 ELSE dy END AS dy, pairs FROM el WHERE rk
 = 1), ru AS (SELECT nt.*, coalesce((SELECT max(score) FROM vt WHERE vt.rec = nt.rec AND vt.g = nt.g AND vt.block = nt.block AND greatest(abs(vt.dx-nt.dx),
 abs(vt.dy-nt.dy)) > 1), 0)/pairs AS runner_up FROM nt)"""


@query("m16_near_tie_shift", f"WITH {EV}, {EG}, {NEAR} SELECT rec, g, block, dx, dy, pairs, round(runner_up,6) AS runner_up FROM ru")
def m16(spark, d):
    eg, cand = setup(spark, d)
    sc = S.votes(eg.filter("rel = -1"), Ca.in_blocks(eg.filter("rel = 0"), cand, DEMO), ["rec", "g"], R, DEMO)
    return S.near_tie_shift(sc, ["rec", "g", "block"]).withColumn("runner_up", r6("runner_up"))


PHASE = f"""{NEAR}, sh AS (SELECT * FROM ru WHERE pairs >= {N_MIN / 2}), om AS (SELECT rec, g, block, x, y, p, min(tr) AS fm FROM {moved_sql(
    "(SELECT * FROM eg WHERE rel = -1)", 'sh')} WHERE tr >= 5400000000 GROUP BY ALL), ot AS (SELECT rec, g, block, x, y, p, min(tr) AS ft FROM tgt WHERE tr >=
 5400000000 GROUP BY ALL), od AS (SELECT rec, g, block, CAST(greatest(-43200000000, least(43200000000, round_even(median(ft-fm),0))) AS BIGINT) AS delta
 FROM om JOIN ot USING (rec, g, block, x, y, p) GROUP BY ALL), mot AS (SELECT sh.*, coalesce(delta,0) AS delta FROM sh LEFT JOIN od USING (rec, g,
 block)), {pred_sql('mot', 20261022)}, i1 AS (SELECT *, tr - lag(tr) OVER q AS d FROM tru WINDOW q AS (PARTITION BY rec, g, block, x, y, p ORDER BY tr,
 seq)), i2 AS (SELECT *, lead(d) OVER q AS dn, lag(d) OVER q AS dp FROM i1 WINDOW q AS (PARTITION BY rec, g, block, x, y, p ORDER BY tr, seq)), rt AS
 (SELECT rec, g, block, x, y, p, median(d) AS tau FROM i2 WHERE coalesce(d > 0 AND dn > 0 AND greatest(d,dn) <= 1.2::DOUBLE*least(d,dn) AND d+dn <=
 86400000000, false) OR coalesce(d > 0 AND dp > 0 AND greatest(d,dp) <= 1.2::DOUBLE*least(d,dp) AND d+dp <= 86400000000, false) GROUP BY ALL), q AS
 (SELECT 'pred' AS kind, * FROM prd UNION ALL SELECT 'null', * FROM nul), zt AS (SELECT rec, g, block, x, y, p, tau, sum(cos(2*pi()*(tr - floor(tr/tau)
 *tau)/tau)) AS tc, sum(sin(2*pi()*(tr - floor(tr/tau)*tau)/tau)) AS ts FROM tru JOIN rt USING (rec, g, block, x, y, p) GROUP BY ALL), zq AS (SELECT
 kind, q.rec, q.g, q.block, q.x, q.y, q.p, sum(cos(2*pi()*(tr - floor(tr/tau)*tau)/tau)) AS qc, sum(sin(2*pi()*(tr - floor(tr/tau)*tau)/tau)) AS qs FROM
 q JOIN rt USING (rec, g, block, x, y, p) GROUP BY ALL), ph0 AS (SELECT kind, zt.*, atan2(qs*tc - qc*ts, qc*tc + qs*ts)/(2*pi()) AS a FROM zt JOIN zq
 USING (rec, g, block, x, y, p)), ph AS (SELECT ph0.*, a - floor(a) AS u, sp.dx, sp.dy, speed FROM ph0 JOIN sp USING (rec, g, block))"""


def phases(spark, d):
    eg, cand = setup(spark, d)
    m = Ca.fit_motion(eg, cand, DEMO, R, "near_tie", n_min=N_MIN)
    return Ca.group_phases(eg, m, DEMO, N_MIN)


@query("m17_pixel_phases", f"WITH {EV}, {EG}, {PHASE} SELECT kind, rec, g, block, x, y, p, tau, round(u,6) AS u FROM ph")
def m17(spark, d):
    return phases(spark, d).select("kind", "rec", "g", "block", "x", "y", "p", "tau", r6("u", "u"))


DEMO_EDGES = C.geometric_edges(DAY / 64.0, float(DAY), 7)
EDGE_SQL = "[" + ", ".join(f"{e!r}::DOUBLE" for e in DEMO_EDGES) + "]"
CUBE18 = f"""pcb AS (SELECT kind, rec, speed, CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE 0 END AS zero, CASE WHEN {FLICK_SQL.format(t='tau')} THEN 1 ELSE 0 END AS
 flicker, CAST(greatest(0, least(len(list_filter({EDGE_SQL}, lambda e: e <= tau)) - 1, {len(DEMO_EDGES) - 2})) AS INTEGER) AS tbin,
 CAST(least(floor(u*20), 19) AS BIGINT) AS ubin, u FROM ph)"""


@query("m18_phase_cube", f"""WITH {EV}, {EG}, {PHASE}, {CUBE18} SELECT kind, rec, speed, zero, flicker, tbin, ubin, count(*) AS n, round(sum(cos(2*pi()*u)),5) AS
 sum_cos, round(sum(sin(2*pi()*u)),5) AS sum_sin FROM pcb GROUP BY ALL""")
def m18(spark, d):
    return Ca.phase_cube(phases(spark, d), DEMO_EDGES, 20, flick).withColumns(
        {"sum_cos": F.round("sum_cos", 5), "sum_sin": F.round("sum_sin", 5)})


@query("m18_surrogate_share", f"""WITH {EV}, {EG}, lim AS (SELECT rec, g, min(t_us) AS lo, max(t_us) AS hi FROM eg WHERE rel <= 0 GROUP BY ALL), sr AS (SELECT 'real' AS
 kind, rec, g, x, y, p, seq, t_us AS t FROM eg WHERE rel <= 0 UNION ALL SELECT 'redrawn', rec, g, x, y, p, seq, lo + CAST(floor({h(51, 'seq', 'g')}
 /2147483648.0::DOUBLE*(hi-lo+1)) AS BIGINT) FROM eg JOIN lim USING (rec, g) WHERE rel <= 0), i1 AS (SELECT *, t - lag(t) OVER q AS d FROM sr WINDOW q AS
 (PARTITION BY kind, rec, g, x, y, p ORDER BY t, seq)), i2 AS (SELECT *, lead(d) OVER q AS dn FROM i1 WINDOW q AS (PARTITION BY kind, rec, g, x, y, p
 ORDER BY t, seq)), k AS (SELECT DISTINCT kind, rec, g, x, y, p FROM i2 WHERE d > 0 AND dn > 0 AND greatest(d,dn) <= 1.2::DOUBLE*least(d,dn) AND d+dn <=
 86400000000) SELECT kind, rec, count(*) AS n_pixels FROM k GROUP BY ALL""")
def m18b(spark, d):
    sp = groups_of(spark, d).filter("rel <= 0")
    lim = sp.groupBy("rec", "g").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    t = F.col("lo") + F.floor(C.uniform(51, "seq", "g") * (F.col("hi") - F.col("lo") + 1))
    red = sp.join(lim, ["rec", "g"]).withColumns({"t_us": t, "kind": F.lit("redrawn")}).drop("lo", "hi")
    both = sp.withColumn("kind", F.lit("real")).unionByName(red)
    return Tr.regular_spacing(both, ("kind", "rec", "g"), DAY).groupBy("kind", "rec").agg(F.count(F.lit(1)).alias("n_pixels"))


BAND = f"""pb AS (SELECT kind, rec, g, block, count(*) AS n, sum(cos(2*pi()*u)) AS c, sum(sin(2*pi()*u)) AS s FROM ph WHERE (dx <> 0 OR dy <> 0) AND tau >=
 {DAY / 64.0} AND tau < {DAY / 2.0} AND NOT {FLICK_SQL.format(t='tau')} GROUP BY ALL)"""


@query("m19_block_phases", f"WITH {EV}, {EG}, {PHASE}, {BAND} SELECT kind, rec, g, block, n, round(c,5) AS c, round(s,5) AS s FROM pb")
def m19(spark, d):
    return Ca.block_phases(phases(spark, d), DAY / 64.0, DAY / 2.0, flick).withColumns({"c": F.round("c", 5), "s": F.round("s", 5)})


@query("a33_phase_sums", f"""WITH {EV}, {EG}, {PHASE}, {CUBE18}, st AS (SELECT kind, rec, count(*) AS n, sum(cos(2*pi()*u)) AS sc, sum(sin(2*pi()*u)) AS ss FROM pcb WHERE
 zero = 0 AND flicker = 0 GROUP BY ALL) SELECT kind, rec, n, round(sc/n,5) AS mean_cos, round(ss/n,5) AS mean_sin FROM st""")
def a33(spark, d):
    c = Ca.phase_cube(phases(spark, d), DEMO_EDGES, 20, flick).filter("zero = 0 AND flicker = 0")
    s = c.groupBy("kind", "rec").agg(*[F.sum(x).alias(x) for x in ("n", "sum_cos", "sum_sin")])
    return s.select("kind", "rec", "n", F.round(F.col("sum_cos") / F.col("n"), 5).alias("mean_cos"),
                    F.round(F.col("sum_sin") / F.col("n"), 5).alias("mean_sin"))
