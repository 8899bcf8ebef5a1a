"""Flow, object and motion tasks, scheme families and the tolerance ladder."""
from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import boxes as B, causal as Ca, encode as E, fits as Ft, flow as Fl, objects as Ob, subsets as Sb, tolerance as To
from ..operators import voxels as V
from ..operators.codec import Q_KEY, reconstruct
from ..operators.windows import groups
from ..sensor import DAY, DEMO
from ..session import cut_lineage
from ..sources.tables import events
from .q_boxes import NEAREST, TILE, label_tables
from .q_codec import RHOS, SHARES, SUBSETS, bits_sql, zz
from .q_ingest import EV, GROUPS, KEYS, keys, r6, uleb_sql
from .q_motion import FIT, KEYEV, fitted
from .q_shift import EG, N_MIN, PHASE, R, groups_of, moved_sql
from .registry import query
from .sqltext import BOXES

FLOW = dict(K=4, fit_us=2 * DAY, radius=2, res=float(DAY) / 2, n_min=6, speed_min=1.0, tick=1.0 / DAY, st_min=DAY // 64)
GK = ["rec", "g"]


def flow_sql(src, key, t):
    """Plane fits of `src` (key.., x, y, p, tt = time before the end)."""
    d3 = lambda a, b, d, e, f, h, k, l, m: f"(({a})*(({f})*({m})-({h})*({l})) - ({b})*(({e})*({m})-({h})*({k})) + ({d})*(({e})*({l})-({f})*({k})))"
    D = d3("xx", "xy", "sx", "xy", "yy", "sy", "sx", "sy", "n")
    A = d3("xt", "xy", "sx", "yt", "yy", "sy", "st", "sy", "n")
    Bn = d3("xx", "xt", "sx", "xy", "yt", "sy", "sx", "st", "n")
    Cn = d3("xx", "xy", "xt", "xy", "yy", "yt", "sx", "sy", "st")
    return f"""(SELECT {key}, x, y, p, CAST(round_even(fx,0) AS BIGINT) AS vx, CAST(round_even(fy,0) AS BIGINT) AS vy FROM (SELECT *, a/(a*a+b*b)*86400000000.0 AS fx,
 b/(a*a+b*b)*86400000000.0 AS fy FROM (SELECT *, sqrt(greatest(tt2 - (a*xt+b*yt+c*st), 0.0)/n) AS rms FROM (SELECT *, {A}/{D} AS a, {Bn}/{D} AS b, {Cn}/{D}
 AS c FROM (SELECT {key}, x - i AS x, y - j AS y, p, count(*)::DOUBLE AS n, sum(i)::DOUBLE AS sx, sum(j)::DOUBLE AS sy, sum({t})::DOUBLE AS st,
 sum(i*i)::DOUBLE AS xx, sum(j*j)::DOUBLE AS yy, sum(i*j)::DOUBLE AS xy, sum(i*{t})::DOUBLE AS xt, sum(j*{t})::DOUBLE AS yt, sum({t}::DOUBLE*{t}) AS tt2,
 bool_or(i = 0 AND j = 0) AS own FROM {src}, range(-2::BIGINT, 3) ti(i), range(-2::BIGINT, 3) tj(j) GROUP BY ALL) WHERE own AND n >= 6 AND abs({D}) >
 1e-9)) WHERE a*a+b*b > 0 AND rms <= {DAY / 2}) WHERE sqrt(fx*fx+fy*fy) >= 1 AND abs(fx) <= 2047 AND abs(fy) <= 2047)"""


FLOWS = f"""{GROUPS}, sw AS (SELECT gw.rec, gw.g, gw.m, e.x, e.y, e.p, max(e.t_us - (gw.g+gw.m+1)*86400000000) AS tt FROM gw JOIN ev e ON e.rec = gw.rec AND
 e.t_us < (gw.g+gw.m+1)*86400000000 AND e.t_us >= (gw.g+gw.m-1)*86400000000 GROUP BY ALL), wf AS {flow_sql('sw', 'rec, g, m', 'tt')}, fe AS (SELECT e.rec,
 e.w AS g, vx, vy, row_number() OVER (PARTITION BY e.rec, e.w ORDER BY t_us, seq) AS rk FROM ev e JOIN wf ON wf.rec=e.rec AND wf.g=e.w AND wf.m=0 AND
 wf.x=e.x AND wf.y=e.y AND wf.p=e.p), stt AS (SELECT k.rec, k.w AS g, coalesce(st, 86400000000) AS st FROM (SELECT rec, w FROM keys SEMI JOIN ev USING
 (rec, w)) k LEFT JOIN (SELECT rec, g, CAST(least(86400000000, greatest({DAY // 64}, round_even(86400000000.0/avg(sqrt(CAST(vx*vx+vy*vy AS DOUBLE))),0)))
 AS BIGINT) AS st FROM fe WHERE rk <= 500 GROUP BY ALL) s ON s.rec = k.rec AND s.g = k.w), ss AS (SELECT s.rec, s.g, e.x, e.y, e.p, max(e.t_us -
 (s.g*86400000000 + s.st)) AS tt FROM stt s JOIN ev e ON e.rec = s.rec AND e.t_us < s.g*86400000000 + s.st AND e.t_us >= s.g*86400000000 + s.st -
 172800000000 GROUP BY ALL), sf AS {flow_sql('ss', 'rec, g', 'tt')}, sp AS (SELECT gw.rec, gw.g, gw.m, e.seq, e.t_us, e.tr, e.x, e.y, e.p, st, sf.vx, sf.vy,
 CASE WHEN gw.m = 0 AND e.tr < st THEN CASE WHEN sf.rec IS NOT NULL THEN 'flow' ELSE 'plain' END WHEN wf.rec IS NULL THEN 'plain' ELSE 'predicted' END AS
 part FROM gw JOIN ev e USING (rec, w) JOIN stt USING (rec, g) LEFT JOIN sf ON sf.rec=gw.rec AND sf.g=gw.g AND sf.x=e.x AND sf.y=e.y AND sf.p=e.p LEFT
 JOIN wf ON wf.rec=gw.rec AND wf.g=gw.g AND wf.m=gw.m AND wf.x=e.x AND wf.y=e.y AND wf.p=e.p)"""


def flow_parts(spark, d):
    ev = events(spark, d)
    return Fl.flow_groups(ev, keys(ev), DEMO, **FLOW)


@query("m11_plane_flow", f"WITH {EV}, {FLOWS} SELECT rec, g, m, x, y, p, vx, vy FROM wf")
def m11(spark, d):
    ev = events(spark, d)
    gw = groups(keys(ev), 4)
    ends = gw.select("rec", "g", "m", ((F.col("w") + 1) * DAY).alias("t_end"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_b"))
    src = ev.join(ends.select("rec", "g", "m", (C.idiv("t_end", DAY) - 1 - F.col("_b")).alias("w")), ["rec", "w"])
    o = {k: v for k, v in FLOW.items() if k not in ("K", "st_min")}
    return Fl.plane_flow(src, ends.drop("_b").distinct(), ["rec", "g", "m"], DEMO, **o)


@query("m12_send_split", f"""WITH {EV}, {FLOWS} SELECT rec, g, m, part, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum, max(st) AS st FROM sp GROUP BY ALL""")
def m12(spark, d):
    p, _ = flow_parts(spark, d)
    return p.groupBy("rec", "g", "m", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"), F.max("st").alias("st"))


RECORD = f"""og AS (SELECT DISTINCT rec, g FROM sp), slots AS (SELECT rec, g, 'flow' AS part, 0::BIGINT AS m FROM og UNION ALL SELECT rec, g, 'plain', m FROM og,
 range(0::BIGINT, 4) t(m)), eb AS (SELECT * FROM {bits_sql("(SELECT * FROM sp WHERE part <> 'predicted')", 'rec, g, part, m', (1, 3))}), fv AS (SELECT DISTINCT
 rec, g, x, y, p, vx, vy FROM sp WHERE part = 'flow'), fb AS (SELECT rec, g, count(*) AS n, sum({uleb_sql(zz('vx'))} + {uleb_sql(zz('vy'))}) AS b FROM fv GROUP
 BY ALL), rp AS (SELECT rec, g, part, m, coalesce(n, 0) AS n, coalesce(bits, 8) AS bits FROM slots LEFT JOIN eb USING (rec, g, part, m) UNION ALL SELECT rec, g,
 'velocity', 0, coalesce(n, 0), CAST(8*(coalesce(b, 0) + {uleb_sql('coalesce(n, 0)')}) AS BIGINT) FROM og LEFT JOIN fb USING (rec, g))"""


@query("m12_record_bits", f"WITH {EV}, {FLOWS}, {RECORD} SELECT rec, g, part, m, n, bits FROM rp")
def m12_record(spark, d):
    """The parts of each group's record with their sizes."""
    p, _ = flow_parts(spark, d)
    return Fl.record_parts(p, DEMO, 4)


STEPS = """fs AS (SELECT rec, g, seq, p, x, y, t_us AS t, vx, vy, vx*vx + vy*vy AS v2, g*86400000000 + st AS tf, (g+4)*86400000000 AS tt FROM sp WHERE part =
 'flow'), cn AS (SELECT fs.*, cx, cy, (cx-x)*vy - (cy-y)*vx AS side, t + (((cx-x)*vx + (cy-y)*vy)*86400000000)//v2 AS tm FROM fs, range(16) a(cx), range(8)
 b(cy)), hit AS (SELECT rec, g, seq, p, cx AS x, cy AS y, tm AS t_us FROM cn WHERE 25*side*side < 4*v2 AND tm >= tf AND tm < tt)"""


@query("m13_straight_paths", f"""WITH {EV}, {FLOWS}, {STEPS} SELECT rec, g, t_us//86400000000 - g AS m, x, y, p, count(*) AS n FROM hit GROUP BY ALL""")
def m13(spark, d):
    p, _ = flow_parts(spark, d)
    return Fl.predicted_events(p, DEMO, 4, tick=1.0 / DAY).groupBy("rec", "g", "m", "x", "y", "p").agg(F.count(F.lit(1)).alias("n"))


@query("t6_union_of_parts", f"""WITH {EV}, {FLOWS}, {STEPS}, u AS (SELECT rec, g, m, tr FROM sp WHERE part <> 'predicted' UNION ALL SELECT rec, g, t_us//86400000000 - g,
 t_us % 86400000000 FROM hit) SELECT rec, g, m, count(*) AS n FROM u GROUP BY ALL""")
def t6(spark, d):
    p, _ = flow_parts(spark, d)
    return Fl.rebuild(p, DEMO, 4, tick=1.0 / DAY).groupBy("rec", "g", "m").agg(F.count(F.lit(1)).alias("n"))


@query("m14_flow_scores", f"""WITH {EV}, {FLOWS}, {STEPS}, u AS (SELECT rec, g, m, tr, x, y, p FROM sp WHERE part <> 'predicted' UNION ALL SELECT rec, g, t_us//86400000000 -
 g, t_us % 86400000000, x, y, p FROM hit), a AS (SELECT rec, g, m, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM u GROUP BY
 ALL), b AS (SELECT rec, g, m, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM sp GROUP BY ALL), mm AS (SELECT rec, sum(least(
 a.c,b.c)) AS m FROM a JOIN b USING (rec, g, m, p, tb, by, bx) GROUP BY rec), n1 AS (SELECT rec, sum(c) AS n FROM a GROUP BY rec), n2 AS (SELECT rec, sum(c) AS
 n FROM b GROUP BY rec), eb AS (SELECT rec, g, sum(bits) AS b FROM {bits_sql("(SELECT * FROM sp WHERE part <> 'predicted')", 'rec, g, part, m', (1, 3))}
 GROUP BY ALL) SELECT rec, CAST(n1.n AS BIGINT) AS n_rec, CAST(n2.n AS BIGINT) AS n_true, CAST(m AS BIGINT) AS pairs, round(2.0*m/(n1.n+n2.n),6) AS F,
 CAST((SELECT sum(b) FROM eb WHERE eb.rec = mm.rec) AS BIGINT) AS event_bits FROM mm JOIN n1 USING (rec) JOIN n2 USING (rec)""")
def m14(spark, d):
    p, group = flow_parts(spark, d)
    rec = Fl.rebuild(p, DEMO, 4, tick=1.0 / DAY)
    m = V.match(rec, group, [(2, 3)], DEMO, keys=("rec", "g", "m"))
    eb = E.set_bits(p.filter("part <> 'predicted'"), Q_KEY, DEMO, ("rec", "g", "part", "m")).groupBy("rec").agg(F.sum("bits").alias("event_bits"))
    s = m.groupBy("rec").agg(F.sum("n1").alias("n_rec"), F.sum("n2").alias("n_true"), F.sum("pairs").alias("pairs"))
    return s.join(eb, "rec").select("rec", "n_rec", "n_true", "pairs", r6(F.col("pairs") * 2.0 / (F.col("n_rec") + F.col("n_true")), "F"), "event_bits")


# ---- object and motion tasks on the schemes

SCHEMES = f"""{GROUPS}, {KEYEV}, {FIT}, {SUBSETS}, tw AS (SELECT gw.rec, gw.g, gw.m, e.seq, e.tr, e.x, e.y, e.p FROM gw JOIN ev e USING (rec, w) WHERE m > 0), sc AS
 (SELECT 'static' AS scheme, key.rec, key.g, mm.m, tr, x, y, p FROM key, range(1::BIGINT, 4) mm(m) UNION ALL SELECT 'translation', key.rec, key.g, fmaps.m, tr,
 x+dx, y+dy, p FROM key JOIN fmaps USING (rec, g, block) WHERE x+dx >= 0 AND x+dx < 16 AND y+dy >= 0 AND y+dy < 8 UNION ALL SELECT scheme, gw.rec, gw.g, gw.m,
 tr, x, y, p FROM gw JOIN sub USING (rec, w) WHERE m > 0 AND scheme IN ('thin_0.5', 'select_0.5'))"""


TASK_SCHEMES = ("static", "translation", "thin_0.5", "select_0.5")


def schemes(ev):
    """Rebuilt events of the target windows m = 1..3 for four schemes: rows scheme, rec, g, m, tr, x, y, p."""
    cols = ["scheme", "rec", "g", "m", "tr", "x", "y", "p"]
    key, maps = fitted(ev)
    maps = cut_lineage(maps)
    z = F.lit(0).cast("bigint")
    a = reconstruct(key, maps.withColumns({"dx": z, "dy": z}), DEMO).withColumn("scheme", F.lit("static")).select(*cols)
    b = reconstruct(key, maps, DEMO).withColumn("scheme", F.lit("translation")).select(*cols)
    gw = groups(keys(ev), 4).filter("m > 0")
    sub = Sb.subset_table(ev.join(gw, ["rec", "w"]), DEMO, (0.5,), (0.5,), ()).filter("scheme <> 'direct'").select(*cols)
    true = ev.join(gw, ["rec", "w"]).select("rec", "g", "m", "seq", "tr", "x", "y", "p")
    return a.unionByName(b).unionByName(sub), true


M21 = f"""{NEAREST}, gb AS (SELECT gw.rec, gw.g, gw.m, track_id, bx, by, bw, bh FROM gw JOIN nb USING (rec, w) WHERE m > 0), ti AS (SELECT gb.*, tw.tr, tw.x, tw.y,
 tw.p FROM gb JOIN tw USING (rec, g, m) WHERE tw.x >= bx AND tw.x < bx+bw AND tw.y >= by AND tw.y < by+bh), tn AS (SELECT rec, g, m, track_id, count(*) AS
 n_true, avg(x) AS ax, avg(y) AS ay FROM ti GROUP BY ALL HAVING count(*) >= 3), ri AS (SELECT sc.scheme, gb.rec, gb.g, gb.m, track_id, sc.tr, sc.x, sc.y, sc.p
 FROM gb JOIN sc USING (rec, g, m) WHERE sc.x >= bx AND sc.x < bx+bw AND sc.y >= by AND sc.y < by+bh), rn AS (SELECT scheme, rec, g, m, track_id, count(*) AS
 n_rec, avg(x) AS qx, avg(y) AS qy FROM ri GROUP BY ALL), tv AS (SELECT rec, g, m, track_id, p, least(2, tr*3//86400000000) AS tb, y//2 AS vy, x//2 AS vx,
 count(*) AS c FROM ti GROUP BY ALL), rv AS (SELECT scheme, rec, g, m, track_id, p, least(2, tr*3//86400000000) AS tb, y//2 AS vy, x//2 AS vx, count(*) AS c FROM
 ri GROUP BY ALL), pm AS (SELECT scheme, rec, g, m, track_id, sum(least(rv.c,tv.c)) AS pairs FROM rv JOIN tv USING (rec, g, m, track_id, p, tb, vy, vx) GROUP BY
 ALL), sn AS (SELECT DISTINCT scheme FROM sc), ob AS (SELECT sn.scheme, tn.rec, tn.g, tn.m, tn.track_id, n_true, coalesce(n_rec,0) AS n_rec, coalesce(pairs,0)
 AS pairs, 2.0*coalesce(pairs,0)/(n_true+coalesce(n_rec,0)) AS F, qx-ax AS ex, qy-ay AS ey FROM tn CROSS JOIN sn LEFT JOIN rn USING (scheme, rec, g, m,
 track_id) LEFT JOIN pm USING (scheme, rec, g, m, track_id))"""


def object_rows(spark, d):
    ev = events(spark, d)
    pred, true = schemes(ev)
    bx = B.boxes_nearest(label_tables(spark, d)[0], DEMO).join(groups(keys(ev), 4).filter("m > 0"), ["rec", "w"])
    bx = bx.select("rec", "g", "m", "track_id", "bx", "by", "bw", "bh")
    return Ob.object_scores(cut_lineage(pred), cut_lineage(true), bx, DEMO, ["rec", "g", "m"], TASK_SCHEMES, least=3, tile=TILE)


@query("m21_object_task", f"""WITH {BOXES}, {SCHEMES}, {M21} SELECT scheme, rec, g, m, track_id, n_true, n_rec, CAST(pairs AS BIGINT) AS pairs, round(F,6) AS F,
 round(sqrt(ex*ex+ey*ey),6) AS centroid_px FROM ob""")
def m21(spark, d):
    return object_rows(spark, d).drop("ex", "ey").withColumns({"F": r6("F"), "centroid_px": r6("centroid_px")})


@query("a32_task_scores", f"""WITH {BOXES}, {SCHEMES}, {M21}, o AS (SELECT scheme, count(*) AS n_boxes, avg(F) AS f, avg(CASE WHEN n_rec = 0 THEN 1 ELSE 0 END) AS e,
 median(CASE WHEN n_rec > 0 THEN sqrt(ex*ex+ey*ey) END) AS c FROM ob GROUP BY scheme), t0 AS (SELECT scheme, rec, g, track_id, min(n_rec) > 0 AS cont,
 sqrt(pow(max(CASE WHEN m=3 THEN ex END)-max(CASE WHEN m=1 THEN ex END),2) + pow(max(CASE WHEN m=3 THEN ey END)-max(CASE WHEN m=1 THEN ey END),2))/2 AS err FROM
 ob GROUP BY ALL HAVING count(*) = 3), t AS (SELECT scheme, count(*) AS n_tracks, avg(CASE WHEN cont THEN 1 ELSE 0 END) AS tc, median(CASE WHEN cont THEN err
 END) AS te FROM t0 GROUP BY scheme) SELECT scheme, n_boxes, round(f,6) AS box_F_mean, round(e,6) AS box_empty, round(c,6) AS box_centroid_px, n_tracks,
 round(tc,6) AS track_continuous, round(te,6) AS track_velocity_error_px FROM o LEFT JOIN t USING (scheme)""")
def a32(spark, d):
    o = cut_lineage(object_rows(spark, d))
    s = Ob.task_summary(o, Ob.track_scores(o))
    return s.withColumns({c: r6(c) for c in ("box_F_mean", "box_empty", "box_centroid_px", "track_continuous", "track_velocity_error_px")})


CM = dict(vmax=3.0, coarse=0.5, fine=0.1, margin=3)


def vel_stage(src, key, grid, v0):
    return f"""(SELECT {key}, vx, vy, var FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY var DESC, i) AS rk FROM (SELECT {key}, i, vx, vy, sum(c*c)/100.0 -
 (sum(c)/100.0)*(sum(c)/100.0) AS var FROM (SELECT {key}, i, {v0[0]} + a AS vx, {v0[1]} + b AS vy, round_even(x - ({v0[0]} + a)*ts, 0) - bx + 3 AS wx,
 round_even(y - ({v0[1]} + b)*ts, 0) - by + 3 AS wy, count(*) AS c FROM {src}, {grid} GROUP BY ALL) WHERE wx >= 0 AND wx < 10 AND wy >= 0 AND wy < 10 GROUP BY
 ALL)) WHERE rk = 1)"""


def velocity_sql(src, key):
    g1 = "(VALUES " + ", ".join(f"({n}, {i * 0.5!r}::DOUBLE, {j * 0.5!r}::DOUBLE)" for n, (i, j) in enumerate(
        (i, j) for i in range(-6, 7) for j in range(-6, 7))) + ") gr(i, a, b)"
    g2 = "(VALUES " + ", ".join(f"({n}, {i * 0.1!r}::DOUBLE, {j * 0.1!r}::DOUBLE)" for n, (i, j) in enumerate(
        (i, j) for i in range(-5, 6) for j in range(-5, 6))) + ") gr(i, a, b)"
    s1 = vel_stage(src, key, g1, ("0.0::DOUBLE", "0.0::DOUBLE"))
    s2 = vel_stage(f"(SELECT s.*, v.vx AS v0, v.vy AS v1 FROM {src} s JOIN st1 v USING ({key}))", key, g2, ("v0", "v1"))
    return f"""st1 AS {s1}, st2 AS {s2}, vel AS (SELECT {key}, CASE WHEN st2.var > st1.var THEN st2.vx ELSE st1.vx END AS vx, CASE WHEN st2.var > st1.var THEN st2.vy ELSE
 st1.vy END AS vy FROM st1 JOIN st2 USING ({key}))"""


SQUARES = """s4 AS (SELECT rec, w, (y//4)*4 + x//4 AS square, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) >= 6), sq AS (SELECT rec, w, square, (square%4)*4 AS bx,
 (square//4)*4 AS by FROM (SELECT *, row_number() OVER (PARTITION BY rec, w ORDER BY n DESC, square) AS rk FROM s4) WHERE rk <= 2)"""


def squares(ev):
    s = B.top_squares(ev, 4, DEMO, least=6, most=2)
    return s.select("rec", "w", "square", (F.col("square") % 4 * 4).alias("bx"), (C.idiv("square", 4) * 4).alias("by"),
                    F.lit(4).alias("bw"), F.lit(4).alias("bh"))


def in_squares(e, sq, keys):
    """Events of each square (squares are tiles, so the join is on the square number)."""
    e = e.withColumn("square", C.idiv("y", 4) * 4 + C.idiv("x", 4))
    return e.join(sq, [*keys, "square"]).withColumn("ts", F.col("tr") / float(DAY))


@query("m2_variance_velocity", f"""WITH {EV}, {SQUARES}, se AS (SELECT e.rec, e.w, sq.square, bx, by, x, y, tr/86400000000.0::DOUBLE AS ts FROM ev e JOIN sq ON
 sq.rec=e.rec AND sq.w=e.w AND (e.y//4)*4 + e.x//4 = sq.square), {velocity_sql('se', 'rec, w, square')} SELECT rec,
 w, square, round(vx,6) AS vx, round(vy,6) AS vy FROM vel""")
def m2(spark, d):
    ev = events(spark, d)
    v = Ft.variance_velocity(in_squares(ev, squares(ev), ["rec", "w"]), ["rec", "w", "square"], **CM)
    return v.select("rec", "w", "square", r6("vx", "vx"), r6("vy", "vy"))


@query("m22_motion_task", f"""WITH {EV}, {SCHEMES}, {SQUARES}, gs AS (SELECT gw.rec, gw.g, square, bx, by FROM gw JOIN sq USING (rec, w) WHERE m = 2), al AS (SELECT 'true' AS
 scheme, rec, g, tr, x, y FROM tw WHERE m = 2 UNION ALL SELECT scheme, rec, g, tr, x, y FROM sc WHERE m = 2), se AS (SELECT scheme, al.rec, al.g, gs.square, bx, by,
 x, y, tr/86400000000.0::DOUBLE AS ts FROM al JOIN gs ON gs.rec=al.rec AND gs.g=al.g AND (al.y//4)*4 + al.x//4 = gs.square), {velocity_sql('se',
 'scheme, rec, g, square')}, nr AS (SELECT scheme, rec, g, square, count(*) AS n_rec FROM se GROUP BY ALL), sn AS (SELECT DISTINCT scheme FROM sc) SELECT sn.scheme,
 gs.rec, gs.g, gs.square, coalesce(n_rec,0) AS n_rec, round(sqrt((v.vx-t.vx)*(v.vx-t.vx)+(v.vy-t.vy)*(v.vy-t.vy)),6) AS error_px FROM gs CROSS JOIN sn LEFT JOIN vel
 v ON v.scheme=sn.scheme AND v.rec=gs.rec AND v.g=gs.g AND v.square=gs.square LEFT JOIN vel t ON t.scheme='true' AND t.rec=gs.rec AND t.g=gs.g AND
 t.square=gs.square LEFT JOIN nr ON nr.scheme=sn.scheme AND nr.rec=gs.rec AND nr.g=gs.g AND nr.square=gs.square""")
def m22(spark, d):
    ev = events(spark, d)
    pred, true = schemes(ev)
    sq = squares(ev).join(groups(keys(ev), 4).filter("m = 2"), ["rec", "w"]).select("rec", "g", "square", "bx", "by", "bw", "bh")
    return motion_task(pred.filter("m = 2"), true.filter("m = 2"), sq)


def motion_task(pred, true, sq, names=TASK_SCHEMES):
    """Velocity error (px per window) of each scheme on the squares of the true window; NULL where a set is empty."""
    k = ["rec", "g", "square"]
    cols = ["scheme", "rec", "g", "tr", "x", "y"]
    both = pred.select(*cols).unionByName(true.withColumn("scheme", F.lit("true")).select(*cols))
    e = cut_lineage(in_squares(both, sq, ["rec", "g"]))
    v = cut_lineage(Ft.variance_velocity(e, ["scheme", *k], **CM))
    n = e.groupBy("scheme", *k).agg(F.count(F.lit(1)).alias("n_rec"))
    t = v.filter("scheme = 'true'").select(*k, F.col("vx").alias("tx"), F.col("vy").alias("ty"))
    every = sq.select(*k, F.explode(F.array(*[F.lit(n) for n in names])).alias("scheme"))
    r = every.join(v, ["scheme", *k], "left").join(t, k, "left").join(n, ["scheme", *k], "left")
    return r.select("scheme", *k, F.coalesce("n_rec", F.lit(0)).alias("n_rec"),
                    r6(F.hypot(F.col("vx") - F.col("tx"), F.col("vy") - F.col("ty")), "error_px"))


# ---- every family in one table

FAM = f"""{GROUPS}, {KEYEV}, {FIT}, {SUBSETS}, tv0 AS (SELECT gw.rec, gw.g, gw.m, e.tr, e.x, e.y, e.p FROM gw JOIN ev e USING (rec, w)), fam AS (SELECT 'static' AS scheme,
 key.rec, key.g, mm.m, tr, x, y, p FROM key, range(0::BIGINT, 4) mm(m) UNION ALL SELECT 'translation', rec, g, 0, tr, x, y, p FROM key UNION ALL SELECT
 'translation', key.rec, key.g, fmaps.m, tr, x+dx, y+dy, p FROM key JOIN fmaps USING (rec, g, block) WHERE x+dx >= 0 AND x+dx < 16 AND y+dy >= 0 AND y+dy < 8 UNION
 ALL SELECT scheme, gw.rec, gw.g, gw.m, tr, x, y, p FROM gw JOIN sub USING (rec, w)), sn AS (SELECT DISTINCT scheme FROM fam), al AS (SELECT *, 1 AS a, 0 AS b FROM
 fam UNION ALL SELECT scheme, tv0.*, 0, 1 FROM tv0, sn), c(s,k) AS (VALUES (2::BIGINT,3::BIGINT),(8,1),(4,1)), v AS (SELECT scheme, rec, g, m, s, k, p, least(k-1,
 tr*k//86400000000) AS tb, y//s AS by, x//s AS bx, sum(a) AS c1, sum(b) AS c2 FROM al, c GROUP BY ALL), pb AS (SELECT scheme, rec, g, m, (by*s//4)*4 + bx*s//4 AS
 block, sum(CASE WHEN s=2 THEN c2 ELSE 0 END) AS bn, sum(CASE WHEN s=2 THEN c1 ELSE 0 END) AS bn2, sum(CASE WHEN s=2 THEN least(c1,c2) ELSE 0 END) AS bm, sum(CASE
 WHEN s=4 THEN least(c1,c2) ELSE 0 END) AS m20, sum(CASE WHEN s=8 THEN sqrt(CAST(c1*c2 AS DOUBLE)) ELSE 0 END) AS h FROM v GROUP BY ALL), ws AS (SELECT scheme, rec,
 sum(bn) AS N, sum(bn2) AS N2, sum(bm) AS M, sum(m20) AS M20, 2*sum(h) AS H, coalesce(sum(CASE WHEN bn > 3 OR bn2 > 3 THEN ln(1+bn/2.0) + ln(1+bn2/2.0) -
 2*ln(1+bm/2.0) END), 0) AS D, coalesce(sum(CASE WHEN bn > 3 OR bn2 > 3 THEN ln(1+bn/2.0) + ln(1+bn2/2.0) END), 0) AS L FROM pb GROUP BY ALL)"""


@query("m25_all_families", f"""WITH {EV}, {FAM} SELECT scheme, rec, CAST(N AS BIGINT) AS N, CAST(N2 AS BIGINT) AS N2, CAST(M AS BIGINT) AS M, round(2.0*M/(N+N2),6) AS F,
 round(2.0*M20/(N+N2),6) AS F20, round(H/(N+N2),6) AS FH, round(CASE WHEN L > 0 THEN least(1.0, greatest(0.0, 1 - D/L)) ELSE 0.0 END, 6) AS Fsnr FROM ws""")
def m25(spark, d):
    return families(events(spark, d))


def families(ev):
    """All schemes as one long table of events, scored in one pass."""
    cols = ["scheme", "rec", "g", "m", "tr", "x", "y", "p"]
    key, maps = fitted(ev)
    maps = cut_lineage(maps)
    z = F.lit(0).cast("bigint")
    m0 = key.select("rec", "g", z.alias("m"), "tr", "x", "y", "p")
    name = lambda e, n: e.withColumn("scheme", F.lit(n)).select(*cols)                               # noqa: E731
    parts = [name(m0, "static"), name(m0, "translation"),
             name(reconstruct(key, maps.withColumns({"dx": z, "dy": z}), DEMO), "static"), name(reconstruct(key, maps, DEMO), "translation")]
    gw = groups(keys(ev), 4)
    win = cut_lineage(ev.join(gw, ["rec", "w"]))
    parts.append(Sb.subset_table(win, DEMO, SHARES, RHOS, ()).select(*cols))
    pred = parts[0]
    for q in parts[1:]:
        pred = pred.unionByName(q)
    names = ["static", "translation", "direct", *[f"thin_{c}" for c in SHARES], *[f"select_{r}" for r in RHOS]]
    ren = lambda e: e.withColumnRenamed("m", "target")                                              # noqa: E731
    s = V.named_window_sums(ren(pred), names, ren(win), DEMO, ("rec", "g", "target"), phi=2.0, theta=3.0, rows=win.count() * len(names))
    f = V.fidelities(s, ["scheme", "rec"])
    return f.select("scheme", "rec", "N", "N2", "M", *[r6(c, c) for c in ("F", "F20", "FH", "Fsnr")])


CAND = f"""cand AS (SELECT rec, g, block, count(*) AS n_true FROM eg
 WHERE rel = 1 GROUP BY ALL HAVING count(*) >= {N_MIN})"""
assert CAND in EG
CROP = """lat AS (SELECT ix*4 AS x0, iy*4 AS y0 FROM range(0::BIGINT,3) a(ix), range(0::BIGINT,2) b(iy)), cs AS (SELECT rec, g, x0, y0, count(*) AS n FROM eg JOIN lat
 ON x >= x0 AND x < x0+8 AND y >= y0 AND y < y0+4 WHERE rel = 1 GROUP BY ALL), crop AS (SELECT rec, g, x0, y0 FROM (SELECT *, row_number() OVER (PARTITION BY rec, g
 ORDER BY n DESC, y0, x0) AS rk FROM cs) WHERE rk = 1), cand AS (SELECT rec, g, b.block FROM crop JOIN range(8) b(block) ON (b.block%4)*4 < x0+8 AND (b.block%4)*4+4 >
 x0 AND (b.block//4)*4 < y0+4 AND (b.block//4)*4+4 > y0)"""
LADDER = f"""{EG.replace(CAND, CROP)}, {PHASE.split(', pr0 AS')[0]}, mot2 AS (SELECT cand.rec, cand.g, cand.block, coalesce(dx,0) AS dx, coalesce(dy,0) AS dy,
 coalesce(delta,0) AS delta FROM cand LEFT JOIN mot USING (rec, g, block)), mo AS (SELECT m.rec, m.g, m.tr, m.x, m.y, m.p FROM {moved_sql(
    "(SELECT * FROM eg WHERE rel = 0)", 'mot2', 's.delta')} m JOIN crop USING (rec, g) WHERE m.x >= x0 AND m.x < x0+8 AND m.y >= y0 AND m.y < y0+4), tru AS (SELECT
 eg.rec, eg.g, tr, x, y, p FROM eg JOIN crop USING (rec, g) WHERE rel = 1 AND x >= x0 AND x < x0+8 AND y >= y0 AND y < y0+4), fq AS (SELECT rec, g, x, y, p, min(tr) AS q
 FROM mo GROUP BY ALL), ft AS (SELECT rec, g, x, y, p, min(tr) AS t FROM tru GROUP BY ALL), off AS (SELECT fq.*, CAST(round_even((t-q)/1350000000.0::DOUBLE,0) AS
 BIGINT) AS sym FROM fq JOIN ft USING (rec, g, x, y, p)), rc AS (SELECT 'every' AS recon, rec, g, (2*least(255, tr*256//86400000000)+1)*86400000000//512 AS tr, x, y, p
 FROM tru UNION ALL SELECT 'pixel', mo.rec, mo.g, greatest(0, least(86399999999, tr + sym*1350000000)), mo.x, mo.y, mo.p FROM mo JOIN off USING (rec, g, x, y, p) UNION
 ALL SELECT 'motion', * FROM mo), rn(recon) AS (VALUES ('every'),('pixel'),('motion')), ks(k) AS (VALUES (3::BIGINT),(32),(256)), al AS (SELECT *, 1 AS a, 0 AS b FROM
 rc UNION ALL SELECT recon, tru.*, 0, 1 FROM tru, rn), v AS (SELECT recon, rec, g, k, x, y, p, least(k-1, tr*k//86400000000) AS tb, sum(a) AS c1, sum(b) AS c2 FROM al,
 ks GROUP BY ALL) SELECT recon, rec, g, k, CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c2) AS BIGINT) AS n2, CAST(sum(least(c1,c2)) AS BIGINT) AS pairs,
 round(2.0*sum(least(c1,c2))/sum(c1+c2),6) AS f1 FROM v GROUP BY ALL"""


@query("m24_tolerance_ladder", f"WITH {EV}, {LADDER}")
def m24(spark, d):
    """Three reconstructions of the next window in the densest crop of each group."""
    eg = groups_of(spark, d)
    return ladder(eg, DEMO, 8, 4, 4, R, N_MIN)


def ladder(eg, sensor, cw, ch, step, radius, n_min, fit="causal", ks=(3, 32, 256)):
    nxt = eg.filter("rel = 1")
    crops = B.densest_crop(nxt, cw, ch, step, sensor, GK).select("rec", "g", "x0", "y0", (F.col("x0") + cw).alias("x1"),
                                                                 (F.col("y0") + ch).alias("y1"))
    crops = cut_lineage(crops)
    true = cut_lineage(To.cropped(nxt.select("rec", "g", "tr", "x", "y", "p", "seq"), crops))
    blocks = To.crop_blocks(crops, sensor)
    src, tgt = (-1, 0) if fit == "causal" else (0, 1)
    mot = Ca.fit_motion(eg, blocks, sensor, radius, "near_tie", n_min=n_min, src_rel=src, tgt_rel=tgt)
    z = F.lit(0).cast("bigint")
    mot = blocks.join(mot, ["rec", "g", "block"], "left").select(
        "rec", "g", "block", *[F.coalesce(c, z).alias(c) for c in ("dx", "dy", "delta")])
    from ..operators import shift as S
    motion = cut_lineage(To.cropped(S.moved_into(eg.filter("rel = 0"), mot, GK, sensor).select("rec", "g", "tr", "x", "y", "p", "seq"), crops))
    pixel = To.apply_offsets(motion, To.pixel_offsets(motion, true, sensor), sensor)
    every = To.every_event(true, sensor)
    name = lambda e, n: e.select(F.lit(n).alias("recon"), "rec", "g", "tr", "x", "y", "p")             # noqa: E731
    pred = name(every, "every").unionByName(name(pixel, "pixel")).unionByName(name(motion, "motion"))
    pred = pred.withColumn("tr", F.greatest(F.lit(0), F.least(F.lit(sensor.t0 - 1), F.col("tr"))))
    t = true.select("rec", "g", "tr", "x", "y", "p", F.explode(F.array(*[F.lit(n) for n in ("every", "pixel", "motion")])).alias("recon"))
    m = V.scores(V.match(pred, t, [(1, k) for k in ks], sensor, keys=("recon", "rec", "g")))
    return m.select("recon", "rec", "g", "k", "n1", "n2", "pairs", r6("f1", "f1"))
