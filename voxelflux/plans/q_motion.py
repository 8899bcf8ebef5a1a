"""Fits, regions, regeneration, flow, tasks and the scheme families."""
from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import boxes as B, causal as Ca, codec as K, encode as E, fits as Ft, flow as Fl, objects as Ob, regions as Rg, shift as S
from ..operators import stats as St, subsets as Sb, voxels as V
from ..operators.stats import medians
from ..operators.windows import groups
from ..sensor import DAY, DEMO
from ..session import cut_lineage
from ..sources.tables import events
from .q_boxes import CENTRES, IN_BOX, INST, RECT0, TILE, inst, label_tables, rects
from .q_ingest import EV, GROUPS, KEYS, keys, r6
from .q_shift import groups_of
from .q_trains import span_events
from .registry import query
from .sqltext import BOXES, h

GB = ["rec", "g", "block"]


def key_of(ev, least=4):
    """Key events in blocks with at least `least` events."""
    k = ev.join(keys(ev), ["rec", "w"], "left_semi").withColumnRenamed("w", "g").withColumn("block", C.block_id("x", "y", 4, 16))
    n = k.groupBy(*GB).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return k.join(n, GB, "left_semi")


KEYEV = """kb AS (SELECT rec, w AS g, (y//4)*4+x//4 AS block, count(*) AS n_key FROM ev SEMI JOIN keys USING (rec, w) GROUP BY ALL HAVING count(*) >= 4), key
 AS (SELECT ev.rec, ev.w AS g, (y//4)*4+x//4 AS block, seq, t_us, tr, x, y, p FROM ev JOIN kb ON kb.rec = ev.rec AND kb.g = ev.w AND kb.block =
 (y//4)*4+x//4)"""

MOVED = """mv0 AS (SELECT key.*, m, CAST(x AS DOUBLE)+dx+(ia/2.0::DOUBLE)*(x-((block%4)*4+1.5::DOUBLE))+(ib/2.0::DOUBLE)*(y-((block//4)*4+1.5::DOUBLE)) AS
 xm, CAST(y AS DOUBLE)+dy+(ic/2.0::DOUBLE)*(x-((block%4)*4+1.5::DOUBLE))+(id/2.0::DOUBLE)*(y-((block//4)*4+1.5::DOUBLE)) AS ym FROM key JOIN maps USING
 (rec, g, block)), mv1 AS (SELECT rec, g, block, m, tr, p, CAST(round_even(xm,0) AS BIGINT) AS x, CAST(round_even(ym,0) AS BIGINT) AS y FROM mv0), mv AS
 (SELECT * FROM mv1 WHERE x >= 0 AND x < 16 AND y >= 0 AND y < 8)"""

CLAIM = """tg AS (SELECT k.rec, k.w AS g, ev.w - k.w AS m, tr, x, y, p FROM keys k JOIN ev ON ev.rec = k.rec AND ev.w > k.w AND ev.w <= k.w+3), ord AS (SELECT
 rec, g, block, row_number() OVER (PARTITION BY rec, g ORDER BY n_key DESC, block) AS rk FROM kb), cells(s,k) AS (VALUES (2::BIGINT,3::BIGINT),(1,3),(1,12),(1,32)), cm
 AS (SELECT s, k, rec, g, m, block, p, least(k-1, tr*k//86400000000) AS tb, y//s AS by, x//s AS bx, count(*) AS c FROM mv, cells GROUP BY ALL), ct AS
 (SELECT s, k, rec, g, m, p, least(k-1, tr*k//86400000000) AS tb, y//s AS by, x//s AS bx, count(*) AS ct FROM tg, cells GROUP BY ALL), cs AS (SELECT
 cm.*, coalesce(ct,0) AS ct, sum(c) OVER (PARTITION BY s, k, cm.rec, cm.g, cm.m, p, tb, by, bx ORDER BY rk) AS ss FROM cm LEFT JOIN ct USING (s, k, rec,
 g, m, p, tb, by, bx) JOIN ord USING (rec, g, block)), cl AS (SELECT s, k, rec, g, m, block, CAST(sum(c) AS BIGINT) AS n_in, CAST(sum(least(ss,ct) -
 least(ss-c,ct)) AS BIGINT) AS got FROM cs GROUP BY ALL)"""


R9 = 6
FIT = f"""tgv AS (SELECT k.rec, k.w AS g, ev.w - k.w AS m, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM keys k JOIN ev ON
 ev.rec = k.rec AND ev.w > k.w AND ev.w <= k.w+3 GROUP BY ALL), kpx AS (SELECT rec, g, block, x, y, p, least(2, tr*3//86400000000) AS tb, count(*) AS c
 FROM key GROUP BY ALL), vv AS (SELECT a.rec, a.g, b.m, a.block, 2*b.bx+i-a.x AS dx, 2*b.by+j-a.y AS dy, b.p, b.tb, b.by, b.bx, sum(a.c) AS c1, max(b.c)
 AS c2 FROM kpx a JOIN tgv b ON a.rec=b.rec AND a.g=b.g AND a.p=b.p AND a.tb=b.tb, range(2) ti(i), range(2) tj(j) WHERE abs(2*b.bx+i-a.x) <= {R9} AND
 abs(2*b.by+j-a.y) <= {R9} AND 2*b.bx+i < 16 AND 2*b.by+j < 8 GROUP BY ALL), vs AS (SELECT rec, g, m, block, dx, dy, sum(least(c1,c2)) AS sc FROM vv GROUP
 BY ALL), vb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec, g, m, block ORDER BY sc DESC, abs(dx)+abs(dy), dy, dx) AS rk FROM vs) WHERE
 rk = 1), fmaps AS (SELECT kb.rec, kb.g, mm.m, kb.block, coalesce(dx,0) AS dx, coalesce(dy,0) AS dy FROM kb CROSS JOIN range(1::BIGINT, 4) mm(m) LEFT JOIN
 vb ON vb.rec=kb.rec AND vb.g=kb.g AND vb.block=kb.block AND vb.m=mm.m)"""


def fitted(ev):
    key = cut_lineage(key_of(ev))                   # read by the fit, its count and its callers
    return key, Ft.block_maps(key, ev, keys(ev), DEMO, 4, R9)


@query("w15_claims", f"""WITH {EV}, {KEYS}, {KEYEV}, {FIT}, maps AS (SELECT rec, g, m, block, dx, dy, 0 AS ia, 0 AS ib, 0 AS ic, 0 AS id FROM fmaps), {MOVED}, {CLAIM}
 SELECT s, k, rec, g, m, block, n_in, got FROM cl""")
def w15(spark, d):
    ev = events(spark, d)
    key, maps = fitted(ev)
    true = Ft.group_targets(ev, keys(ev), 4)
    c = Rg.block_claims(key, true, maps, DEMO, [(2, 3), (1, 3), (1, 12), (1, 32)])
    return c.select("s", "k", "rec", "g", "m", "block", "n_in", "got")


@query("m9_block_maps", f"WITH {EV}, {KEYS}, {KEYEV}, {FIT} SELECT rec, g, m, block, dx, dy FROM fmaps")
def m9(spark, d):
    return fitted(events(spark, d))[1].select("rec", "g", "m", "block", "dx", "dy")


def receiver_chain(spark, d):
    """Sender's and receiver's key events, maps and scores (rec, g, m, n_rec, n_true, pairs) of one coded table of groups with fitted maps. The receiver's come
    from the stored codes only. Every target of every group has a row, with zeros where a window or its reconstruction is empty."""
    ev = events(spark, d)
    ks = keys(ev)
    key, maps = fitted(ev)
    key, maps = cut_lineage(key), cut_lineage(maps)
    coded = cut_lineage(E.encode(key, K.Q_KEY, DEMO, ("rec", "g")))
    deltas = cut_lineage(E.map_deltas(maps))
    dec = E.decode(coded, K.Q_KEY, DEMO, ("rec", "g")).withColumn("block", C.block_id("x", "y", DEMO.block, DEMO.width))
    got = cut_lineage(E.decode_maps(deltas))
    n = ev.groupBy("rec", "w").agg(F.count(F.lit(1)).alias("n_true"))
    every = groups(ks, 4).filter("m > 0").join(n, ["rec", "w"], "left")

    def scores(k, mp):
        m = Sb.match_variants(K.reconstruct(k, mp, DEMO), ev, K.GRID, DEMO, ("g", "m")).select("rec", "g", "m", F.col("n1").alias("n_rec"), "pairs")
        return every.join(m, ["rec", "g", "m"], "left").na.fill(0, ["n_rec", "n_true", "pairs"]).select("rec", "g", "m", "n_rec", "n_true", "pairs")
    return (key, maps, scores(key, maps)), (dec, got, scores(dec, got))


RECEIVED = f"""{GROUPS}, {KEYEV}, {FIT}, rv AS (SELECT key.rec, key.g, fmaps.m, p, least(2, tr*3//86400000000) AS tb, y + dy AS y, x + dx AS x FROM key JOIN fmaps
 USING (rec, g, block)), rcn AS (SELECT rec, g, m, p, tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM rv WHERE x >= 0 AND x < 16 AND y >= 0 AND y < 8 GROUP BY
 ALL), rs AS (SELECT rec, g, m, sum(rcn.c) AS n_rec, sum(least(rcn.c, coalesce(tgv.c,0))) AS pairs FROM rcn LEFT JOIN tgv USING (rec, g, m, p, tb, by, bx)
 GROUP BY ALL), nw AS (SELECT rec, w, count(*) AS n_true FROM ev GROUP BY ALL), sc AS (SELECT rec, g, m, CAST(coalesce(n_rec, 0) AS BIGINT) AS n_rec,
 coalesce(n_true, 0) AS n_true, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs FROM gw LEFT JOIN nw USING (rec, w) LEFT JOIN rs USING (rec, g, m) WHERE m > 0)"""


@query("a15_receiver_fitted", f"WITH {EV}, {RECEIVED} SELECT rec, g, m, n_rec, n_true, pairs FROM sc")
def a15f(spark, d):
    return receiver_chain(spark, d)[1][2]


@query("a24_receiver", f"""WITH {EV}, {RECEIVED}, n AS (SELECT rec, 'key events' AS "check", count(*) AS n FROM key GROUP BY rec UNION ALL SELECT rec, 'maps',
 count(*) FROM fmaps GROUP BY rec UNION ALL SELECT rec, 'scores', count(*) FROM sc GROUP BY rec) SELECT rec, "check", n AS n_sender, n AS n_receiver, 0::BIGINT
 AS violations, true AS pass FROM n""")
def a24_receiver(spark, d):
    """What the receiver rebuilt against what the sender had: events on the key grid, maps, and scores of every group and target."""
    (key, maps, sent), (dec, got, received) = receiver_chain(spark, d)
    s, k = K.Q_KEY
    grid = {"tb": C.time_bin("tr", k, DEMO.t0), "by": C.idiv("y", s), "bx": C.idiv("x", s)}
    tables = {"key events": (key.withColumns(grid), dec.withColumns(grid), ["g", "p", "tb", "by", "bx"]), "maps": (maps, got, ["g", "block", "m", *E.PARAMS]),
              "scores": (sent, received, ["g", "m", "n_rec", "n_true", "pairs"])}
    out = None
    for name, (a, b, cols) in tables.items():
        c = St.differing(a, b, ["rec"], cols).select("rec", F.lit(name).alias("check"), F.col("n_left").alias("n_sender"), F.col("n_right").alias("n_receiver"),
                                                     "violations", (F.col("violations") == 0).alias("pass"))
        out = c if out is None else out.unionByName(c)
    return out


M10_SQL = f"""WITH {EV}, {GROUPS}, {KEYEV}, {FIT}, md(model) AS (VALUES ('static'),('translation')), mv AS (SELECT model, key.rec, key.g, fmaps.m, p,
 least(2, tr*3//86400000000) AS tb, (y + CASE WHEN model='static' THEN 0 ELSE dy END) AS y, (x + CASE WHEN model='static' THEN 0 ELSE dx END) AS x FROM key
 JOIN fmaps USING (rec, g, block), md), mc AS (SELECT model, rec, g, m, p, tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM mv WHERE x >= 0 AND x < 16 AND y
 >= 0 AND y < 8 GROUP BY ALL), pr AS (SELECT model, rec, g, sum(mc.c) AS n_rec, sum(least(mc.c, coalesce(tgv.c,0))) AS pairs FROM mc LEFT JOIN tgv USING
 (rec, g, m, p, tb, by, bx) GROUP BY ALL), nk AS (SELECT rec, g, sum(n_key) AS n_key FROM kb GROUP BY ALL), nt AS (SELECT rec, g, count(*) AS n_true FROM
 gw JOIN ev USING (rec, w) GROUP BY ALL), s AS (SELECT model, rec, sum(n_key) AS n_key, sum(n_rec) AS n_rec, sum(n_true) AS n_true, sum(pairs) AS pairs
 FROM pr JOIN nk USING (rec, g) JOIN nt USING (rec, g) GROUP BY ALL) SELECT model, rec, CAST(n_key AS BIGINT) AS n_key, CAST(n_rec AS BIGINT) AS n_rec,
 CAST(n_true AS BIGINT) AS n_true, CAST(pairs AS BIGINT) AS pairs, round(2.0*(n_key+pairs)/(n_key+n_rec+n_true),6) AS F FROM s"""


@query("m10_group_evaluation", M10_SQL)
def m10(spark, d):
    """Static and translation models of the same fit; affine shapes are refined in m10_affine_refined."""
    ev = events(spark, d)
    key, maps = fitted(ev)
    maps = cut_lineage(maps)
    z = {p: F.lit(0).cast("bigint") for p in ("dx", "dy")}
    out = None
    key = key.withColumn("rho", F.lit(0.25))
    for model, mp in (("static", maps.withColumns(z)), ("translation", maps)):
        c = K.group_counts(ev, key, mp, keys(ev), DEMO, 4, params=()).withColumn("model", F.lit(model))
        out = c if out is None else out.unionByName(c)
    s = out.groupBy("model", "rec").agg(*[F.sum(c).alias(c) for c in ("n_key", "n_rec", "n_true", "pairs")])
    return V.group_summary(s).select("model", "rec", "n_key", "n_rec", "n_true", "pairs", r6("F", "F"))


@query("m10_affine_refined")
def m10a(spark, d):
    """Shape search of each block from its translation: candidates as rows, no group in one task. Rows-only check."""
    ev = events(spark, d)
    key, maps = fitted(ev)
    k = ["rec", "g", "m", "block"]
    cx, cy = C.block_centre("block", 4, 16)
    start = maps.withColumns({"cx": cx, "cy": cy, "hx": F.lit(2.0), "hy": F.lit(2.0), "x0": F.lit(0), "x1": F.lit(15), "y0": F.lit(0),
                              "y1": F.lit(7)})
    src = key.withColumn("m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))))
    tru = Ft.group_targets(ev, keys(ev), 4).select("rec", "g", "m", "tr", "x", "y", "p")
    q = Ft.coordinate_search(src, tru, start, k, ["rec", "g", "m"], DEMO)
    return q.select(*k, "dx", "dy", "ia", "ib", "ic", "id", "pairs", "np", r6("f1", "f1"))


FACTS = f"""{KEYEV}, {FIT}, span AS (SELECT s.g, ev.* FROM (SELECT rec, w AS g, unnest(generate_series(greatest(0, w-3), w)) AS w FROM keys) s JOIN ev USING
 (rec, w)), bi AS (SELECT rec, g, x, y, p, t_us - lag(t_us) OVER (PARTITION BY rec, g, x, y, p ORDER BY t_us, seq) AS d FROM span), bpx AS (SELECT rec, g,
 x, y, p, median(d) AS tau FROM bi GROUP BY ALL), bsp AS (SELECT rec, g, (y//4)*4 + x//4 AS block, CASE WHEN count(tau) >= 2 THEN median(tau) END AS tau,
 count(tau) AS n_pix, count(tau)/count(*) AS covered FROM bpx GROUP BY ALL), {CENTRES}, tch AS (SELECT DISTINCT rec, w AS g, (y//4)*4+x//4 AS block FROM
 bc, range(16) a(x), range(8) b(y) WHERE x >= ceil(bx-0.5) AND x < ceil(bx+bw+0.5) AND y >= ceil(by-0.5) AND y < ceil(by+bh+0.5)), mpf AS (SELECT rec, g,
 block, max(greatest(abs(dx),abs(dy))) <= 1 AS static, max(CASE WHEN m = 3 THEN sqrt(CAST(dx*dx+dy*dy AS DOUBLE)) END)/3.0 AS speed FROM fmaps GROUP BY
 ALL), pol AS (SELECT rec, g, block, avg(CASE WHEN pb THEN 1 ELSE 0 END) AS both_polarity FROM (SELECT rec, g, block, x, y, min(p) <> max(p) AS pb FROM
 key GROUP BY ALL) GROUP BY ALL), facts AS (SELECT kb.rec, kb.g, kb.block, n_key, static, speed, both_polarity, tau, n_pix, covered, tch.rec IS NOT NULL
 AS touch FROM kb JOIN mpf USING (rec, g, block) JOIN pol USING (rec, g, block) LEFT JOIN bsp USING (rec, g, block) LEFT JOIN tch ON tch.rec = kb.rec AND
 tch.g = kb.g AND tch.block = kb.block)"""


def facts(spark, d):
    ev = events(spark, d)
    key, maps = fitted(ev)
    bx = B.boxes_at_centres(label_tables(spark, d)[2], DEMO)
    return Rg.block_facts(key, span_events(ev), maps, bx, DEMO, 0.5, 1, 2)


@query("m20_regions", f"""WITH {BOXES}, {KEYS}, {FACTS} SELECT rec, g, block, n_key, static, round(speed,6) AS speed, round(both_polarity,6) AS both_polarity, tau,
 n_pix, round(covered,6) AS covered, touch FROM facts""")
def m20(spark, d):
    return facts(spark, d).withColumns({c: r6(c) for c in ("speed", "both_polarity", "covered")})


A34 = """count(*) AS n_blocks, round(avg(CASE WHEN static THEN 1 ELSE 0 END),6) AS static_share, round(median(speed),6) AS speed, round(median(both_polarity),6) AS both_polarity,
 round(median(n_key),6) AS n_key, round(count(tau)/count(*),6) AS share_tau, round(median(covered),6) AS covered, round(median(tau),3) AS tau FROM facts"""


@query("a34_region_tables", f"WITH {BOXES}, {KEYS}, {FACTS} SELECT touch, {A34} GROUP BY touch")
def a34(spark, d):
    return region_table(facts(spark, d), ["touch"])


@query("a34_region_recordings", f"WITH {BOXES}, {KEYS}, {FACTS} SELECT rec, touch, {A34} GROUP BY rec, touch")
def a34_recordings(spark, d):
    return region_table(facts(spark, d), ["rec", "touch"])


def region_table(f, keys):
    f = cut_lineage(f)
    m = medians(f.withColumn("n_key", F.col("n_key").cast("double")), keys, ["speed", "both_polarity", "n_key", "covered", "tau"])
    a = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), r6(F.avg(F.col("static").cast("double")), "static_share"),
                             r6(F.count("tau") / F.count(F.lit(1)), "share_tau"))
    return a.join(m, keys).select(*keys, "n_blocks", "static_share", *[r6(c, c) for c in ("speed", "both_polarity", "n_key")],
                                  "share_tau", r6("covered", "covered"), F.round("tau", 3).alias("tau"))


# ---- regeneration and aligned motion of labelled objects

V_X = 2.0                       # px per day, the drift of the demo points


def object_sets(spark, d):
    ev = events(spark, d)
    r, seg, life = rects(spark, d)
    r = cut_lineage(r)
    src = cut_lineage(Ob.source_events(ev, r, seg, DEMO, DAY, 0.5, TILE))
    fut = cut_lineage(Ob.future_events(ev, r, DEMO, 0, DAY, TILE))
    ok = (F.col("t_e") - 2 * DAY >= F.col("t_first")) & (F.col("t_e") + DAY <= F.col("t_last"))
    rows = cut_lineage(Ob.skip_reason(r, ok, src, fut, 3, 3))
    return ev, rows, src, fut, seg, life


OBJ = f"""{IN_BOX}, {INST}, {RECT0}, src0 AS (SELECT ib.*, i.t_e, ib.t_us - (i.t_e - 86400000000) AS tr FROM ib JOIN inst i USING (rec, track_id) WHERE ib.t_us >=
 i.t_e - 86400000000 AND ib.t_us < i.t_e), fut0 AS (SELECT r.rec, r.track_id, r.t_e, e.seq, e.x, e.y, e.p, e.t_us - r.t_e AS tr FROM rect r JOIN ev e ON
 e.rec = r.rec AND e.t_us >= r.t_e AND e.t_us < r.t_e + 86400000000 AND e.x BETWEEN sx0 AND sx1 AND e.y BETWEEN sy0 AND sy1), n1 AS (SELECT rec, track_id,
 t_e, count(*) AS n_source FROM src0 GROUP BY ALL), n2 AS (SELECT rec, track_id, t_e, count(*) AS n_future FROM fut0 GROUP BY ALL), rowz AS (SELECT
 rect.*, coalesce(n_source,0) AS n_source, coalesce(n_future,0) AS n_future, CASE WHEN NOT (rect.t_e - 172800000000 >= t_first AND rect.t_e + 86400000000
 <= t_last) THEN 'outside_track_life' WHEN sx0 IS NULL THEN 'support_outside_sensor' WHEN coalesce(n_source,0) < 3 THEN 'source_too_small' WHEN
 coalesce(n_future,0) < 3 THEN 'future_too_small' ELSE '' END AS skip FROM rect JOIN tracks USING (rec, track_id) LEFT JOIN n1 USING (rec, track_id, t_e)
 LEFT JOIN n2 USING (rec, track_id, t_e)), okr AS (SELECT * FROM rowz WHERE skip = ''), src AS (SELECT src0.* FROM src0 SEMI JOIN okr USING (rec,
 track_id, t_e)), fut AS (SELECT fut0.* FROM fut0 SEMI JOIN okr USING (rec, track_id, t_e))"""


@query("m5_skip_reasons", f"WITH {OBJ} SELECT rec, skip, count(*) AS n, CAST(sum(n_source) AS BIGINT) AS n_source, CAST(sum(n_future) AS BIGINT) AS n_future FROM "
                          "rowz GROUP BY ALL")
def m5s(spark, d):
    _, rows, *_ = object_sets(spark, d)
    return rows.groupBy("rec", "skip").agg(F.count(F.lit(1)).alias("n"), F.sum("n_source").alias("n_source"), F.sum("n_future").alias("n_future"))


UNI = {j: f"{h(61, 'seq', 't_e//1000000 + ' + str(j))}/2147483648.0::DOUBLE" for j in (1, 2, 3, 4)}
M5_SQL = f"""WITH {OBJ}, lab AS (SELECT * RENAME (by AS n_y) FROM (SELECT s0.*, {{box}} FROM (SELECT s.rec, s.track_id, s.t_e, s.tr, s.p, s.x, s.y, s.bx AS cx, s.by AS
 cy, s.bw AS cw, s.bh AS ch, s.t_us + 86400000000 AS tt, t.t_first, t.t_last FROM src s JOIN tracks t USING (rec, track_id)) s0 JOIN seg g ON {{on}})),
 pm AS (SELECT 'static' AS model, rec, track_id, t_e, tr, p, x::DOUBLE AS x, y::DOUBLE AS y FROM src UNION ALL SELECT 'constant', rec, track_id, t_e, tr, p,
 x + {V_X}::DOUBLE, y::DOUBLE FROM src UNION ALL SELECT 'label', rec, track_id, t_e, tr, p, (bx+bw*0.5)+(x-(cx+cw*0.5))*(bw/greatest(cw,1e-9)),
 (n_y+bh*0.5)+(y-(cy+ch*0.5))*(bh/greatest(ch,1e-9)) FROM lab UNION ALL SELECT 'uniform', rec, track_id, t_e, CAST(floor({UNI[3]}*86400000000) AS BIGINT),
 CAST(floor({UNI[4]}*2) AS BIGINT), (sx0 + floor({UNI[1]}*(sx1-sx0+1)))::DOUBLE, (sy0 + floor({UNI[2]}*(sy1-sy0+1)))::DOUBLE FROM src JOIN okr USING (rec,
 track_id, t_e)), pr AS (SELECT model, pm.rec, pm.track_id, pm.t_e, tr, p, CAST(round_even(x,0) AS BIGINT) AS x, CAST(round_even(y,0) AS BIGINT) AS y FROM
 pm JOIN okr USING (rec, track_id, t_e) WHERE round_even(x,0) BETWEEN sx0 AND sx1 AND round_even(y,0) BETWEEN sy0 AND sy1), cl(s,k) AS (VALUES (1::BIGINT,
 1::BIGINT),(2,3),(4,8)), a AS (SELECT model, rec, track_id, t_e, s, k, p, least(k-1, tr*k//86400000000) AS tb, y//s AS by, x//s AS bx, count(*) AS c FROM
 pr, cl GROUP BY ALL), b AS (SELECT rec, track_id, t_e, s, k, p, least(k-1, tr*k//86400000000) AS tb, y//s AS by, x//s AS bx, count(*) AS c FROM fut, cl
 GROUP BY ALL), m AS (SELECT model, rec, track_id, t_e, s, k, sum(least(a.c,b.c)) AS m FROM a JOIN b USING (rec, track_id, t_e, s, k, p, tb, by, bx) GROUP
 BY ALL), np AS (SELECT model, rec, track_id, t_e, count(*) AS np FROM pr GROUP BY ALL), ml(model) AS (VALUES ('static'),('constant'),('label'),
 ('uniform')), f AS (SELECT model, okr.rec, s, k, okr.n_future, coalesce(np,0) AS np, coalesce(m,0) AS m FROM okr CROSS JOIN ml CROSS JOIN cl LEFT JOIN np
 USING (model, rec, track_id, t_e) LEFT JOIN m USING (model, rec, track_id, t_e, s, k)) SELECT model, rec, s, k, count(*) AS n_rows, CAST(sum(m) AS
 BIGINT) AS pairs, round(median(2.0*m/(np+n_future)),6) AS f1 FROM f GROUP BY ALL"""


def _box_sql(t, tf="s0.t_first", tl="s0.t_last"):
    tc = f"greatest(least(CAST({t} AS DOUBLE), {tl}), {tf})"
    f = f"(CASE WHEN g.tb IS NULL THEN 0.0 ELSE CAST({tc} - g.ta AS DOUBLE)/(g.tb - g.ta) END)"
    cols = ", ".join(f"g.{c}a + {f}*(coalesce(g.{c}b, g.{c}a) - g.{c}a) AS b{c}" for c in "xywh")
    return cols, f"g.rec = s0.rec AND g.track_id = s0.track_id AND g.ta <= {tc} AND ({tc} < g.tb OR (g.tb IS NULL AND {tc} = g.ta))"


@query("m5_regeneration", M5_SQL.format(box=_box_sql("s0.tt")[0], on=_box_sql("s0.tt")[1]))
def m5(spark, d):
    ev, rows, src, fut, seg, life = object_sets(spark, d)
    ok = rows.filter("skip = ''")
    s = src.join(ok.select(*Ob.OK, "sx0", "sx1", "sy0", "sy1"), Ob.OK)
    bounds = ["sx0", "sx1", "sy0", "sy1"]
    base = ["model", *Ob.OK, "tr", "x", "y", "p", *bounds]
    lab = s.withColumnsRenamed({"bx": "cx", "by": "cy", "bw": "cw", "bh": "ch"}).withColumn("_to", F.col("t_us") + DAY)
    lab = B.box_at(lab, seg, life, DAY, "_to")
    lab = lab.withColumns({"model": F.lit("label"), "x": C.rint_bigint(C.warp_box("x", "cx", "cw", "bx", "bw")),
                           "y": C.rint_bigint(C.warp_box("y", "cy", "ch", "by", "bh"))}).select(*base)
    u = lambda j: C.uniform(61, "seq", C.idiv("t_e", 1_000_000) + j)                                  # noqa: E731
    row = lambda model, **new: F.struct(F.lit(model).alias("model"), *[new.get(c, F.col(c)).cast("bigint").alias(c) for c in ("tr", "x", "y", "p")])
    three = F.explode(F.array(
        row("static"), row("constant", x=C.rint_bigint(F.col("x") + V_X)),
        row("uniform", tr=F.floor(u(3) * DAY), p=F.floor(u(4) * 2), x=F.col("sx0") + F.floor(u(1) * (F.col("sx1") - F.col("sx0") + 1)),
            y=F.col("sy0") + F.floor(u(2) * (F.col("sy1") - F.col("sy0") + 1))))).alias("_m")
    pred = s.select(*Ob.OK, *bounds, three).select(*Ob.OK, *bounds, "_m.*").unionByName(lab)
    pred = pred.filter(F.col("x").between(F.col("sx0"), F.col("sx1")) & F.col("y").between(F.col("sy0"), F.col("sy1")))
    true = fut.join(ok.select(*Ob.OK), Ob.OK, "left_semi")
    names = ("static", "constant", "label", "uniform")
    v = V.named_pair_counts(pred, names, true, [(1, 1), (2, 3), (4, 8)], DEMO, Ob.OK, "model", rows=src.count() * len(names) + fut.count())
    m = cut_lineage(V.scores(V.matched_by_name(v, names, Ob.OK, "model")))
    k = ["model", "rec", "s", "k"]
    n = m.groupBy(*k).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("pairs").alias("pairs"))
    return n.join(medians(m, k, ["f1"]), k).withColumn("f1", r6("f1"))


@query("m6_aligned_displacement", f"""WITH {OBJ}, kp AS (SELECT rec, track_id, t_e, x, y, p, least(2, tr*3//86400000000) AS tb, count(*) AS c FROM src GROUP BY ALL),
 tv AS (SELECT rec, track_id, t_e, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM fut GROUP BY ALL), vv AS (SELECT a.rec,
 a.track_id, a.t_e, 2*b.bx+i-a.x AS dx, 2*b.by+j-a.y AS dy, b.p, b.tb, b.by, b.bx, sum(a.c) AS c1, max(b.c) AS c2 FROM kp a JOIN tv b USING (rec,
 track_id, t_e, p, tb) JOIN okr USING (rec, track_id, t_e), range(2) ti(i), range(2) tj(j) WHERE abs(2*b.bx+i-(a.x+2)) <= 3 AND abs(2*b.by+j-a.y) <= 3 AND
 2*b.bx+i BETWEEN sx0 AND sx1 AND 2*b.by+j BETWEEN sy0 AND sy1 GROUP BY ALL), vs AS (SELECT rec, track_id, t_e, dx, dy, sum(least(c1,c2)) AS sc FROM vv
 GROUP BY ALL), vb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec, track_id, t_e ORDER BY sc DESC, abs(dx-2)+abs(dy), dy, dx) AS rk FROM
 vs) WHERE rk = 1) SELECT okr.rec, okr.track_id, okr.t_e, coalesce(dx, 2) AS dx, coalesce(dy, 0) AS dy, CAST(coalesce(sc, 0) AS BIGINT) AS pairs FROM okr
 LEFT JOIN vb USING (rec, track_id, t_e)""")
def m6(spark, d):
    """Displacement votes in a square of 3 px around the expected motion of 2 px."""
    _, rows, src, fut, *_ = object_sets(spark, d)
    return aligned(rows.filter("skip = ''"), src, fut, (2, 0), 3, DEMO)


def aligned(ok, src, fut, d0, radius, sensor, keys=Ob.OK):
    """Best displacement of each key in a square around `d0`, a pair of numbers or of Columns over the keys."""
    dx0, dy0 = (F.lit(v).cast("bigint") for v in d0)
    s = src.join(ok.select(*keys, "sx0", "sx1", "sy0", "sy1"), Ob.OK).withColumns({"_cx": dx0, "_cy": dy0})
    v = S.voxel_votes(s, fut, keys, radius, (2, 3), sensor, by_block=(), centre=("_cx", "_cy"), bounds=("sx0", "sx1", "sy0", "sy1"))
    near = F.abs(F.col("dx") - dx0) + F.abs(F.col("dy") - dy0)
    b = v.groupBy(*keys).agg(F.max_by(F.struct("dx", "dy", "score"), F.struct(F.col("score"), -near, -F.col("dy"), -F.col("dx"))).alias("b"))
    return ok.select(*keys).join(b, list(keys), "left").select(
        *keys, F.coalesce("b.dx", dx0).cast("bigint").alias("dx"), F.coalesce("b.dy", dy0).cast("bigint").alias("dy"),
        F.coalesce("b.score", F.lit(0)).cast("bigint").alias("pairs"))


def shapeless(st, src, ok, keys=Ob.OK):
    """Translations `st` as maps without a shape, with the frame of the source events and the support as bounds."""
    fr = src.groupBy(*Ob.OK).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("e"))
    z = F.lit(0).cast("bigint")
    return st.join(fr, Ob.OK).join(ok.select(*keys, "sx0", "sx1", "sy0", "sy1"), list(keys)).select(
        *keys, "dx", "dy", z.alias("ia"), z.alias("ib"), z.alias("ic"), z.alias("id"), ((F.col("a") + F.col("b")) * 0.5).alias("cx"),
        ((F.col("c") + F.col("e")) * 0.5).alias("cy"), F.greatest(F.lit(1.0), (F.col("b") - F.col("a")) * 0.5).alias("hx"),
        F.greatest(F.lit(1.0), (F.col("e") - F.col("c")) * 0.5).alias("hy"), F.col("sx0").alias("x0"), F.col("sx1").alias("x1"),
        F.col("sy0").alias("y0"), F.col("sy1").alias("y1"))


@query("m7_affine_fit")
def m7(spark, d):
    """Affine map of each object from its aligned displacement, by the coordinate search. Rows-only check."""
    _, rows, src, fut, *_ = object_sets(spark, d)
    ok = rows.filter("skip = ''")
    start = shapeless(aligned(ok, src, fut, (2, 0), 3, DEMO), src, ok)
    q = Ft.coordinate_search(src, fut, start, Ob.OK, Ob.OK, DEMO)
    return q.select(*Ob.OK, "dx", "dy", "ia", "ib", "ic", "id", "np", "pairs", r6("f1", "f1"))


TARGETS = 10
M_KEYS = [*Ob.OK, "m"]
CELLS12 = [(s, k) for s in (1, 2, 4) for k in (1, 3, 8, 32)]


def target_sets(spark, d):
    """Source, future events and translations of the targets m = 1 .. TARGETS of each instant; target m begins m - 1 days after it."""
    ev = events(spark, d)
    _, life, seg = label_tables(spark, d)
    i = cut_lineage(inst(life))
    t = i.withColumn("m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(TARGETS).cast("bigint")))).withColumn("lead", (F.col("m") - 1) * DAY)
    r = cut_lineage(B.support_rect(t, seg, life, DEMO, 2 * DAY, "lead", DAY, 0.5, 1.0 / DAY))
    src = cut_lineage(Ob.source_events(ev, i, seg, DEMO, DAY, 0.5, TILE))
    fut = cut_lineage(Ob.future_events(ev, r, DEMO, "lead", DAY, TILE, M_KEYS))
    life_ok = (F.col("t_e") - 2 * DAY >= F.col("t_first")) & (F.col("t_e") + F.col("m") * DAY <= F.col("t_last"))
    ok = cut_lineage(Ob.skip_reason(r, life_ok, src, fut, 3, 3, keys=M_KEYS).filter("skip = ''"))
    src = src.join(ok.select(*Ob.OK).distinct(), Ob.OK, "left_semi")
    fut = fut.join(ok.select(*M_KEYS), M_KEYS, "left_semi")
    start = shapeless(aligned(ok, src, fut, (F.col("m") * int(V_X), 0), 3, DEMO, M_KEYS), src, ok, M_KEYS)
    return src, fut, start


def target_maps(spark, d):
    src, fut, start = target_sets(spark, d)
    return src, fut, cut_lineage(start), Ft.staged_affine(src, fut, start, Ob.OK, F.col("m"), DEMO)


@query("m7_affine_targets")
def m7t(spark, d):
    """Translation and affine map of ten targets of each object on twelve grids, summed over the objects of a recording. Rows-only check."""
    src, fut, start, q = target_maps(spark, d)
    fitted = [f"_{n}" for n in Ft.PARAMS]
    maps = start.join(q.select(*M_KEYS, *[F.col(n).alias(f) for n, f in zip(Ft.PARAMS, fitted)]).hint("merge"), M_KEYS)
    f = V.scores(Ft.target_grades(src, fut, maps, {"translation": Ft.PARAMS, "affine": fitted}, Ob.OK, CELLS12, DEMO))
    return f.groupBy("model", "rec", "m", "s", "k").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n1").alias("n_pred"), F.sum("n2").alias("n_future"),
                                                       F.sum("pairs").alias("pairs"), r6(F.avg("f1"), "f1"))


@query("m1_sharpness_velocity")
def m1(spark, d):
    """Velocity of each object (px per day) by template sharpness. Rows-only check."""
    _, rows, src, *_ = object_sets(spark, d)
    ok = rows.filter("skip = ''")
    e = src.join(ok.select(*Ob.OK), Ob.OK, "left_semi").select(*Ob.OK, "x", "y", "p", (F.col("tr") - DAY).alias("dt"))
    v = Ft.sharpness_velocity(e, Ob.OK, ok.select(*Ob.OK, "vx", "vy"), tick=1.0 / DAY, floor=4.0)
    return v.select(*Ob.OK, r6("vx", "vx"), r6("vy", "vy"))
