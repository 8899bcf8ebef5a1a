"""Labelled boxes."""
from pyspark.sql import Window, functions as F

from ..functions import cols as C
from ..operators import boxes as B, trains as Tr, windows as Wn
from ..operators.stats import exact_quantiles
from ..sensor import DAY, DEMO
from ..session import cut_lineage
from ..sources.ingest import lighting
from ..sources.tables import BIN6H, events, raw_labels
from .q_ingest import EV, keys, r6
from .q_trains import GK, HOT, SPAN, hot, span_events
from .registry import query
from .sqltext import BOXES

TILE = 4
SETTINGS = ((2 * DAY, 0), (2 * DAY, DAY))          # (T1, D) of the demo instants


def label_tables(spark, d):
    lab = B.clean_labels(raw_labels(spark, d))
    return lab, B.tracks(lab), B.segments(lab, DAY)


def inst(life):
    return B.instants(life, 5 * DAY, 2 * DAY, 3 * DAY, 2 * DAY).select("rec", "track_id", "t_first", "t_last", "t_e")


INST = """inst AS (SELECT rec, track_id, t_first, t_last, unnest(generate_series(t_first + 172800000000, t_last - 172800000000,
 259200000000)) AS t_e FROM tracks WHERE t_last - t_first >= 432000000000)"""


def at_sql(src, t, prefix="b"):
    """Rows of `src` (with t_first, t_last) and the box at time t."""
    tc = f"greatest(least(CAST({t} AS DOUBLE), s0.t_last), s0.t_first)"
    f = f"(CASE WHEN g.tb IS NULL THEN 0.0 ELSE CAST({tc} - g.ta AS DOUBLE)/(g.tb - g.ta) END)"
    cols = ", ".join(f"g.{c}a + {f}*(coalesce(g.{c}b, g.{c}a) - g.{c}a) AS {prefix}{c}" for c in "xywh")
    return (f"(SELECT s0.*, {cols} FROM {src} s0 JOIN seg g ON g.rec = s0.rec AND g.track_id = s0.track_id AND "
            f"g.ta <= {tc} AND ({tc} < g.tb OR (g.tb IS NULL AND {tc} = g.ta)))")


def vel_sql(src, t, span):
    a = at_sql(src, t, "b")
    b = at_sql(f"(SELECT *, greatest(t_first, {t} - {span}) AS t0_ FROM {a})", "s0.t0_", "o")
    d = "((%s - t0_)*(1.0/86400000000)::DOUBLE)" % t
    return (f"(SELECT * EXCLUDE (ox, oy, ow, oh), CASE WHEN {d} > 0 THEN ((bx+bw*0.5)-(ox+ow*0.5))/{d} ELSE 0.0 END AS vx, "
            f"CASE WHEN {d} > 0 THEN ((b_y+bh*0.5)-(oy+oh*0.5))/{d} ELSE 0.0 END AS vy FROM (SELECT * RENAME (by AS b_y) FROM {b}))")


@query("w12_tracks", f"WITH {BOXES} SELECT rec, track_id, class_id, t_first, t_last, n_frames FROM tracks")
def w12(spark, d):
    return B.tracks(B.clean_labels(raw_labels(spark, d))).select("rec", "track_id", "class_id", "t_first", "t_last", "n_frames")


@query("g2_instants", f"WITH {BOXES}, {INST} SELECT rec, track_id, t_e FROM inst")
def g2(spark, d):
    return inst(label_tables(spark, d)[1]).select("rec", "track_id", "t_e")


@query("j4_interpolated_box", f"""WITH {BOXES}, {INST} SELECT rec, track_id, t_e, round(bx,6) AS x, round(by,6) AS y, round(bw,6) AS
 w, round(bh,6) AS h FROM {at_sql('inst', 's0.t_e')}""")
def j4(spark, d):
    _, life, seg = label_tables(spark, d)
    p = B.box_at(inst(life), seg, life, DAY, "t_e")
    return p.select("rec", "track_id", "t_e", r6("bx", "x"), r6("by", "y"), r6("bw", "w"), r6("bh", "h"))


IN_BOX = BOXES + """, ib0 AS (SELECT e.rec, e.seq, e.w, e.t_us, e.x, e.y, e.p, g.track_id,
 CASE WHEN g.tb IS NULL THEN 0.0 ELSE CAST(e.t_us - g.ta AS DOUBLE)/(g.tb-g.ta) END AS f, g.xa, g.ya, g.wa, g.ha,
 coalesce(g.xb,g.xa) AS xb, coalesce(g.yb,g.ya) AS yb, coalesce(g.wb,g.wa) AS wb, coalesce(g.hb,g.ha) AS hb FROM ev e JOIN seg g
 ON e.rec = g.rec AND e.t_us >= g.ta AND (e.t_us < g.tb OR (g.tb IS NULL AND e.t_us = g.ta))), ib1 AS (SELECT rec, seq, w, t_us, x,
 y, p, track_id, xa+f*(xb-xa) AS bx, ya+f*(yb-ya) AS by, wa+f*(wb-wa) AS bw, ha+f*(hb-ha) AS bh FROM ib0),
 ib AS (SELECT * FROM ib1 WHERE x >= bx - 0.5 AND x <= bx+bw+0.5 AND y >= by - 0.5 AND y <= by+bh+0.5)"""


@query("j5_in_box", f"WITH {IN_BOX} SELECT rec, track_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM ib GROUP BY ALL")
def j5(spark, d):
    seg = label_tables(spark, d)[2]
    return B.in_box(events(spark, d), seg, DEMO, 0.5, TILE).groupBy("rec", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query("p9_box_warp", f"""WITH {IN_BOX}, r0 AS (SELECT ib.rec, ib.seq, ib.track_id, ib.x, ib.y, ib.bx, ib.by AS b_y, ib.bw, ib.bh,
 ib.t_us + 86400000000 AS tr, t.t_first, t.t_last FROM ib JOIN tracks t USING (rec, track_id)), r AS (SELECT * RENAME (by AS n_y)
 FROM {at_sql('(SELECT rec, seq, track_id, x, y, bx AS cx, b_y AS cy, bw AS cw, bh AS ch, tr, t_first, t_last FROM r0)', 's0.tr')}),
 m AS (SELECT rec, track_id, CAST(round_even((bx+bw*0.5)+(x-(cx+cw*0.5))*(bw/greatest(cw,1e-9)),0) AS BIGINT) AS xm, CAST(round_even(
 (n_y+bh*0.5)+(y-(cy+ch*0.5))*(bh/greatest(ch,1e-9)),0) AS BIGINT) AS ym FROM r) SELECT rec, xm, ym, count(*) AS n FROM m
 GROUP BY ALL""")
def p9(spark, d):
    _, life, seg = label_tables(spark, d)
    return moved_with_box(events(spark, d), seg, life, DAY, 0.5).groupBy("rec", "xm", "ym").agg(F.count(F.lit(1)).alias("n"))


def moved_with_box(ev, seg, life, shift, margin):
    """In-box events moved by the box map from their own time to `shift` later."""
    e = B.in_box(ev, seg, DEMO, margin, TILE).withColumnsRenamed({c: "c" + c[1] for c in ("bx", "by", "bw", "bh")})
    e = B.box_at(e.withColumn("_to", F.col("t_us") + shift), seg, life, DAY, "_to")
    return e.withColumns({"xm": C.rint_bigint(C.warp_box("x", "cx", "cw", "bx", "bw")),
                          "ym": C.rint_bigint(C.warp_box("y", "cy", "ch", "by", "bh"))})


@query("j6_track_velocity", f"""WITH {BOXES}, {INST} SELECT rec, track_id, t_e, round(vx,6) AS vx, round(vy,6) AS vy FROM
 {vel_sql('inst', 't_e', 172800000000)}""")
def j6(spark, d):
    _, life, seg = label_tables(spark, d)
    return B.velocity(inst(life), seg, life, DAY, 2 * DAY, "t_e", 1.0 / DAY).select("rec", "track_id", "t_e", r6("vx", "vx"),
                                                                                    r6("vy", "vy"))


RECT0 = f"""iv AS (SELECT rec, track_id, t_first, t_last, t_e, vx, vy, t_e + 43200000000.0 AS mid FROM
 {vel_sql('inst', 't_e', 172800000000)}), ir AS (SELECT *, sqrt(vx*vx+vy*vy) AS speed FROM {at_sql('iv', 's0.mid')}), rect0 AS
 (SELECT rec, track_id, t_e, vx, vy, speed, greatest(0, floor(bx - (0.5 + speed*0.5))) AS x0, least(15, ceil(bx+bw+(0.5+speed*0.5)))
 AS x1, greatest(0, floor(by - (0.5 + speed*0.5))) AS y0, least(7, ceil(by+bh+(0.5+speed*0.5))) AS y1 FROM ir), rect AS (SELECT
 rec, track_id, t_e, vx, vy, speed, CASE WHEN x1>=x0 AND y1>=y0 THEN CAST(x0 AS BIGINT) END AS sx0, CASE WHEN x1>=x0 AND y1>=y0 THEN
 CAST(x1 AS BIGINT) END AS sx1, CASE WHEN x1>=x0 AND y1>=y0 THEN CAST(y0 AS BIGINT) END AS sy0, CASE WHEN x1>=x0 AND y1>=y0 THEN
 CAST(y1 AS BIGINT) END AS sy1 FROM rect0)"""


def rects(spark, d):
    lab, life, seg = label_tables(spark, d)
    return B.support_rect(inst(life), seg, life, DEMO, 2 * DAY, 0, DAY, 0.5, 1.0 / DAY), seg, life


@query("j7_support_rect", f"WITH {BOXES}, {INST}, {RECT0} SELECT rec, track_id, t_e, sx0, sx1, sy0, sy1 FROM rect")
def j7(spark, d):
    return rects(spark, d)[0].select("rec", "track_id", "t_e", "sx0", "sx1", "sy0", "sy1")


@query("j8_overlap", f"""WITH {BOXES}, {INST}, {RECT0}, oth AS (SELECT * FROM {at_sql('''(SELECT DISTINCT i.t_e, i.rec, t.track_id,
 t.t_first, t.t_last FROM inst i JOIN tracks t ON i.rec = t.rec AND i.t_e BETWEEN t.t_first AND t.t_last)''', 's0.t_e')}) SELECT
 rec, track_id, t_e, CASE WHEN sx0 IS NULL THEN -1 WHEN EXISTS (SELECT 1 FROM oth o WHERE o.rec = rect.rec AND o.t_e = rect.t_e AND
 o.track_id <> rect.track_id AND o.bx <= sx1 AND o.bx+o.bw >= sx0 AND o.by <= sy1 AND o.by+o.bh >= sy0) THEN 1 ELSE 0 END AS overlap
 FROM rect""")
def j8(spark, d):
    r, seg, _ = rects(spark, d)
    return B.overlap_flag(r, seg, DEMO, TILE).select("rec", "track_id", "t_e", "overlap")


CENTRES = """wc AS (SELECT rec, track_id, t_first, t_last, unnest(generate_series((t_first + 43199999999)//86400000000,
 (t_last - 43200000000)//86400000000)) AS w FROM tracks WHERE t_last >= 43200000000), bc0 AS (SELECT * FROM """ + at_sql(
    "wc", "(s0.w*86400000000 + 43200000000)") + """), bc1 AS (SELECT rec, w, track_id, greatest(0.0::DOUBLE, bx) AS x0,
 greatest(0.0::DOUBLE, by) AS y0, least(16.0::DOUBLE, bx+bw) AS x1, least(8.0::DOUBLE, by+bh) AS y1 FROM bc0), bc AS (SELECT rec, w,
 track_id, x0 AS bx, y0 AS by, x1-x0 AS bw, y1-y0 AS bh FROM bc1 WHERE x1 > x0 AND y1 > y0)"""


@query("j9_boxes_at_centres", f"""WITH {BOXES}, {CENTRES} SELECT rec, w, track_id, round(bx,6) AS x, round(by,6) AS y, round(bw,6) AS
 bw, round(bh,6) AS bh FROM bc""")
def j9(spark, d):
    b = B.boxes_at_centres(label_tables(spark, d)[2], DEMO)
    return b.select("rec", "w", "track_id", r6("bx", "x"), r6("by", "y"), r6("bw", "bw"), r6("bh", "bh"))


NEAREST = """nf AS (SELECT rec, track_id, t_us // 86400000000 AS w0, t_us, x, y, w AS bw_, h AS bh_, row_number() OVER (PARTITION BY rec,
 track_id, t_us // 86400000000 ORDER BY abs(t_us - ((t_us // 86400000000)*86400000000 + 43200000000)), t_us) AS rk FROM boxes),
 nb0 AS (SELECT rec, track_id, w0 AS w, t_us, greatest(0.0::DOUBLE,x) AS x0, greatest(0.0::DOUBLE,y) AS y0, least(16.0::DOUBLE,
 x+bw_) AS x1, least(8.0::DOUBLE, y+bh_) AS y1 FROM nf WHERE rk = 1), nb AS (SELECT rec, w, track_id, t_us, x0 AS bx, y0 AS by, x1-x0
 AS bw, y1-y0 AS bh FROM nb0 WHERE x1 > x0 AND y1 > y0)"""


@query("j10_nearest_frame", f"""WITH {BOXES}, {NEAREST} SELECT rec, w, track_id, t_us, round(bx,6) AS x, round(by,6) AS y, round(bw,6)
 AS bw, round(bh,6) AS bh FROM nb""")
def j10(spark, d):
    b = B.boxes_nearest(label_tables(spark, d)[0], DEMO)
    return b.select("rec", "w", "track_id", "t_us", r6("bx", "x"), r6("by", "y"), r6("bw", "bw"), r6("bh", "bh"))


MASK = """px AS (SELECT DISTINCT rec, w, x, y FROM bc, range(16) a(x), range(8) b(y) WHERE x >= ceil(bx - 0.5) AND x < ceil(bx+bw+0.5)
 AND y >= ceil(by - 0.5) AND y < ceil(by+bh+0.5))"""


@query("j11_box_union", f"""WITH {BOXES}, {CENTRES}, {MASK}, a AS (SELECT rec, w, count(*) AS n_pixels, count(DISTINCT (y//4)*4+x//4) AS
 n_blocks FROM px GROUP BY ALL), e AS (SELECT rec, w, count(*) AS n_events FROM ev SEMI JOIN px USING (rec, w, x, y) GROUP BY ALL)
 SELECT rec, w, n_pixels, n_blocks, coalesce(n_events, 0) AS n_events FROM a LEFT JOIN e USING (rec, w)""")
def j11(spark, d):
    px = B.box_pixels(B.boxes_at_centres(label_tables(spark, d)[2], DEMO), DEMO, 0.5)
    n = events(spark, d).join(px, ["rec", "w", "x", "y"], "left_semi").groupBy("rec", "w").agg(
        F.count(F.lit(1)).alias("n_events"))
    a = px.groupBy("rec", "w").agg(F.count(F.lit(1)).alias("n_pixels"),
                                   F.countDistinct(C.block_id("x", "y", 4, 16)).alias("n_blocks"))
    return a.join(n, ["rec", "w"], "left").na.fill(0, ["n_events"])


VEH = (1, 3, 4, 5, 6)      # fixed class set


@query("j12_box_shares", f"""WITH {BOXES}, lf AS (SELECT rec, min(t_us) AS a, max(t_us) AS b FROM ev GROUP BY rec), pj AS (SELECT rec,
 unnest(generate_series((a + 172799999999)//172800000000, (b - 21599999999)//172800000000)) AS j FROM lf), pe AS (SELECT ev.rec,
 ev.t_us//172800000000 AS j, x, y, seq FROM ev WHERE t_us % 172800000000 < 21600000000), pe2 AS (SELECT pe.* FROM pe SEMI JOIN pj
 USING (rec, j)), tj AS (SELECT pj.rec, pj.j, t.track_id, t.class_id, t.t_first, t.t_last FROM pj JOIN tracks t ON t.rec = pj.rec AND
 pj.j*172800000000 + 10800000000 BETWEEN t.t_first AND t.t_last), bj AS (SELECT * FROM {at_sql('tj', '(s0.j*172800000000 + 10800000000)')}),
 bs AS (SELECT 'A' AS cls, * FROM bj UNION ALL SELECT 'L', * FROM bj WHERE t_last - t_first >= 432000000000 UNION ALL SELECT 'V', *
 FROM bj WHERE t_last - t_first >= 432000000000 AND class_id IN (1,3,4,5,6)), px AS (SELECT DISTINCT cls, rec, j, x, y FROM bs,
 range(16) a(x), range(8) b(y) WHERE x >= ceil(bx-1) AND x <= floor(bx+bw+1) AND y >= ceil(by-1) AND y <= floor(by+bh+1)),
 cl(cls) AS (VALUES ('A'),('L'),('V')), pn AS (SELECT cls, rec, count(*) AS pixels FROM px GROUP BY ALL), en AS (SELECT cls, rec,
 count(*) AS events_in FROM pe2 JOIN px USING (rec, j, x, y) GROUP BY ALL), tot AS (SELECT rec, count(*) AS windows FROM pj GROUP BY
 rec), ne AS (SELECT rec, count(*) AS events FROM pe2 GROUP BY rec), emp AS (SELECT cls, pj.rec, count(*) AS windows_empty FROM pj, cl
 ANTI JOIN px ON px.cls = cl.cls AND px.rec = pj.rec AND px.j = pj.j GROUP BY ALL) SELECT cl.cls, tot.rec, windows, coalesce(events,0)
 AS events, coalesce(pixels,0) AS pixels, coalesce(events_in,0) AS events_in, coalesce(windows_empty,0) AS windows_empty FROM tot
 CROSS JOIN cl LEFT JOIN ne ON ne.rec = tot.rec LEFT JOIN pn ON pn.rec = tot.rec AND pn.cls = cl.cls LEFT JOIN en ON en.rec = tot.rec
 AND en.cls = cl.cls LEFT JOIN emp ON emp.rec = tot.rec AND emp.cls = cl.cls""")
def j12(spark, d):
    ev = events(spark, d)
    _, life, seg = label_tables(spark, d)
    return box_shares(ev, life, seg, DEMO, 2 * DAY, DAY // 4, 1.0, 5 * DAY, VEH)


def box_shares(ev, life, seg, sensor, every, length, margin, min_life, classes):
    """Events and pixels of one probe window per period inside the boxes of all / long / vehicle tracks."""
    pr = Wn.probe_windows(ev, every, length)
    pe = Wn.probe_events(ev, pr, every, length).select("rec", "j", "x", "y")
    mid = F.col("j") * every + length // 2
    # tracks meet probe windows on their own probe numbers, so no range join is needed
    alive = life.withColumn("j", F.explode(F.sequence(F.floor(F.col("t_first") / every), F.floor(F.col("t_last") / every))))
    alive = alive.join(pr, ["rec", "j"], "left_semi").withColumn("_mid", mid).filter("_mid BETWEEN t_first AND t_last")
    b = B.box_at(alive, seg, life, sensor.t0, "_mid")
    long_ = F.col("t_last") - F.col("t_first") >= min_life
    sets = F.array_compact(F.array(F.lit("A"), F.when(long_, "L"), F.when(long_ & F.col("class_id").isin(*classes), "V")))
    px = B.box_pixels(b.withColumn("cls", F.explode(sets)), sensor, margin, ("cls", "rec", "j"), closed=True)
    pj = pr.withColumn("cls", F.explode(F.array(F.lit("A"), F.lit("L"), F.lit("V"))))
    n = px.groupBy("cls", "rec", "j").agg(F.count(F.lit(1)).alias("pixels"))
    e = pe.join(px, ["rec", "j", "x", "y"]).groupBy("cls", "rec", "j").agg(F.count(F.lit(1)).alias("events_in"))
    tot = pe.groupBy("rec", "j").agg(F.count(F.lit(1)).alias("events"))
    per = pj.join(n, ["cls", "rec", "j"], "left").join(e, ["cls", "rec", "j"], "left").join(tot, ["rec", "j"], "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)                                       # noqa: E731
    return per.groupBy("cls", "rec").agg(F.count(F.lit(1)).alias("windows"), z("events"), z("pixels"), z("events_in"),
                                         F.count_if(F.col("pixels").isNull()).alias("windows_empty"))


# ---- label clock and label convention

J19_SQL = f"""WITH {BOXES}, cv(conv, off) AS (VALUES ('as_stored', 0::BIGINT), ('minus_offset', 172800000000)), wc AS (SELECT conv, off, rec,
 track_id, t_first, t_last, unnest(generate_series(greatest(0, (t_first - off + 43199999999)//86400000000), CAST(floor((t_last - off -
 43200000000)/86400000000.0::DOUBLE) AS BIGINT))) AS w FROM tracks, cv), bc0 AS (SELECT * FROM {at_sql('wc', '(s0.w*86400000000 + 43200000000 + s0.off)')}), bc1 AS (SELECT
 conv, rec, w, track_id, greatest(0.0::DOUBLE, bx) AS x0, greatest(0.0::DOUBLE, by) AS y0, least(16.0::DOUBLE, bx+bw) AS x1,
 least(8.0::DOUBLE, by+bh) AS y1 FROM bc0), bc AS (SELECT conv, rec, w, track_id, x0 AS bx, y0 AS by, x1-x0 AS bw, y1-y0 AS bh FROM bc1
 WHERE x1 > x0 AND y1 > y0), px AS (SELECT conv, rec, w, track_id, x, y, (x >= ceil(bx) AND x < ceil(bx+bw) AND y >= ceil(by) AND y <
 ceil(by+bh)) AS inb, (x >= ceil(bx-1) AND x < ceil(bx+bw+1) AND y >= ceil(by-1) AND y < ceil(by+bh+1)) AS in1 FROM bc, range(16) a(x),
 range(8) b(y) WHERE x >= ceil(bx-3) AND x < ceil(bx+bw+3) AND y >= ceil(by-3) AND y < ceil(by+bh+3)), ec AS (SELECT rec, w, x, y,
 count(*) AS c FROM ev GROUP BY ALL), d AS (SELECT conv, rec, w, track_id, count(*) FILTER (inb) AS a_in, count(*) FILTER (NOT in1) AS
 a_ring, coalesce(sum(c) FILTER (inb),0) AS e_in, coalesce(sum(c) FILTER (NOT in1),0) AS e_ring FROM px LEFT JOIN ec USING (rec, w, x,
 y) GROUP BY ALL), r AS (SELECT conv, CASE WHEN e_ring > 0 THEN (e_in/a_in)/(e_ring/a_ring) ELSE 'Infinity'::DOUBLE END AS ratio FROM
 d WHERE a_in > 0 AND a_ring > 0), m AS (SELECT conv, count(*) AS n_boxes, median(ratio) AS med FROM r GROUP BY conv)
 SELECT conv, n_boxes, round(med,6) AS median_ratio, med = max(med) OVER () AS chosen FROM m"""


@query("j19_label_clock", J19_SQL)
def j19(spark, d):
    ev = events(spark, d)
    boxes = B.boxes_at_centres(B.segments(B.clean_labels(raw_labels(spark, d)), DAY), DEMO)
    # the offset is two windows; what it moves before the first window has no events to compare with
    conv = F.explode(F.array(*[F.struct(F.lit(c).alias("conv"), F.lit(o).alias("off")) for c, o in (("as_stored", 0), ("minus_offset", 2))]))
    moved = boxes.withColumn("_c", conv).withColumns({"conv": F.col("_c.conv"), "w": F.col("w") - F.col("_c.off")}).filter("w >= 0").drop("_c")
    m = clock_ratio(ev, moved, DEMO, (1.0, 3.0), TILE)
    return m.select("conv", "n_boxes", r6("med", "median_ratio"),
                    (F.col("med") == F.max("med").over(Window.partitionBy())).alias("chosen"))


def clock_ratio(ev, boxes, sensor, ring, tile=64):
    """Median over boxes of (events per pixel in the box) / (events per pixel in the ring around it), per convention. `boxes` has one box per
    conv, rec, w, track_id; `ring` is the inner and the outer margin. Boxes meet counted pixels on tiles, and areas come from their bounds."""
    key = ["conv", "rec", "w", "track_id"]
    b = B.pixel_bounds(boxes, sensor, ring[1], "_o")
    b = B.pixel_bounds(B.pixel_bounds(b, sensor, ring[0], "_m"), sensor, 0.0, "_i")
    b = b.withColumns({"ai": B.bounds_area("_i"), "ao": B.bounds_area("_o") - B.bounds_area("_m")}).filter("ai > 0 AND ao > 0")
    b = cut_lineage(b.select(*key, "ai", "ao", *[f"{n}{c}" for n in ("_o", "_m", "_i") for c in ("xa", "xb", "ya", "yb")]))
    t = lambda lo, hi: F.explode(F.sequence(C.idiv(lo, tile), C.idiv(hi, tile)))                     # noqa: E731
    at = b.withColumn("_tx", t("_oxa", "_oxb")).withColumn("_ty", t("_oya", "_oyb"))
    c = ev.groupBy("rec", "w", "x", "y").agg(F.count(F.lit(1)).alias("c")).withColumns({"_tx": C.idiv("x", tile), "_ty": C.idiv("y", tile)})
    hit = at.join(c.hint("merge"), ["rec", "w", "_tx", "_ty"]).filter(B.in_bounds("_o"))
    z = lambda v: F.sum(F.when(v, F.col("c")).otherwise(0))                                      # noqa: E731
    e = hit.groupBy(*key).agg(z(B.in_bounds("_i")).alias("ei"), z(~B.in_bounds("_m")).alias("eo"))
    r = b.select(*key, "ai", "ao").join(e.hint("merge"), key, "left").na.fill(0, ["ei", "eo"])
    r = r.withColumn("ratio", B.density_ratio(F.col("ei"), F.col("eo"), F.col("ai"), F.col("ao"))).filter("ratio IS NOT NULL")
    q = exact_quantiles(cut_lineage(r), ["conv"], "ratio", [0.5])
    return q.select("conv", F.col("n").alias("n_boxes"), F.col("q0").alias("med"))


J20_SQL = f"""WITH {BOXES}, sh(s) AS (VALUES (-21600000000::BIGINT),(0),(21600000000)), cc(c) AS (VALUES ('corner'),('center')), sp AS
 (SELECT rec, min(t_us) AS t0 FROM ev GROUP BY rec), fr AS (SELECT DISTINCT b.rec, b.t_us, s, b.t_us + s AS tau FROM boxes b JOIN sp
 USING (rec), sh WHERE b.t_us + s >= t0 AND b.t_us + s + 21600000000 <= t0 + 864000000000), px AS (SELECT DISTINCT fr.rec, fr.t_us,
 s, c, px_.x, py_.y FROM fr JOIN boxes b ON b.rec = fr.rec AND b.t_us = fr.t_us, cc, range(16) px_(x), range(8) py_(y) WHERE
 px_.x >= ceil(b.x - CASE WHEN c='center' THEN 0.5*b.w ELSE 0 END) AND px_.x <= floor(b.x - CASE WHEN c='center' THEN 0.5*b.w ELSE 0
 END + b.w) AND py_.y >= ceil(b.y - CASE WHEN c='center' THEN 0.5*b.h ELSE 0 END) AND py_.y <= floor(b.y - CASE WHEN c='center' THEN
 0.5*b.h ELSE 0 END + b.h)), ai AS (SELECT s, c, count(*) AS area_in FROM px GROUP BY ALL), ei AS (SELECT s, c, count(*) AS events_in
 FROM px JOIN ev ON ev.rec = px.rec AND ev.x = px.x AND ev.y = px.y AND ev.t_us >= px.t_us + s AND ev.t_us < px.t_us + s + 21600000000
 GROUP BY ALL), et AS (SELECT s, count(*) AS n FROM fr JOIN ev ON ev.rec = fr.rec AND ev.t_us >= tau AND ev.t_us < tau + 21600000000
 GROUP BY ALL), nf AS (SELECT s, count(*) AS n_frames FROM fr GROUP BY s), q AS (SELECT s, c, n_frames, coalesce(events_in,0) AS
 events_in, coalesce(area_in,0) AS area_in, coalesce(n,0) - coalesce(events_in,0) AS events_out, n_frames*128 - coalesce(area_in,0) AS
 area_out FROM nf CROSS JOIN cc LEFT JOIN ai USING (s,c) LEFT JOIN ei USING (s,c) LEFT JOIN et USING (s)) SELECT s, c, n_frames,
 events_in, area_in, events_out, area_out, round((events_in/nullif(area_in,0))/nullif(events_out/nullif(area_out,0),0),6) AS rho FROM q"""


@query("j20_label_convention", J20_SQL)
def j20(spark, d):
    ev = events(spark, d)
    lab = label_tables(spark, d)[0]
    return convention_counts(ev, lab, DEMO, (-BIN6H, 0, BIN6H), BIN6H, 10 * DAY).withColumn("rho", r6("rho"))


def convention_counts(ev, labels, sensor, shifts, frame_us, span_us):
    """Events and area inside and outside the boxes of each frame, per clock shift and box convention.

    Shifted frames meet events on the frame clock: frame times are multiples of `frame_us`, so the events of a frame are one
    bucket and the join is an equi-join."""
    t0 = ev.groupBy("rec").agg(F.min("t_us").alias("t0"))
    s = F.explode(F.array(*[F.lit(v).cast("bigint") for v in shifts])).alias("s")
    c = F.explode(F.array(F.lit("corner"), F.lit("center"))).alias("c")
    fr = labels.select("rec", "t_us").distinct().join(t0, "rec").select("rec", "t_us", "t0", s)
    fr = fr.withColumn("tau", F.col("t_us") + F.col("s")).filter(
        (F.col("tau") >= F.col("t0")) & (F.col("tau") + frame_us <= F.col("t0") + span_us))
    fr = fr.select("rec", "t_us", "s", C.idiv("tau", frame_us).alias("b"))
    half = lambda k: F.when(F.col("c") == "center", F.col(k) * 0.5).otherwise(0.0)               # noqa: E731
    bx = labels.select("rec", "t_us", "x", "y", "w", "h", c).select(
        "rec", "t_us", "c", (F.col("x") - half("w")).alias("bx"), (F.col("y") - half("h")).alias("by"),
        F.col("w").alias("bw"), F.col("h").alias("bh"))
    px = B.box_pixels(bx.join(fr, ["rec", "t_us"]), sensor, 0.0, ("rec", "b", "s", "c"), closed=True)
    cnt = ev.groupBy("rec", C.idiv("t_us", frame_us).alias("b"), "x", "y").agg(F.count(F.lit(1)).alias("n"))
    ins = px.join(cnt, ["rec", "b", "x", "y"], "left").groupBy("s", "c").agg(
        F.count(F.lit(1)).alias("area_in"), F.coalesce(F.sum("n"), F.lit(0)).alias("events_in"))
    tot = fr.join(cnt.groupBy("rec", "b").agg(F.sum("n").alias("n")), ["rec", "b"], "left").groupBy("s").agg(
        F.count(F.lit(1)).alias("n_frames"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    q = tot.join(ins, "s").select("s", "c", "n_frames", "events_in", "area_in",
                                  (F.col("n") - F.col("events_in")).alias("events_out"),
                                  (F.col("n_frames") * (sensor.width * sensor.height) - F.col("area_in")).alias("area_out"))
    return q.withColumn("rho", C.ratio(C.ratio("events_in", "area_in"), C.ratio("events_out", "area_out")))


# ---- track statistics, crops, the densest eligible box

@query("a38_track_stats", f"""WITH {BOXES}, {INST}, v AS (SELECT rec, track_id, count(*) AS n_instants, median(sqrt(vx*vx+vy*vy)) AS sp
 FROM {vel_sql('inst', 't_e', 172800000000)} GROUP BY ALL), a AS (SELECT rec, track_id, median(w*h) AS area FROM boxes GROUP BY ALL)
 SELECT t.rec, t.track_id, class_id, CASE WHEN class_id IN (1,3,4,5,6) THEN 'vehicles' ELSE 'other' END AS grp,
 (t_last-t_first)//1000000 AS duration, round(area,6) AS median_area, round(sp,6) AS median_speed, coalesce(n_instants,0) AS
 n_instants FROM tracks t JOIN a USING (rec, track_id) LEFT JOIN v USING (rec, track_id) WHERE t_last - t_first >= 432000000000""")
def a38(spark, d):
    lab, life, seg = label_tables(spark, d)
    sp = B.velocity(inst(life), seg, life, DAY, 2 * DAY, "t_e", 1.0 / DAY).groupBy("rec", "track_id").agg(
        F.count(F.lit(1)).alias("n_instants"), r6(F.median(F.hypot("vx", "vy")), "median_speed"))
    area = lab.groupBy("rec", "track_id").agg(r6(F.median(F.col("w") * F.col("h")), "median_area"))
    t = life.filter(F.col("t_last") - F.col("t_first") >= 5 * DAY).join(area, ["rec", "track_id"]).join(
        sp, ["rec", "track_id"], "left")
    return t.select("rec", "track_id", "class_id", F.when(F.col("class_id").isin(*VEH), "vehicles").otherwise("other").alias("grp"),
                    C.idiv(F.col("t_last") - F.col("t_first"), 1_000_000).alias("duration"), "median_area", "median_speed",
                    F.coalesce("n_instants", F.lit(0)).alias("n_instants"))


def crop_of(sensor, margin, max_w, max_h):
    """Columns of the integer crop around the central part of a box bx, by, bw, bh."""
    cw, ch = F.least("bw", F.lit(max_w)), F.least("bh", F.lit(max_h))
    x, y = F.col("bx") + (F.col("bw") - cw) / 2.0, F.col("by") + (F.col("bh") - ch) / 2.0
    big = lambda v: F.lit(v).cast("bigint")                                                     # noqa: E731
    return {"x0": F.greatest(big(0), F.floor(x) - margin), "y0": F.greatest(big(0), F.floor(y) - margin),
            "x1": F.least(big(sensor.width), F.ceil(x + cw) + margin), "y1": F.least(big(sensor.height), F.ceil(y + ch) + margin)}


def eligible(sensor, max_w, max_h, edge, moved):
    """A box that fits the crop, lies inside the sensor by `edge`, and whose centre moved by `moved` px since pbx, pby.."""
    dist = F.hypot(F.col("bx") + F.col("bw") / 2 - F.col("pbx") - F.col("pbw") / 2,
                   F.col("by") + F.col("bh") / 2 - F.col("pby") - F.col("pbh") / 2)
    return F.coalesce((F.col("bw") <= max_w) & (F.col("bh") <= max_h) & (F.col("bx") >= edge) & (F.col("by") >= edge)
                      & (F.col("bx") + F.col("bw") <= sensor.width - edge)
                      & (F.col("by") + F.col("bh") <= sensor.height - edge) & (dist >= moved), F.lit(False))


def with_previous_box(boxes):
    prev = boxes.select("rec", (F.col("w") + 1).alias("w"), "track_id", *[F.col(c).alias("p" + c) for c in
                                                                            ("bx", "by", "bw", "bh")])
    return boxes.join(prev, ["rec", "w", "track_id"], "left")


ELIG = """pb AS (SELECT a.*, b.bx AS pbx, b.by AS pby, b.bw AS pbw, b.bh AS pbh FROM bc a LEFT JOIN bc b ON a.rec=b.rec AND a.w=b.w+1 AND
 a.track_id=b.track_id), el AS (SELECT rec, w, track_id, bx, by, bw, bh, coalesce(bw <= 6 AND bh <= 5 AND bx >= 0.5 AND by >= 0.5 AND
 bx+bw <= 15.5 AND by+bh <= 7.5 AND sqrt((bx+bw/2-pbx-pbw/2)**2 + (by+bh/2-pby-pbh/2)**2) >= 1.0, false) AS eligible, least(bw,4) AS
 cw, least(bh,3) AS ch FROM pb), cr AS (SELECT rec, w, track_id, bx, by, bw, bh, eligible, CAST(greatest(0, floor(bx+(bw-cw)/2)-1) AS
 BIGINT) AS x0, CAST(greatest(0, floor(by+(bh-ch)/2)-1) AS BIGINT) AS y0, CAST(least(16, ceil(bx+(bw-cw)/2+cw)+1) AS BIGINT) AS x1,
 CAST(least(8, ceil(by+(bh-ch)/2+ch)+1) AS BIGINT) AS y1 FROM el)"""


@query("p11_crops", f"WITH {BOXES}, {CENTRES}, {ELIG} SELECT rec, w, track_id, eligible, x0, y0, x1, y1 FROM cr")
def p11(spark, d):
    b = with_previous_box(B.boxes_at_centres(label_tables(spark, d)[2], DEMO))
    return b.withColumns(crop_of(DEMO, 1, 4.0, 3.0)).withColumn("eligible", eligible(DEMO, 6, 5, 0.5, 1.0)).select(
        "rec", "w", "track_id", "eligible", "x0", "y0", "x1", "y1")


@query("t5_densest_box", f"""WITH {BOXES}, {SPAN}, {HOT}, {CENTRES}, {ELIG}, nx AS (SELECT k.rec, k.w AS g, e.w, e.x, e.y
 FROM keys k JOIN ev e ON e.rec = k.rec AND e.w = k.w+1 ANTI JOIN hot h ON h.rec = k.rec AND h.g = k.w AND h.x = e.x AND h.y = e.y),
 n AS (SELECT el.rec, el.w, el.track_id, count(*) AS n FROM el JOIN nx ON nx.rec = el.rec AND nx.w = el.w AND nx.x >= bx AND nx.x <
 bx+bw AND nx.y >= by AND nx.y < by+bh WHERE eligible GROUP BY ALL) SELECT stratum, rec, w, track_id, n FROM (SELECT CASE WHEN rec LIKE
 'day%' THEN 'day' ELSE 'night' END AS stratum, *, row_number() OVER (PARTITION BY CASE WHEN rec LIKE 'day%' THEN 'day' ELSE 'night' END
 ORDER BY n DESC, rec, w, track_id) AS rk FROM n) WHERE rk = 1""")
def t5(spark, d):
    ev = events(spark, d)
    h = hot(span_events(ev))
    nxt = ev.join(keys(ev).select("rec", F.col("w").alias("g"), (F.col("w") + 1).alias("w")), ["rec", "w"])
    nxt = Tr.without_hot(nxt, h, GK)
    b = with_previous_box(B.boxes_at_centres(label_tables(spark, d)[2], DEMO)).filter(eligible(DEMO, 6, 5, 0.5, 1.0))
    n = B.events_in_rects(nxt, b, tile=TILE, sensor=DEMO).groupBy("rec", "w", "track_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("rec", "w", "track_id", "n"), F.struct(-F.col("n"), F.col("rec"), F.col("w"), F.col("track_id")))
    return n.groupBy(lighting().alias("stratum")).agg(best.alias("b")).select("stratum", "b.*")
