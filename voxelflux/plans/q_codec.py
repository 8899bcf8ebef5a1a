"""Coding, subsets, envelopes and codec summaries."""
from pyspark.sql import Window, functions as F

from ..functions import cols as C
from ..operators import codec as K, curves as Cv, encode as E, subsets as Sb, voxels as V
from ..sensor import DAY, DEMO
from ..sources.ingest import lighting
from ..sources.tables import events
from .q_ingest import EV, GROUPS, KEYS, keys, r6, uleb_sql
from .registry import query
from .sqltext import h

SHARES, RHOS = (0.25, 0.5, 0.75), (0.25, 0.5, 0.75)
THR = {0.25: 4, 0.5: 8, 0.75: 12}


def idx_sql(src, key, cell):
    s, k = cell
    nx, ny = -(-16 // s), -(-8 // s)
    return (f"(SELECT {key}, ((least({k - 1}, tr*{k}//86400000000)*2 + p)*{ny} + y//{s})*{nx} + x//{s} AS vi, count(*) AS c "
            f"FROM {src} GROUP BY ALL)")


def bits_sql(src, key, cell):
    gap = f"(SELECT *, vi - coalesce(lag(vi) OVER (PARTITION BY {key} ORDER BY vi), 0) AS gap FROM {idx_sql(src, key, cell)})"
    return (f"(SELECT {key}, n, CAST(8*(b + {uleb_sql('n')}) AS BIGINT) AS bits FROM (SELECT {key}, CAST(sum(c) AS BIGINT) AS n, "
            f"sum({uleb_sql('gap')} + c - 1) AS b FROM {gap} GROUP BY ALL))")


@query("w5_encode", f"""WITH {EV}, g AS (SELECT *, vi - coalesce(lag(vi) OVER (PARTITION BY rec, w ORDER BY vi), 0) AS gap FROM
 {idx_sql('ev', 'rec, w', (2, 3))}) SELECT rec, w, CAST(sum(c) AS BIGINT) AS n, string_agg(gap || ':' || c, ' ' ORDER BY vi) AS code,
 CAST(sum({uleb_sql('gap')} + c - 1) + {uleb_sql('sum(c)')} AS BIGINT) AS n_bytes FROM g GROUP BY rec, w""")
def w5(spark, d):
    c = E.encode(events(spark, d), (2, 3), DEMO)
    code = F.array_join(F.transform("code", lambda v: F.concat_ws(":", v.gap.cast("string"), v.c.cast("string"))), " ")
    return c.select("rec", "w", "n", code.alias("code"), "n_bytes")


@query("w5_decode", f"""WITH {EV} SELECT rec, w, (least(2, tr*3//86400000000)*86400000000 + 2)//3 AS tr, (x//2)*2 AS x, (y//2)*2 AS y, p,
 count(*) AS n FROM ev GROUP BY ALL""")
def w5d(spark, d):
    c = E.encode(events(spark, d), (2, 3), DEMO)
    return E.decode(c, (2, 3), DEMO).groupBy("rec", "w", "tr", "x", "y", "p").agg(F.count(F.lit(1)).alias("n"))


def hash_maps(spark, d, n=4):
    """Motion maps made from the row keys: a smooth drift with small jumps, over the blocks that hold events."""
    b = events(spark, d).join(keys(events(spark, d)), ["rec", "w"], "left_semi").groupBy(
        "rec", F.col("w").alias("g"), C.block_id("x", "y", 4, 16).alias("block")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    b = b.withColumn("m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    hh = C.idiv(C.mix(17, F.col("g") * 64 + F.col("block"), "m"), 65536)
    b = b.withColumn("hh", hh)
    part = lambda div, mod, off: (C.idiv("hh", div) % mod - off)                                 # noqa: E731
    return b.withColumns({"dx": F.col("m") * 2 + part(1, 3, 1), "dy": part(3, 3, 1), "ia": part(9, 3, 1), "ib": part(27, 3, 1),
                          "ic": part(81, 3, 1), "id": part(243, 3, 1)}).drop("hh")


MAPS = f"""mb AS (SELECT DISTINCT rec, w AS g, (y//4)*4 + x//4 AS block FROM ev SEMI JOIN keys USING (rec, w)), mm AS (SELECT rec, g, block, m,
 {h(17, 'g*64 + block', 'm')}//65536 AS hh FROM mb, range(1::BIGINT, 4) t(m)), maps AS (SELECT rec, g, block, m, 2*m + hh%3 - 1 AS dx,
 (hh//3)%3 - 1 AS dy, (hh//9)%3 - 1 AS ia, (hh//27)%3 - 1 AS ib, (hh//81)%3 - 1 AS ic, (hh//243)%3 - 1 AS id FROM mm)"""


def zz(c):
    return f"(CASE WHEN {c} >= 0 THEN 2*({c}) ELSE -2*({c}) - 1 END)"


PAR = ("dx", "dy", "ia", "ib", "ic", "id")
DIFF = ", ".join(f"{c} - coalesce(lag({c}) OVER q, 0) AS d_{c}" for c in PAR)


@query("w6_map_code", f"""WITH {EV}, {KEYS}, {MAPS}, dd AS (SELECT rec, g, block, m, {DIFF} FROM maps WINDOW q AS (PARTITION BY rec, g, block
 ORDER BY m)) SELECT rec, g, count(*) AS n_maps, CAST(8*sum({' + '.join(uleb_sql(zz('d_' + c)) for c in PAR)}) AS BIGINT) AS map_bits,
 CAST(sum({' + '.join(zz('d_' + c) for c in PAR)}) AS BIGINT) AS code_sum FROM dd GROUP BY ALL""")
def w6(spark, d):
    m = hash_maps(spark, d)
    z = E.map_deltas(m)
    s = z.groupBy("rec", "g").agg(F.count(F.lit(1)).alias("n_maps"), F.sum(sum((F.col(c) for c in PAR[1:]), F.col("dx"))).alias("code_sum"))
    return s.join(E.map_bits(m), ["rec", "g"]).select("rec", "g", "n_maps", "map_bits", "code_sum")


@query("w6_map_decode", f"""WITH {EV}, {KEYS}, {MAPS} SELECT rec, g, block, m, dx, dy, ia, ib, ic, id FROM maps""")
def w6d(spark, d):
    return E.decode_maps(E.map_deltas(hash_maps(spark, d)))


@query("m8_reconstruct", f"""WITH {EV}, {KEYS}, {MAPS}, k AS (SELECT ev.rec, w AS g, tr, x, y, p, (y//4)*4+x//4 AS block FROM ev SEMI JOIN keys
 USING (rec, w)), j AS (SELECT k.*, m, dx, dy, ia, ib, ic, id, (k.block%4)*4+1.5::DOUBLE AS cx, (k.block//4)*4+1.5::DOUBLE AS cy FROM k
 JOIN maps USING (rec, g, block)), r AS (SELECT rec, g, m, p, CAST(round_even(CAST(x AS DOUBLE)+dx+(ia/2.0::DOUBLE)*(x-cx)+(ib/2.0::DOUBLE)
 *(y-cy),0) AS BIGINT) AS x, CAST(round_even(CAST(y AS DOUBLE)+dy+(ic/2.0::DOUBLE)*(x-cx)+(id/2.0::DOUBLE)*(y-cy),0) AS BIGINT) AS y FROM j)
 SELECT rec, g, m, x, y, p, count(*) AS n FROM r WHERE x >= 0 AND x < 16 AND y >= 0 AND y < 8 GROUP BY ALL""")
def m8(spark, d):
    ev = events(spark, d)
    key = ev.join(keys(ev), ["rec", "w"], "left_semi").withColumn("block", C.block_id("x", "y", 4, 16)).withColumnRenamed("w", "g")
    return K.reconstruct(key, hash_maps(spark, d), DEMO).groupBy("rec", "g", "m", "x", "y", "p").agg(F.count(F.lit(1)).alias("n"))


@query("a15_receiver", f"""WITH {EV}, {KEYS}, {MAPS}, k AS (SELECT ev.rec, w AS g, least(2, tr*3//86400000000) AS tb, x, y, p, (y//4)*4+x//4 AS
 block FROM ev SEMI JOIN keys USING (rec, w)), j AS (SELECT k.*, m, dx, dy, ia, ib, ic, id, (k.block%4)*4+1.5::DOUBLE AS cx,
 (k.block//4)*4+1.5::DOUBLE AS cy FROM k JOIN maps USING (rec, g, block)), r AS (SELECT rec, g, m, p, tb, CAST(round_even(CAST(x AS
 DOUBLE)+dx+(ia/2.0::DOUBLE)*(x-cx)+(ib/2.0::DOUBLE)*(y-cy),0) AS BIGINT) AS x, CAST(round_even(CAST(y AS DOUBLE)+dy+(ic/2.0::DOUBLE)*(x-cx)+
 (id/2.0::DOUBLE)*(y-cy),0) AS BIGINT) AS y FROM j), a AS (SELECT rec, g+m AS w, g, m, p, tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM r
 WHERE x >= 0 AND x < 16 AND y >= 0 AND y < 8 GROUP BY ALL), b AS (SELECT rec, w, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS
 bx, count(*) AS c FROM ev GROUP BY ALL) SELECT rec, g, m, CAST(sum(a.c) AS BIGINT) AS n_rec, CAST(coalesce(sum(least(a.c,coalesce(b.c,0))),0) AS
 BIGINT) AS pairs FROM a LEFT JOIN b USING (rec, w, p, tb, by, bx) GROUP BY ALL""")
def a15(spark, d):
    """The receiver sees the coded key events and the coded maps only."""
    ev = events(spark, d)
    key = ev.join(keys(ev), ["rec", "w"], "left_semi").withColumnRenamed("w", "g")
    coded, deltas = E.encode(key, K.Q_KEY, DEMO, ("rec", "g")), E.map_deltas(hash_maps(spark, d))
    dec = E.decode(coded, K.Q_KEY, DEMO, ("rec", "g")).withColumn("block", C.block_id("x", "y", 4, 16))
    pred = K.reconstruct(dec, E.decode_maps(deltas), DEMO)
    m = Sb.match_variants(pred, ev, (2, 3), DEMO, ("g", "m"))
    return m.select("rec", "g", "m", F.col("n1").alias("n_rec"), "pairs")


# ---- subsets

@query("b1_direct_bits", f"WITH {EV} SELECT rec, w, n, bits FROM {bits_sql('ev', 'rec, w', (2, 3))}")
def b1(spark, d):
    return E.set_bits(events(spark, d), (2, 3), DEMO)


U = f"({h(20261016, 'seq', 'w')}/2147483648.0::DOUBLE)"
SUBSETS = f"""eb AS (SELECT *, count(*) OVER (PARTITION BY rec, w, (y//4)*4+x//4) AS nb, {U} AS u FROM ev), sub AS (SELECT 'direct' AS scheme,
 * FROM eb UNION ALL """ + " UNION ALL ".join([f"SELECT 'thin_{c}', * FROM eb WHERE u < {c}" for c in SHARES] + [
     f"SELECT 'select_{r}', * FROM eb WHERE nb >= {THR[r]}" for r in RHOS]) + ")"


@query("b2_thin", f"""WITH {EV}, c(chi) AS (VALUES (0.25::DOUBLE),(0.5),(0.75)) SELECT chi, rec, count(*) AS n, CAST(sum(seq) AS BIGINT) AS
 seq_sum FROM ev, c WHERE {U} < chi GROUP BY ALL""")
def b2(spark, d):
    c = F.explode(F.array(*[F.lit(x) for x in SHARES])).alias("chi")
    return Sb.thin(events(spark, d).select("*", c), "chi").groupBy("chi", "rec").agg(F.count(F.lit(1)).alias("n"),
                                                                                     F.sum("seq").alias("seq_sum"))


@query("b3_select", f"""WITH {EV}, {SUBSETS} SELECT scheme, rec, w, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM sub WHERE scheme
 LIKE 'select%' GROUP BY ALL""")
def b3(spark, d):
    s = Sb.subset_table(events(spark, d), DEMO, (), RHOS, ()).filter("scheme <> 'direct'")
    return s.groupBy("scheme", "rec", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query("b5_code_subset", f"""WITH {EV}, {SUBSETS}, bt AS {bits_sql('sub', 'scheme, rec, w', (2, 3))}, a AS (SELECT scheme, rec, w, p, least(2,
 tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM sub GROUP BY ALL), t AS (SELECT rec, w, p, tb, by, bx, c AS ct FROM a
 WHERE scheme = 'direct'), m AS (SELECT scheme, rec, w, sum(least(c, ct)) AS m FROM a JOIN t USING (rec, w, p, tb, by, bx) GROUP BY ALL), n
 AS (SELECT rec, w, count(*) AS nt FROM ev GROUP BY ALL), f AS (SELECT scheme, rec, sum(bits) AS bits, sum(bt.n) AS n1, sum(nt) AS n2,
 sum(m) AS m FROM bt JOIN m USING (scheme, rec, w) JOIN n USING (rec, w) GROUP BY ALL) SELECT scheme, rec, CAST(bits AS BIGINT) AS bits,
 CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(m AS BIGINT) AS pairs, round(2.0*m/(n1+n2),6) AS F FROM f""")
def b5(spark, d):
    ev = events(spark, d)
    sub = Sb.subset_table(ev, DEMO, SHARES, RHOS, ())
    coded = E.encode(sub, (2, 3), DEMO, ("scheme", "rec", "w"))
    dec = E.decode(coded, (2, 3), DEMO, ("scheme", "rec", "w"))
    m = Sb.match_variants(dec, ev, (2, 3), DEMO, ("scheme",))
    j = m.join(coded.select("scheme", "rec", "w", (F.col("n_bytes") * 8).alias("bits")), ["scheme", "rec", "w"])
    s = j.groupBy("scheme", "rec").agg(*[F.sum(c).alias(c) for c in ("bits", "n1", "n2", "pairs")])
    return s.withColumn("F", r6(C.ratio0(F.col("pairs") * 2.0, F.col("n1") + F.col("n2"))))


@query("b6_thin_to_budget", f"""WITH {EV}, {GROUPS}, kb AS (SELECT rec, w AS g, bits FROM {bits_sql('(SELECT ev.* FROM ev SEMI JOIN keys USING (rec, w))', 'rec, w', (1, 3))}),
 db AS (SELECT rec, g, sum(bits) AS bits_direct FROM gw JOIN {bits_sql('ev', 'rec, w', (2, 3))} USING (rec, w) GROUP BY ALL), q AS (SELECT
 rec, g, least(1.0::DOUBLE, bits/bits_direct) AS chi FROM kb JOIN db USING (rec, g)) SELECT rec, g, m, round(chi,6) AS chi, count(*) AS n
 FROM q JOIN gw USING (rec, g) JOIN ev USING (rec, w) WHERE {U} < chi GROUP BY ALL""")
def b6(spark, d):
    ev = events(spark, d)
    ks = keys(ev)
    from ..operators.windows import groups
    gw = groups(ks, 4)
    kb = E.set_bits(ev.join(ks, ["rec", "w"], "left_semi"), (1, 3), DEMO).select("rec", F.col("w").alias("g"), "bits")
    db = E.set_bits(ev, (2, 3), DEMO).select("rec", "w", F.col("bits").alias("_b")).join(gw, ["rec", "w"]).groupBy("rec", "g").agg(
        F.sum("_b").alias("bits_direct"))
    chi = kb.join(db, ["rec", "g"]).select("rec", "g", F.least(F.lit(1.0), F.col("bits") / F.col("bits_direct")).alias("chi"))
    e = ev.join(gw.join(chi, ["rec", "g"]), ["rec", "w"])
    return Sb.thin(e, "chi").groupBy("rec", "g", "m", r6("chi", "chi")).agg(F.count(F.lit(1)).alias("n"))


@query("a12_tile_sizes", f"""WITH {EV}, t AS (SELECT rec, t_us//10800000000 AS tile, t_us%10800000000 AS r, seq FROM ev), dl AS (SELECT *,
 r - coalesce(lag(r) OVER (PARTITION BY rec, tile ORDER BY r, seq), 0) AS dt FROM t) SELECT rec, tile, count(*) AS n,
 CAST(8*sum({uleb_sql('dt')}) + 22*count(*) AS BIGINT) AS delta_bits, 64*count(*) + 8*((count(*)+7)//8) AS plane_bits FROM dl GROUP BY ALL""")
def a12(spark, d):
    return E.tile_sizes(events(spark, d), 10_800_000_000)


# ---- group codec of the static model against the subset schemes

CODEC = f"""{GROUPS}, {SUBSETS}, nt AS (SELECT rec, g, count(*) AS n_true FROM gw JOIN ev USING (rec, w) GROUP BY ALL), ky AS (SELECT r.rho, eb.rec,
 eb.w AS g, tr, x, y, p FROM eb SEMI JOIN keys USING (rec, w), (VALUES (0.25::DOUBLE, 4),(0.5, 8),(0.75, 12)) r(rho, thr) WHERE nb >= thr), kbits AS
 {bits_sql('ky', 'rec, rho, g', (1, 3))}, kv AS (SELECT rho, rec, g, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c
 FROM ky GROUP BY ALL), tv AS (SELECT rec, g, m, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM gw JOIN ev
 USING (rec, w) GROUP BY ALL), pm AS (SELECT rec, rho, g, sum(least(kv.c,tv.c)) AS pairs FROM kv JOIN tv USING (rec, g, p, tb, by, bx) WHERE m > 0
 GROUP BY ALL), gc AS (SELECT rec, rho, g, kb.n AS n_key, 3*kb.n AS n_rec, n_true, coalesce(pairs,0) AS pairs, bits FROM kbits kb JOIN nt USING
 (rec, g) LEFT JOIN pm USING (rec, rho, g)), s0 AS (SELECT rec, rho, sum(n_key) AS n_key, sum(n_rec) AS n_rec, sum(n_true) AS n_true, sum(pairs)
 AS pairs, sum(bits) AS bits FROM gc GROUP BY ALL), s1 AS (SELECT *, 2.0*(n_key+pairs)/(n_key+n_rec+n_true) AS F FROM s0), s2 AS (SELECT rec, rho,
 F, n_key/n_true AS share, F/(2-F) AS q_eq, bits/n_true AS bits FROM s1), sb AS {bits_sql('sub', 'scheme, rec, w', (2, 3))}, ntr AS (SELECT rec,
 sum(n_true) AS n_true FROM nt GROUP BY rec), pt AS (SELECT rec, scheme, sum(n)/max(n_true) AS share, sum(bits)/max(n_true) AS bits FROM sb JOIN gw
 USING (rec, w) JOIN ntr USING (rec) GROUP BY ALL), zr AS (SELECT DISTINCT rec, 0.0::DOUBLE AS share, 0.0::DOUBLE AS bits FROM pt), th AS (SELECT rec,
 share, min(bits) AS bits FROM (SELECT rec, share, bits FROM pt WHERE scheme = 'direct' OR scheme LIKE 'thin%' UNION ALL SELECT * FROM zr) GROUP BY
 ALL), al AS (SELECT rec, share, min(bits) AS bits FROM (SELECT rec, share, bits FROM pt UNION ALL SELECT * FROM zr) GROUP BY ALL), hu AS (SELECT *
 FROM al z WHERE NOT EXISTS (SELECT 1 FROM al a, al b WHERE a.rec = z.rec AND b.rec = z.rec AND a.share < z.share AND b.share > z.share AND
 (z.share-a.share)*(b.bits-a.bits) <= (z.bits-a.bits)*(b.share-a.share)))"""


def interp_sql(q, pts, at, x="share", y="bits"):
    lo = f"(SELECT arg_max(struct_pack(x := {x}, y := {y}), {x}) FROM {pts} z WHERE z.rec = {q}.rec AND {x} <= {at})"
    hi = f"(SELECT arg_min(struct_pack(x := {x}, y := {y}), {x}) FROM {pts} z WHERE z.rec = {q}.rec AND {x} >= {at})"
    return (f"(CASE WHEN {lo} IS NULL THEN {hi}.y WHEN {hi} IS NULL THEN {lo}.y WHEN {lo}.x = {hi}.x THEN {lo}.y ELSE {lo}.y + "
            f"({hi}.y - {lo}.y)*({at} - {lo}.x)/({hi}.x - {lo}.x) END)")


SUMMARY = f"""{CODEC}, s3 AS (SELECT s2.*, (SELECT bits FROM pt WHERE pt.rec = s2.rec AND scheme = 'direct') AS bits_direct,
 {interp_sql('s2', 'th', 's2.q_eq')} AS bits_thin, {interp_sql('s2', 'hu', 's2.q_eq')} AS bits_base FROM s2)"""


@query("a13_group_sums", f"WITH {EV}, {CODEC} SELECT rec, rho, CAST(n_key AS BIGINT) AS n_key, CAST(n_rec AS BIGINT) AS n_rec, CAST(n_true AS "
                         "BIGINT) AS n_true, CAST(pairs AS BIGINT) AS pairs, CAST(bits AS BIGINT) AS bits FROM s0")
def a13(spark, d):
    return static_counts(events(spark, d)).groupBy("rec", "rho").agg(
        *[F.sum(c).alias(c) for c in ("n_key", "n_rec", "n_true", "pairs", "bits")])


def static_counts(ev):
    ks = keys(ev)
    key = K.key_events(ev, ks, RHOS, DEMO)
    return K.group_counts(ev, key, K.static_maps(key, 4), ks, DEMO, 4, params=())


def static_summary(spark, d):
    ev = events(spark, d)
    return K.summarize(static_counts(ev), K.scheme_points(ev, keys(ev), DEMO, 4, SHARES, RHOS))


FIELDS = ("F", "q_eq", "bits", "bits_direct", "bits_thin", "bits_base", "share")


@query("a14_summary", f"""WITH {EV}, {SUMMARY} SELECT rec, rho, {', '.join(f'round({f},6) AS {f}' for f in FIELDS)}, round(bits_base/bits,6) AS
 gain, round(bits_thin/bits,6) AS gain_thin, round(q_eq/share,6) AS gamma FROM s3""")
def a14(spark, d):
    return static_summary(spark, d).select("rec", "rho", *[r6(f, f) for f in (*FIELDS, "gain", "gain_thin", "gamma")])


@query("a26_envelope", f"WITH {EV}, {CODEC} SELECT rec, round(share,6) AS share, round(bits,6) AS bits FROM hu")
def a26(spark, d):
    ev = events(spark, d)
    p = K.scheme_points(ev, keys(ev), DEMO, 4, SHARES, RHOS).groupBy("rec").agg(Cv.curve().alias("c"))
    p = p.select("rec", Cv.with_origin(F.col("c")).alias("c")).select("rec", F.explode(Cv.hull(F.col("c"))).alias("v"))
    return p.select("rec", r6("v.x", "share"), r6("v.y", "bits"))


@query("a28_tuning", f"""WITH {EV}, {SUMMARY}, j AS (SELECT rho, median((bits_base-bits)/bits_direct) AS J, median(F) AS F, median(bits) AS bits,
 count(*) AS n FROM s3 GROUP BY rho) SELECT rho, n AS n_recordings, round(J,6) AS J, round(F,6) AS F, round(bits,6) AS bits, row_number() OVER
 (ORDER BY J DESC, rho DESC) = 1 AS frozen FROM j""")
def a28(spark, d):
    s = static_summary(spark, d).groupBy("rho").agg(F.count(F.lit(1)).alias("n_recordings"), F.median("J").alias("J"),
                                                    F.median("F").alias("F"), F.median("bits").alias("bits"))
    # one row per configuration, so one window over all of them is small
    best = F.max(F.struct("J", "rho")).over(Window.partitionBy())
    return s.withColumn("_best", best).select("rho", "n_recordings", r6("J", "J"), r6("F", "F"), r6("bits", "bits"),
                                              (F.col("rho") == F.col("_best.rho")).alias("frozen"))


@query("a36_operating_points", f"""WITH {EV}, {SUMMARY} SELECT CASE WHEN rec LIKE 'day%' THEN 'day' ELSE 'night' END AS stratum, rho, count(*) AS
 n_recordings, round(median(F),6) AS F, round(median(100.0*bits/bits_direct),6) AS pct_bits, round(median(100.0*bits_base/bits_direct),6) AS
 pct_base, round(median(bits_base/bits),6) AS gain FROM s3 GROUP BY ALL""")
def a36(spark, d):
    return static_summary(spark, d).groupBy(lighting().alias("stratum"), "rho").agg(
        F.count(F.lit(1)).alias("n_recordings"), r6(F.median("F"), "F"),
        r6(F.median(F.col("bits") * 100.0 / F.col("bits_direct")), "pct_bits"),
        r6(F.median(F.col("bits_base") * 100.0 / F.col("bits_direct")), "pct_base"), r6(F.median("gain"), "gain"))


@query("a27_curve_lookups", f"""WITH {EV}, {CODEC}, ld AS (SELECT rec, scheme, share AS f, bits AS b, CAST(row_number() OVER (PARTITION BY rec ORDER BY
 scheme) AS BIGINT) AS step FROM pt WHERE scheme LIKE 'thin%'), nx AS (SELECT *, lead(f) OVER q AS f1, lead(b) OVER q AS b1 FROM ld WINDOW q AS
 (PARTITION BY rec ORDER BY step)), cr AS (SELECT rec, arg_min(CASE WHEN f1 = f THEN b ELSE b + (b1-b)*(0.6-f)/(f1-f) END, step) AS b_at FROM nx
 WHERE least(f,f1) <= 0.6 AND 0.6 <= greatest(f,f1) GROUP BY rec) SELECT ntr.rec, round({interp_sql('ntr', 'th', '0.6')},6) AS b_interp,
 round(b_at,6) AS b_cross FROM ntr LEFT JOIN cr USING (rec)""")
def a27(spark, d):
    ev = events(spark, d)
    pts = K.scheme_points(ev, keys(ev), DEMO, 4, SHARES, RHOS)
    sch = F.col("scheme")
    q = pts.groupBy("rec").agg(Cv.curve(when=(sch == "direct") | sch.startswith("thin")).alias("c"))
    q = q.select("rec", r6(Cv.lookup(Cv.with_origin(F.col("c")), F.lit(0.6), clamp=False), "b_interp"))
    lad = pts.filter("scheme LIKE 'thin%'").select("rec", sch.alias("step"), F.col("share").alias("f"), F.col("bits").alias("b"))
    return q.join(Cv.first_crossing(lad, ["rec"], 0.6), "rec", "left").select("rec", "b_interp", r6("b_at", "b_cross"))


@query("a40_scheme_table", f"""WITH {EV}, {GROUPS}, {SUBSETS}, bt AS {bits_sql('sub', 'scheme, rec, w', (2, 3))}, a AS (SELECT scheme, rec, w, p, least(2,
 tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM sub GROUP BY ALL), t AS (SELECT rec, w, p, tb, by, bx, c AS ct FROM a WHERE
 scheme = 'direct'), m AS (SELECT scheme, rec, w, sum(least(c, ct)) AS m FROM a JOIN t USING (rec, w, p, tb, by, bx) GROUP BY ALL), n AS (SELECT rec,
 w, count(*) AS nt FROM ev GROUP BY ALL), ks(K) AS (VALUES (2::BIGINT),(4)), f AS (SELECT scheme, rec, K, sum(bits) AS bits, sum(bt.n) AS n1, sum(nt)
 AS n2, sum(m.m) AS m FROM bt JOIN m USING (scheme, rec, w) JOIN n USING (rec, w) JOIN gw USING (rec, w), ks WHERE gw.m < K GROUP BY ALL), dd AS (SELECT
 rec, K, bits AS bd, n2 AS nd FROM f WHERE scheme = 'direct') SELECT scheme, rec, K, round(bits/nd,6) AS b, round(bd/nd,6) AS b_direct,
 round(bits/bd,6) AS size_ratio, round(2.0*m/(n1+n2),6) AS F, round(1 - n1/n2,6) AS lost_share FROM f JOIN dd USING (rec, K)""")
def a40(spark, d):
    return scheme_table(events(spark, d), (2, 4))


def scheme_table(ev, Ks, caps=()):
    """Per (scheme, rec, K): bits per true event, the direct bits, size ratio, F and the share of lost events."""
    from ..operators.windows import groups
    gw = groups(keys(ev), max(Ks))
    sub = Sb.subset_table(ev.join(gw.select("rec", "w").distinct(), ["rec", "w"], "left_semi"), DEMO, SHARES, RHOS, caps)
    m = Sb.match_variants(sub, ev, (2, 3), DEMO, ("scheme",))
    b = E.set_bits(sub, (2, 3), DEMO, ("scheme", "rec", "w")).drop("n")
    j = m.join(b, ["scheme", "rec", "w"]).join(gw, ["rec", "w"])
    kk = F.array_compact(F.array(*[F.when(F.col("m") < k, F.lit(k).cast("bigint")) for k in Ks]))
    s = j.withColumn("K", F.explode(kk)).groupBy("scheme", "rec", "K").agg(*[F.sum(c).alias(c) for c in ("bits", "n1", "n2", "pairs")])
    dd = s.filter("scheme = 'direct'").select("rec", "K", F.col("bits").alias("bd"), F.col("n2").alias("nd"))
    s = s.join(dd, ["rec", "K"])
    return s.select("scheme", "rec", "K", r6(F.col("bits") / F.col("nd"), "b"), r6(F.col("bd") / F.col("nd"), "b_direct"),
                    r6(F.col("bits") / F.col("bd"), "size_ratio"),
                    r6(F.col("pairs") * 2.0 / (F.col("n1") + F.col("n2")), "F"), r6(1 - F.col("n1") / F.col("n2"), "lost_share"))
