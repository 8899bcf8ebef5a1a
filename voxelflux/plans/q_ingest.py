"""Scans, scalar columns and window generation (S, P, G)."""
from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import voxels as V, windows as Wn
from ..sensor import DAY, DEMO
from ..sources import ingest as I
from ..sources.tables import events, raw_labels, rec_name, table
from .registry import query
from .sqltext import EV, LABELS, h

r6 = lambda c, n=None: F.round(c, 6).alias(n) if n else F.round(c, 6)      # noqa: E731


def raw(spark, d):
    """The stream as a faulty reader would hand it over: late times, packed polarity, bit 15 set."""
    ev = events(spark, d)
    late = F.when(C.mix(7, "seq", "user") % 5 == 0, F.least("t_us", F.lit(7_200_000_000))).otherwise(0)
    return ev.select("rec", "seq", (F.col("t_us") - late).alias("t_us"),
                     (F.col("x") + F.when(F.col("seq") % 7 == 0, 32768).otherwise(0)).alias("x"), "y",
                     F.when(F.col("p") == 1, F.col("seq") % 2 + 1).otherwise(-(F.col("seq") % 2)).alias("p"))


RAW = EV + f""", raw AS (SELECT rec, seq, t_us - CASE WHEN {h(7, 'seq', '"user"')} % 5 = 0 THEN least(t_us, 7200000000)
 ELSE 0 END AS t_us, x + CASE WHEN seq % 7 = 0 THEN 32768 ELSE 0 END AS x, y,
 CASE WHEN p = 1 THEN seq % 2 + 1 ELSE -(seq % 2) END AS p FROM ev)"""


@query("s1_scan_report", f"""WITH {EV} SELECT rec, count(*) AS n, min(t_us) AS t_first, max(t_us) AS t_last,
 max(x) AS x_max, max(y) AS y_max, round(avg(p), 6) AS share_p1, bool_and(x >= 0 AND x < 16 AND y >= 0 AND y < 8
 AND p IN (0,1) AND t_us >= 0) AS valid FROM ev GROUP BY rec""")
def s1(spark, d):
    ev = I.validated(events(spark, d), DEMO)
    return I.scan_report(ev, DEMO).withColumn("share_p1", r6("share_p1"))


@query("s2_repair", f"""WITH {RAW}, c AS (SELECT *, max(t_us) OVER (PARTITION BY rec ORDER BY seq) AS tc,
 lag(t_us) OVER (PARTITION BY rec ORDER BY seq) AS tp FROM raw)
 SELECT rec, count(*) AS n, CAST(sum(CASE WHEN t_us < tp THEN 1 ELSE 0 END) AS BIGINT) AS n_clamped,
 CAST(sum(tc % 1000003) AS BIGINT) AS t_check, CAST(sum(x & 32767) AS BIGINT) AS x_sum,
 CAST(sum(CASE WHEN p > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_p1 FROM c GROUP BY rec""")
def s2(spark, d):
    rep = I.repaired(raw(spark, d), chunk_rows=1000)
    return rep.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.count_if("clamped").alias("n_clamped"),
                                  F.sum(F.col("t_us") % 1000003).alias("t_check"), F.sum("x").alias("x_sum"),
                                  F.sum("p").alias("n_p1"))


@query("s3_describe", """SELECT * FROM (SELECT 'event_id' AS "column", 'bigint' AS type, count(event_id) AS n_present FROM
 events UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts) FROM events UNION ALL SELECT 'user_id', 'bigint', count(user_id)
 FROM events UNION ALL SELECT 'event_type', 'string', count(event_type) FROM events UNION ALL SELECT 'value', 'double',
 count(value) FROM events UNION ALL SELECT 'props', 'string', count(props) FROM events)""")
def s3(spark, d):
    return I.describe(table(spark, d, "events"))


@query("s4_inventory", f"""WITH {LABELS}, e AS (SELECT rec, count(*) AS n_events, min(t_us) AS t_first, max(t_us) AS t_last
 FROM ev GROUP BY rec), b AS (SELECT rec, count(*) AS n_boxes, count(DISTINCT track_id) AS n_tracks FROM labels_raw
 GROUP BY rec) SELECT rec, n_events, t_first, t_last, n_boxes, n_tracks, (t_last - t_first)*1e-6::DOUBLE AS duration_s,
 round(n_events/((t_last - t_first)*1e-6::DOUBLE), 9) AS events_per_s,
 round(n_events/((t_last - t_first)*1e-6::DOUBLE)*86400.0::DOUBLE/128, 6) AS events_per_pixel_window
 FROM e JOIN b USING (rec)""")
def s4(spark, d):
    return I.inventory(events(spark, d), raw_labels(spark, d), DEMO).withColumns(
        {"events_per_s": F.round("events_per_s", 9), "events_per_pixel_window": r6("events_per_pixel_window")})


def words(spark, d):
    """Word stream of the events: a time-high word before each event from the 20th on, foreign words in between."""
    e = events(spark, d).select("rec", "seq", C.idiv("t_us", 1000).alias("t"), "x", "y", "p")
    th = e.filter("seq >= 20").select("rec", (F.col("seq") * 3).alias("pos"),
                                      (F.lit(8 << 28) + C.idiv("t", 64)).alias("word"))
    cd = e.select("rec", (F.col("seq") * 3 + 1).alias("pos"),
                  (F.col("p") * (1 << 28) + (F.col("t") % 64) * (1 << 22) + F.col("x") * 2048 + F.col("y")).alias("word"))
    ext = e.filter("seq % 50 = 0").select("rec", (F.col("seq") * 3 + 2).alias("pos"), F.lit(10 << 28).alias("word"))
    return th.unionByName(cd).unionByName(ext)


WORDS = EV + """, e5 AS (SELECT rec, seq, t_us // 1000 AS t, x, y, p FROM ev), words AS (
 SELECT rec, seq*3 AS pos, 2147483648 + t // 64 AS word FROM e5 WHERE seq >= 20 UNION ALL
 SELECT rec, seq*3+1, p*268435456 + (t % 64)*4194304 + x*2048 + y FROM e5 UNION ALL
 SELECT rec, seq*3+2, 2684354560 FROM e5 WHERE seq % 50 = 0)"""


@query("s5_word_decode", f"""WITH {WORDS}, c AS (SELECT *, word >> 28 AS typ, max(CASE WHEN word >> 28 = 8 THEN pos END)
 OVER (PARTITION BY rec ORDER BY pos) AS tp FROM words), j AS (SELECT c.rec, c.pos AS seq, ((t.word & 268435455) << 6) |
 ((c.word >> 22) & 63) AS t_us, (c.word >> 11) & 2047 AS x, c.word & 2047 AS y, c.typ AS p FROM c JOIN words t ON
 t.rec = c.rec AND t.pos = c.tp WHERE c.typ <= 1) SELECT rec, seq, t_us, x, y, p FROM j""")
def s5(spark, d):
    return I.decode_words(words(spark, d), chunk_rows=3000)


@query("s5_word_counts", f"""WITH {WORDS}, f AS (SELECT rec, min(CASE WHEN word >> 28 = 8 THEN pos END) AS f FROM words
 GROUP BY rec) SELECT rec, count(*) AS n_words, count(*) FILTER (word >> 28 <= 1) AS n_cd,
 count(*) FILTER (word >> 28 = 8) AS n_time_high, count(*) FILTER (word >> 28 > 1 AND word >> 28 <> 8) AS n_other,
 count(*) FILTER (word >> 28 <= 1 AND (f IS NULL OR pos < f)) AS n_cd_early FROM words JOIN f USING (rec) GROUP BY rec""")
def s5c(spark, d):
    return I.word_counts(words(spark, d))


@query("s6_text_events", f"""WITH {EV} SELECT rec, seq, CAST(round_even((CAST(t_us AS DOUBLE)/1000000)*1e6, 0) AS BIGINT)
 AS t_us, x, y, p FROM ev""")
def s6(spark, d):
    e = events(spark, d)
    sec = F.format_string("%d.%06d", C.idiv("t_us", 1_000_000), F.col("t_us") % 1_000_000)
    return I.parse_text(e.select("rec", "seq", F.concat_ws(" ", sec, "x", "y", "p").alias("line")))


@query("s7_labels", f"""WITH {LABELS} SELECT rec, class_id, count(*) AS n, count(DISTINCT track_id) AS n_tracks,
 min(t_us) AS t_first, max(t_us) AS t_last, max(w) AS w_max, max(h) AS h_max FROM labels_raw GROUP BY ALL""")
def s7(spark, d):
    return raw_labels(spark, d).groupBy("rec", "class_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("track_id").alias("n_tracks"), F.min("t_us").alias("t_first"),
        F.max("t_us").alias("t_last"), F.max("w").alias("w_max"), F.max("h").alias("h_max"))


def manifest(spark, d):
    """A list of recordings made from `supplier`: some exist, most do not."""
    return table(spark, d, "supplier").select(rec_name(F.col("s_suppkey")).alias("rec")).distinct()


MANIFEST = """manifest AS (SELECT DISTINCT CASE WHEN s_suppkey % 5 < 3 THEN 'day_' ELSE 'night_' END
 || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS rec FROM supplier)"""


@query("s8_population", f"""WITH {EV}, {MANIFEST}, h1 AS (SELECT left(sha256(rec), 4) AS digits, count(*) AS n, sha256(string_agg(rec, chr(10)
 ORDER BY rec)) AS hash FROM manifest GROUP BY 1), hs AS (SELECT CAST(sum(n) AS BIGINT) AS n_ids, sha256(string_agg(hash, chr(10) ORDER BY digits)) AS sha256 FROM h1), a AS (SELECT rec, count(*) AS n_events FROM ev WHERE rec IN (SELECT rec FROM
 manifest) GROUP BY rec) SELECT rec, n_events, n_ids, sha256 FROM a, hs""")
def s8(spark, d):
    m = manifest(spark, d)
    n = I.allowed(events(spark, d), m).groupBy("rec").agg(F.count(F.lit(1)).alias("n_events"))
    # the hash of the list is one row; the literal key keeps this an equi-join
    one = I.ids_sha256(m).withColumn("_k", F.lit(1))
    return n.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").drop("_k")


@query("s9_resolve", f"""WITH {EV}, {MANIFEST} SELECT rec, rec IN (SELECT rec FROM ev) AS found FROM manifest""")
def s9(spark, d):
    return I.resolve(manifest(spark, d), events(spark, d))


@query("s10_union_rows", f"""WITH {EV} SELECT rec, 'a' AS part, count(*) AS n, CAST(sum(p) AS BIGINT) AS n_on, NULL::BIGINT
 AS n_pix FROM ev GROUP BY rec UNION ALL SELECT rec, 'b', count(*), NULL, count(DISTINCT y*16+x) FROM ev GROUP BY rec""")
def s10(spark, d):
    ev = events(spark, d)
    a = ev.groupBy("rec").agg(F.lit("a").alias("part"), F.count(F.lit(1)).alias("n"), F.sum("p").alias("n_on"))
    b = ev.groupBy("rec").agg(F.lit("b").alias("part"), F.count(F.lit(1)).alias("n"),
                              F.countDistinct(F.col("y") * 16 + F.col("x")).alias("n_pix"))
    return I.union_rows(a, b)


@query("s11_json_report", f"""WITH {EV} SELECT rec, CAST(json_object('rec', rec, 'n', count(*), 'n_on', CAST(sum(p) AS
 BIGINT), 'undefined', NULL) AS VARCHAR) AS report FROM ev GROUP BY rec""")
def s11(spark, d):
    g = events(spark, d).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("n_on"))
    return I.json_rows(g.withColumn("undefined", F.lit(float("nan"))))


@query("s12_stratum", f"""WITH {EV} SELECT CASE WHEN rec LIKE 'day%' THEN 'day' ELSE 'night' END AS stratum,
 CAST(regexp_extract(rec, '_0*([0-9]+)$', 1) AS BIGINT) % 5 AS residue, count(*) AS n FROM ev GROUP BY ALL""")
def s12(spark, d):
    return events(spark, d).groupBy(I.lighting().alias("stratum"),
                                    (F.regexp_extract("rec", "_0*([0-9]+)$", 1).cast("bigint") % 5).alias("residue")).agg(
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------ scalar columns

@query("p1_time_bin", f"""WITH {EV}, c(k) AS (VALUES (1::BIGINT),(3),(8),(32)) SELECT rec, k,
 least(k-1, (tr*k)//86400000000) AS tb, count(*) AS n FROM ev, c GROUP BY ALL""")
def p1(spark, d):
    ks = F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 3, 8, 32)])).alias("k")
    return events(spark, d).select("rec", "tr", ks).groupBy("rec", "k", C.time_bin("tr", "k", DAY).alias("tb")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p2_block_frame", f"""WITH {EV}, b AS (SELECT rec, (y//4)*4 + x//4 AS block, count(*) AS n FROM ev GROUP BY ALL)
 SELECT rec, block, CAST((block%4)*4 + 1.5 AS DOUBLE) AS cx, CAST((block//4)*4 + 1.5 AS DOUBLE) AS cy, n FROM b""")
def p2(spark, d):
    cx, cy = C.block_centre("block", 4, 16)
    return events(spark, d).groupBy("rec", C.block_id("x", "y", 4, 16).alias("block")).agg(
        F.count(F.lit(1)).alias("n")).select("rec", "block", cx.alias("cx"), cy.alias("cy"), "n")


@query("p3_active_threshold", f"""WITH {EV}, s(side) AS (VALUES (2::BIGINT),(4),(8)), r(rho) AS (VALUES (0.0625::DOUBLE),
 (0.125),(0.25),(0.5),(1.0)), b AS (SELECT rec, w, side, (y//side)*CAST(ceil(16.0/side) AS BIGINT) + x//side AS block,
 count(*) AS n FROM ev, s GROUP BY ALL), t AS (SELECT *, CAST(greatest(1, ceil(rho*side*side)) AS BIGINT) AS threshold
 FROM b, r) SELECT rec, side, rho, max(threshold) AS threshold, count(*) FILTER (n >= threshold) AS n_active FROM t
 GROUP BY ALL""")
def p3(spark, d):
    c = V.census(events(spark, d), DEMO, (2, 4, 8), (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0))
    return c.groupBy("rec", "side", "rho").agg(F.max("threshold").alias("threshold"), F.sum("n_active").alias("n_active"))


@query("p4_voxel_key", f"""WITH {EV} SELECT rec, w, ((p*3 + least(2, tr*3//86400000000))*4 + y//2)*8 + x//2 AS key,
 count(*) AS n FROM ev GROUP BY ALL""")
def p4(spark, d):
    v = V.voxel_counts(events(spark, d), [(2, 3)], DEMO)
    return v.select("rec", "w", (((F.col("p") * 3 + F.col("tb")) * 4 + F.col("by")) * 8 + F.col("bx")).alias("key"),
                    F.col("c").alias("n"))


@query("p5_pixel_polarity", f"""WITH {EV} SELECT rec, (y*16 + x)*2 + p AS pk, count(*) AS n, min(t_us) AS t_first
 FROM ev GROUP BY ALL""")
def p5(spark, d):
    return events(spark, d).groupBy("rec", "x", "y", "p").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t_first")
                                                              ).select("rec", ((F.col("y") * 16 + F.col("x")) * 2 +
                                                                               F.col("p")).alias("pk"), "n", "t_first")


@query("p6_padded_dims", f"""WITH {EV}, c(s) AS (VALUES (1::BIGINT),(2),(3),(5)) SELECT s, (s+15)//s AS nx, (s+7)//s AS ny,
 (s+7)//s + ((s+7)//s)%2 AS rows_padded, 2*((s+15)//s + ((s+15)//s)%2) AS cols_padded,
 max(x//s) + 1 AS nx_seen, max(y//s) + 1 AS ny_seen FROM ev, c GROUP BY s""")
def p6(spark, d):
    ev = V.cells_table(events(spark, d), [(s, 1) for s in (1, 2, 3, 5)])
    g = ev.groupBy("s").agg((F.max(C.idiv("x", "s")) + 1).alias("nx_seen"), (F.max(C.idiv("y", "s")) + 1).alias("ny_seen"))
    nx, ny, rp, cp = C.padded_dims("s", 16, 8)
    return g.select("s", nx.alias("nx"), ny.alias("ny"), rp.alias("rows_padded"), cp.alias("cols_padded"), "nx_seen",
                    "ny_seen")


P7_SQL = f"""WITH {EV}, q AS (SELECT *, {h(11, 'w', '(y//4)*4 + x//4')} AS hh, ((y//4)*4 + x//4) AS block FROM ev),
 mv AS (SELECT rec, w, p, CAST(x AS DOUBLE) + (hh%5 - 2) + ((hh//5)%3 - 1)/2.0::DOUBLE*(x - ((block%4)*4+1.5)::DOUBLE)
   + ((hh//15)%3 - 1)/2.0::DOUBLE*(y - ((block//4)*4+1.5)::DOUBLE) AS xm,
   CAST(y AS DOUBLE) + (hh//45)%3 - 1 + ((hh//135)%3 - 1)/2.0::DOUBLE*(x - ((block%4)*4+1.5)::DOUBLE)
   + ((hh//405)%3 - 1)/2.0::DOUBLE*(y - ((block//4)*4+1.5)::DOUBLE) AS ym FROM q),
 r AS (SELECT rec, w, p, CAST(round_even(xm,0) AS BIGINT) AS x, CAST(round_even(ym,0) AS BIGINT) AS y FROM mv)"""


def moved_by_hash(spark, d):
    ev = events(spark, d).withColumn("block", C.block_id("x", "y", 4, 16))
    ev = ev.withColumn("hh", C.mix(11, "w", "block"))
    cx, cy = C.block_centre("block", 4, 16)
    hh = lambda div, mod, off: (C.idiv("hh", div) % mod - off).cast("double")      # noqa: E731
    x, y = C.move_affine("x", "y", cx, cy, 2.0, 2.0, (hh(1, 5, 2), hh(45, 3, 1), hh(5, 3, 1), hh(15, 3, 1),
                                                      hh(135, 3, 1), hh(405, 3, 1)))
    return ev.withColumns({"x": x, "y": y})


@query("p7_affine_move", P7_SQL + " SELECT rec, x, y, p, count(*) AS n FROM r GROUP BY ALL")
def p7(spark, d):
    return moved_by_hash(spark, d).groupBy("rec", "x", "y", "p").agg(F.count(F.lit(1)).alias("n"))


@query("p8_velocity_warp", f"""WITH {EV} SELECT rec, CAST(round_even(x - 2.0::DOUBLE*((t_us - (w*86400000000 + 43200000000))
 *(1.0/86400000000)::DOUBLE), 0) AS BIGINT) AS xr, count(*) AS n FROM ev GROUP BY ALL""")
def p8(spark, d):
    ref = F.col("w") * DAY + DAY // 2
    return events(spark, d).groupBy("rec", C.rint_bigint(C.warp_velocity("x", "t_us", ref, 2.0, 1.0 / DAY)).alias("xr")
                                    ).agg(F.count(F.lit(1)).alias("n"))


@query("p10_off_sensor", P7_SQL + """ SELECT rec, count(*) AS n, count(*) FILTER (x >= 0 AND x < 16 AND y >= 0 AND y < 8)
 AS n_on FROM r GROUP BY rec""")
def p10(spark, d):
    on = (F.col("x") >= 0) & (F.col("x") < 16) & (F.col("y") >= 0) & (F.col("y") < 8)
    return moved_by_hash(spark, d).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.count_if(on).alias("n_on"))


PER_DAY = EV + """, pd AS (SELECT rec, "user", w, count(*) AS n, CAST(sum(tr) AS BIGINT) AS st FROM ev GROUP BY ALL)"""


def per_day(spark, d):
    return events(spark, d).groupBy("rec", "user", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("tr").alias("st"))


@query("p12_speed_classes", f"""WITH {PER_DAY}, v AS (SELECT rec, CAST((st % 4001) AS DOUBLE)/10.0 AS speed,
 (st % 19) - 9 AS dx, (st % 7) - 3 AS dy FROM pd) SELECT rec, CASE WHEN speed >= 300 THEN 3 WHEN speed >= 100 THEN 2
 WHEN speed >= 20 THEN 1 ELSE 0 END AS speed_bin, CASE WHEN greatest(abs(dx),abs(dy)) <= 1 THEN 0 WHEN
 greatest(abs(dx),abs(dy)) <= 5 THEN 1 ELSE 2 END AS shift_class, count(*) AS n FROM v GROUP BY ALL""")
def p12(spark, d):
    v = per_day(spark, d).select("rec", ((F.col("st") % 4001) / 10.0).alias("speed"), (F.col("st") % 19 - 9).alias("dx"),
                                 (F.col("st") % 7 - 3).alias("dy"))
    return v.groupBy("rec", C.speed_class("speed").alias("speed_bin"), C.shift_class("dx", "dy").alias("shift_class")).agg(
        F.count(F.lit(1)).alias("n"))


EDGES_SQL = "[" + ", ".join(repr(e) + "::DOUBLE" for e in C.RATIO_EDGES) + "]"


def bin_sql(r):
    return (f"(CASE WHEN ({r}) IS NULL OR isnan({r}) OR isinf({r}) THEN {len(C.RATIO_EDGES)} ELSE "
            f"greatest(0, len(list_filter({EDGES_SQL}, lambda e: e <= ({r}))) - 1) END)")


@query("p13_log_bins", f"""WITH {PER_DAY}, v AS (SELECT rec, CASE WHEN n > 1 THEN 10800000000.0::DOUBLE/((st // n) + 1) END
 AS r FROM pd), b AS (SELECT rec, CAST({bin_sql('r')} AS BIGINT) AS bin, count(*) AS n FROM v GROUP BY ALL)
 SELECT rec, bin, CASE WHEN bin >= 1 AND bin <= 28 THEN round(sqrt({EDGES_SQL}[bin+1]*{EDGES_SQL}[bin+2]), 6) END AS centre,
 n FROM b""")
def p13(spark, d):
    v = per_day(spark, d).select("rec", F.when(F.col("n") > 1, F.lit(10800000000.0) / (C.idiv("st", "n") + 1)).alias("r"))
    b = v.groupBy("rec", C.bin_of("r").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return b.select("rec", "bin", r6(C.bin_centre(F.col("bin").cast("int")), "centre"), "n")


@query("p14_flicker", f"""WITH {EV}, v AS (SELECT rec, CAST(tr % 20000 AS DOUBLE) AS tau FROM ev) SELECT rec,
 (abs(tau - 10000.0::DOUBLE) <= (0.02::DOUBLE*10000.0::DOUBLE) OR abs(tau - (1e6::DOUBLE/120.0::DOUBLE)) <=
 0.02::DOUBLE*(1e6::DOUBLE/120.0::DOUBLE)) AS flicker, count(*) AS n FROM v GROUP BY ALL""")
def p14(spark, d):
    return events(spark, d).groupBy("rec", C.is_flicker((F.col("tr") % 20000).cast("double")).alias("flicker")).agg(
        F.count(F.lit(1)).alias("n"))


def age_sql(a):
    return (f"(CASE WHEN ({a}) IS NULL THEN 6 WHEN ({a}) < 1 THEN 0 WHEN ({a}) < 2 THEN 1 WHEN ({a}) < 4 THEN 2 WHEN ({a})"
            f" < 16 THEN 3 WHEN ({a}) < 64 THEN 4 WHEN ({a}) < 256 THEN 5 ELSE 6 END)")


@query("p15_age_bucket", f"""WITH {EV} SELECT rec, {age_sql('tr // 300000000')} AS bucket, count(*) AS n FROM ev
 GROUP BY ALL""")
def p15(spark, d):
    return events(spark, d).groupBy("rec", C.age_bucket(C.idiv("tr", 300_000_000)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p16_moved_fidelity", f"""WITH {PER_DAY} SELECT rec, "user", w, CASE WHEN st/86400000000.0::DOUBLE/n <= 0.5 THEN
 round(st/86400000000.0::DOUBLE/n - (st/86400000000.0::DOUBLE/n)*(st/86400000000.0::DOUBLE/n)/(n*3.0::DOUBLE), 6) END AS f
 FROM pd""")
def p16(spark, d):
    r = F.col("st") / F.lit(float(DAY)) / F.col("n")
    return per_day(spark, d).select("rec", "user", "w", r6(C.moved_fidelity(r, "n"), "f"))


@query("p17_poisson_bits", f"""WITH {EV}, g AS (SELECT rec, count(*) AS n, (max(t_us) - min(t_us))*1e-6::DOUBLE AS dur FROM ev
 GROUP BY rec) SELECT rec, n, round((1.0 - ln(n/dur/128*1.0::DOUBLE))/ln(2.0), 6) AS bits FROM g""")
def p17(spark, d):
    g = events(spark, d).groupBy("rec").agg(F.count(F.lit(1)).alias("n"),
                                            ((F.max("t_us") - F.min("t_us")) * F.lit(1e-6)).alias("dur"))
    return g.select("rec", "n", r6(C.poisson_bits(F.col("n") / F.col("dur") / 128, F.lit(1.0)), "bits"))


def uleb_sql(v):
    return "(1 + " + " + ".join(f"CASE WHEN ({v}) >= {1 << (7 * j)} THEN 1 ELSE 0 END" for j in range(1, 9)) + ")"


@query("p18_zigzag_uleb", f"""WITH {EV}, v AS (SELECT rec, (t_us - 1296000000000)*(1 - 2*p) AS d FROM ev),
 z AS (SELECT rec, d, CASE WHEN d >= 0 THEN 2*d ELSE -2*d - 1 END AS u FROM v)
 SELECT rec, {uleb_sql('u')} AS n_bytes, count(*) AS n, CAST(sum(u % 1000003) AS BIGINT) AS u_check,
 CAST(sum(d % 1000003) AS BIGINT) AS d_check FROM z GROUP BY ALL""")
def p18(spark, d):
    v = events(spark, d).select("rec", ((F.col("t_us") - 1_296_000_000_000) * (1 - F.col("p") * 2)).alias("d"))
    z = v.withColumn("u", C.zigzag("d"))
    return z.groupBy("rec", C.uleb_len("u").alias("n_bytes")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("u") % 1000003).alias("u_check"),
        F.sum(C.unzigzag("u") % 1000003).alias("d_check"))


@query("p19_lead", f"""WITH {EV}, m(m) AS (SELECT * FROM range(1::BIGINT, 11)) SELECT rec, m, (m-1)*100000//3 AS lead_us,
 count(*) FILTER (tr // 1000 >= (m-1)*100000//3) AS n_after FROM ev, m GROUP BY ALL""")
def p19(spark, d):
    e = events(spark, d).withColumn("m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))))
    e = e.withColumn("lead_us", C.idiv((F.col("m") - 1) * 100_000, 3))
    return e.groupBy("rec", "m", "lead_us").agg(F.count_if(C.idiv("tr", 1000) >= F.col("lead_us")).alias("n_after"))


@query("p20_bin_origin", f"""WITH {EV}, c(k) AS (VALUES (3::BIGINT),(7),(32)), b AS (SELECT rec, k,
 least(k-1, tr*k//86400000000) AS f, count(*) AS n FROM ev, c GROUP BY ALL) SELECT rec, k, f, n,
 (f*86400000000 + k - 1)//k AS t_start, (2*f+1)*86400000000//(2*k) AS t_centre FROM b""")
def p20(spark, d):
    ks = F.explode(F.array(*[F.lit(k).cast("bigint") for k in (3, 7, 32)])).alias("k")
    b = events(spark, d).select("rec", "tr", ks).groupBy("rec", "k", C.time_bin("tr", "k", DAY).alias("f")).agg(
        F.count(F.lit(1)).alias("n"))
    return b.select("rec", "k", "f", "n", C.bin_start("f", "k", DAY).alias("t_start"),
                    C.bin_middle("f", "k", DAY).alias("t_centre"))


@query("p22_label_clock", f"""WITH {LABELS}, o AS (SELECT rec, min(t_us) AS t_offset FROM ev GROUP BY rec) SELECT rec,
 track_id, min(t_us - t_offset) AS t_first, max(t_us - t_offset) AS t_last, count(*) AS n FROM labels_raw JOIN o USING (rec)
 GROUP BY ALL""")
def p22(spark, d):
    off = events(spark, d).groupBy("rec").agg(F.min("t_us").alias("t_offset"))
    lab = raw_labels(spark, d).join(off, "rec").withColumn("t_us", F.col("t_us") - F.col("t_offset"))
    return lab.groupBy("rec", "track_id").agg(F.min("t_us").alias("t_first"), F.max("t_us").alias("t_last"),
                                              F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------ windows

KEYS = """keys AS (SELECT rec, unnest(generate_series(2::BIGINT, t_last//86400000000 - 4, 4)) AS w FROM
 (SELECT rec, max(t_us) AS t_last FROM ev GROUP BY rec))"""


def keys(ev, first=2, spacing=4, reach=4):
    return Wn.key_windows(ev, DAY, first, spacing, reach)


@query("g1_key_windows", f"WITH {EV}, {KEYS} SELECT rec, w FROM keys")
def g1(spark, d):
    return keys(events(spark, d))


GROUPS = KEYS + """, grp AS (SELECT rec, w AS g, unnest(range(0::BIGINT, 4)) AS m FROM keys),
 gw AS (SELECT rec, g, m, g + m AS w FROM grp)"""


@query("g3_group_windows", f"""WITH {EV}, {GROUPS} SELECT rec, g, m, w, count(*) AS n, CAST(sum(p) AS BIGINT) AS n_on FROM
 gw JOIN ev USING (rec, w) GROUP BY ALL""")
def g3(spark, d):
    ev = events(spark, d)
    n = ev.groupBy("rec", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("n_on"))
    return Wn.groups(keys(ev), 4).join(n, ["rec", "w"]).select("rec", "g", "m", "w", "n", "n_on")


@query("g4_tiles", f"""WITH {EV} SELECT rec, t_us//3600000000 AS tile, count(*) AS n, min(t_us % 3600000000) AS first_rel
 FROM ev GROUP BY ALL""")
def g4(spark, d):
    return Wn.tiles(events(spark, d), 3_600_000_000).groupBy("rec", "tile").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_tile").alias("first_rel"))


@query("g5_probe_windows", f"""WITH {EV}, l AS (SELECT rec, min(t_us) AS a, max(t_us) AS b FROM ev GROUP BY rec),
 j AS (SELECT rec, unnest(generate_series((a + 172800000000 - 1)//172800000000, (b - 21600000000 + 1)//172800000000)) AS j
 FROM l), c AS (SELECT rec, t_us//172800000000 AS j, count(*) AS n FROM ev WHERE t_us % 172800000000 < 21600000000
 GROUP BY ALL) SELECT rec, j, coalesce(n, 0) AS n FROM j LEFT JOIN c USING (rec, j)""")
def g5(spark, d):
    ev = events(spark, d)
    pr = Wn.probe_windows(ev, 2 * DAY, DAY // 4)
    n = Wn.probe_events(ev, pr, 2 * DAY, DAY // 4).groupBy("rec", "j").agg(F.count(F.lit(1)).alias("n"))
    return pr.join(n, ["rec", "j"], "left").select("rec", "j", F.coalesce("n", F.lit(0)).alias("n"))


@query("g6_spans", f"""WITH {EV}, {KEYS}, s AS (SELECT rec, w AS g, unnest(generate_series(greatest(0, w-3), w)) AS w FROM keys)
 SELECT rec, g, count(DISTINCT w) AS n_windows, count(*) AS n FROM s JOIN ev USING (rec, w) GROUP BY ALL""")
def g6(spark, d):
    ev = events(spark, d)
    n = ev.groupBy("rec", "w").agg(F.count(F.lit(1)).alias("n"))
    return Wn.spans(keys(ev), 3).join(n, ["rec", "w"]).groupBy("rec", "g").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n"))
