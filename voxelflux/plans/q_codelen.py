"""Code lengths."""
from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import codelen as L
from ..sensor import DAY, DEMO
from ..session import cut_lineage
from ..sources.tables import events
from .q_ingest import EV, age_sql, r6
from .registry import query

HOUR = 3_600_000_000
CHUNK = 1000
TH = EV + f", te AS (SELECT rec, seq, t_us//{HOUR} AS t, x, y, p FROM ev)"


def hourly(spark, d):
    return events(spark, d).select("rec", "seq", C.idiv("t_us", HOUR).alias("t"), "x", "y", "p",
                                   C.idiv("seq", CHUNK).alias("chunk"))


TIME = """l AS (SELECT *, t - lag(t) OVER (PARTITION BY {k} ORDER BY seq) + 1 AS dd FROM {src}), k0 AS (SELECT *, CAST(length(bin(dd)) - 1 AS BIGINT)
 AS k FROM l WHERE dd IS NOT NULL), k1 AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY {k} ORDER BY seq), 0) AS ctx FROM k0), k2 AS (SELECT *,
 row_number() OVER (PARTITION BY {k}, ctx, k ORDER BY seq) - 1 AS n, row_number() OVER (PARTITION BY {k}, ctx ORDER BY seq) - 1 AS nn FROM k1), tb AS
 (SELECT *, -log2((n+0.5)/(nn+20.0)) + k AS bits FROM k2)"""


@query("w7_time_bits", f"WITH {TH}, {TIME.format(k='rec', src='te')} SELECT rec, seq, k, round(bits,6) AS bits FROM tb")
def w7(spark, d):
    return L.time_bits(hourly(spark, d), ["rec"]).select("rec", "seq", "k", r6("time_bits", "bits"))


@query("w8_ratemap_bits", f"""WITH {TH} SELECT rec, seq, round(-log2((row_number() OVER (PARTITION BY rec, x, y ORDER BY seq) - 1 + 0.5)/(row_number()
 OVER (PARTITION BY rec ORDER BY seq) - 1 + 64.0)),6) AS bits FROM te""")
def w8(spark, d):
    return L.ratemap_bits(hourly(spark, d), ["rec"], DEMO).select("rec", "seq", r6("address_bits", "bits"))


@query("w9_polarity_bits", f"""WITH {TH} SELECT rec, seq, round(-log2((row_number() OVER (PARTITION BY rec, p ORDER BY seq) - 1 + 0.5)/(row_number()
 OVER (PARTITION BY rec ORDER BY seq) - 1 + 1.0)),6) AS bits FROM te""")
def w9(spark, d):
    return L.polarity_bits(hourly(spark, d), ["rec"]).select("rec", "seq", r6("polarity_bits", "bits"))


def context_sql(nbr):
    """State of every pixel at every event by brute force, then the prequential counts."""
    bn = ("(SELECT a.rec, a.seq, a.x, a.y, min(b.bs) AS bn FROM ep a JOIN ep b ON a.rec = b.rec AND a.seq = b.seq AND abs(a.x-b.x) <= 1 AND "
          "abs(a.y-b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL)" if nbr else "(SELECT rec, seq, x, y, 0 AS bn FROM ep)")
    return f"""te2 AS (SELECT *, t//6 AS slot FROM te), px AS (SELECT e.rec, e.seq, e.slot, a.x, b.y FROM te2 e, range(16) a(x), range(8) b(y)),
 ep AS (SELECT px.rec, px.seq, px.x, px.y, l.t AS lt, l.p AS lp, {age_sql('px.slot - l.slot')} AS bs FROM px ASOF LEFT JOIN te2 l ON l.rec = px.rec AND
 l.x = px.x AND l.y = px.y AND l.seq < px.seq), cs AS (SELECT ep.rec, ep.seq, ep.x, ep.y, bs*7 + bn AS cls FROM ep JOIN {bn} USING (rec, seq, x, y)),
 pop AS (SELECT rec, seq, cls, count(*) AS nc FROM cs GROUP BY ALL), oc AS (SELECT cs.rec, cs.seq, cs.cls AS own FROM cs JOIN te2 USING (rec, seq, x, y)),
 al AS (SELECT DISTINCT rec, cls FROM pop), gr AS (SELECT oc.rec, oc.seq, own, al.cls, coalesce(nc, 0) AS nc FROM oc JOIN al USING (rec) LEFT JOIN pop ON
 pop.rec = oc.rec AND pop.seq = oc.seq AND pop.cls = al.cls), st AS (SELECT *, coalesce(sum(nc) OVER q, 0) AS expo, coalesce(sum(CASE WHEN own = cls THEN
 1 ELSE 0 END) OVER q, 0) AS nev FROM gr WINDOW q AS (PARTITION BY rec, cls ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), zz AS
 (SELECT rec, seq, max(own) AS cls, sum(nc*(nev+0.5)/(expo+64.0)) AS z, max(CASE WHEN own = cls THEN (nev+0.5)/(expo+64.0) END) AS r FROM st GROUP BY
 ALL), nbp AS (SELECT e.rec, e.seq, arg_max(b.lp, (b.lt, -(b.y*16+b.x))) AS np FROM te2 e JOIN ep b ON b.rec = e.rec AND b.seq = e.seq AND abs(b.x-e.x)
 <= 1 AND abs(b.y-e.y) <= 1 AND (b.x <> e.x OR b.y <> e.y) WHERE b.lt IS NOT NULL GROUP BY ALL), pc AS (SELECT e.rec, e.seq, e.p, coalesce(ep.lp+1,0)*21
 + (zz.cls//7)*3 + coalesce(np+1,0) AS ctx, zz.cls, -log2(r/z) AS a FROM te2 e JOIN ep USING (rec, seq, x, y) JOIN zz USING (rec, seq) LEFT JOIN nbp USING
 (rec, seq)) SELECT rec, seq, CAST(cls AS INTEGER) AS cls, round(a,6) AS address_bits, round(-log2((row_number() OVER (PARTITION BY rec, ctx, p ORDER BY
 seq) - 0.5)/(row_number() OVER (PARTITION BY rec, ctx ORDER BY seq))),6) AS polarity_bits FROM pc"""


def context(spark, d, nbr):
    c = L.context_code(hourly(spark, d).drop("chunk"), ["rec"], DEMO, C.idiv("t", 6), nbr, chunk_slots=16)
    return c.select("rec", "seq", "cls", r6("address_bits", "address_bits"), r6("polarity_bits", "polarity_bits"))


@query("w10_context_m2", f"WITH {TH}, {context_sql(False)}")
def w10(spark, d):
    return context(spark, d, False)


@query("w10_context_c1", f"WITH {TH}, {context_sql(True)}")
def w10c(spark, d):
    return context(spark, d, True)


@query("a9_sharpness", f"""WITH {EV}, s AS (SELECT rec, w, p, round_even(x - 2.0::DOUBLE*((tr - 43200000000)*(1.0/86400000000)::DOUBLE), 0) AS sx, y, count(*)
 AS c FROM ev GROUP BY ALL) SELECT rec, w, CAST(sum(c) AS BIGINT) AS n, round(sum(c*c)/sum(c),6) AS sharpness, round(sum(c)/count(*),6) AS redundancy
 FROM s GROUP BY ALL""")
def a9(spark, d):
    x = C.warp_velocity("x", "tr", F.lit(DAY // 2), 2.0, 1.0 / DAY)
    return L.sharpness(events(spark, d), ["rec", "w"], x, F.col("y").cast("double")).withColumns(
        {"sharpness": r6("sharpness"), "redundancy": r6("redundancy")})


@query("a10_address_entropy", f"""WITH {EV}, c AS (SELECT rec, y*16+x AS u, count(*) AS c FROM ev GROUP BY ALL), q AS (SELECT rec, c, c/sum(c) OVER (PARTITION
 BY rec) AS q FROM c) SELECT rec, CAST(sum(c) AS BIGINT) AS n, round(-sum(q*log2(q)),6) AS entropy_bits FROM q GROUP BY rec""")
def a10(spark, d):
    return L.address_entropy(events(spark, d), ["rec"]).withColumn("entropy_bits", r6("entropy_bits"))


TIE = """e AS (SELECT {k}, t, x, y, p, count(*) AS c FROM {src} GROUP BY ALL), g AS (SELECT {k}, t, sum(c) AS n, sum(lgamma(c+1))/ln(2.0) AS dd, count(*) FILTER
 (c > 1) AS kk FROM e GROUP BY ALL), sv AS (SELECT {k}, sum(lgamma(n+1)/ln(2.0) - dd) AS saving, CAST(sum(kk) AS BIGINT) AS duplicate_groups,
 CAST(sum(n-1) AS BIGINT) AS n_ties FROM g GROUP BY ALL)"""


@query("a11_tie_order", f"WITH {TH}, {TIE.format(k='rec', src='te')} SELECT rec, round(saving,6) AS saving_bits, duplicate_groups, n_ties FROM sv")
def a11(spark, d):
    return L.order_free_saving(hourly(spark, d), ["rec"]).withColumn("saving_bits", r6("saving_bits"))


RES = (1, 2, 6, 12, 24)


@query("w16_resolution_sweep", f"""WITH {EV}, rs(res) AS (VALUES (1::BIGINT),(2),(6),(12),(24)), s0 AS (SELECT res, rec, t_us//({HOUR}*res) AS t, x, y, p, row_number() OVER
 (PARTITION BY res, rec ORDER BY t_us//({HOUR}*res), y, x, p, seq) - 1 AS seq FROM ev, rs), {TIME.format(k='res, rec', src='s0')}, {TIE.format(
     k='res, rec', src='s0')}, tm AS (SELECT res, rec, sum(bits) AS tbits FROM tb GROUP BY ALL), ab AS (SELECT res, rec, -log2((row_number() OVER (PARTITION BY
 res, rec, x, y ORDER BY seq) - 0.5)/(row_number() OVER (PARTITION BY res, rec ORDER BY seq) + 63.0)) AS a, -log2((row_number() OVER (PARTITION BY res, rec, p
 ORDER BY seq) - 0.5)/(row_number() OVER (PARTITION BY res, rec ORDER BY seq))) AS pb FROM s0), aa AS (SELECT res, rec, count(*) AS n, sum(a) AS a, sum(pb) AS
 pb FROM ab GROUP BY ALL) SELECT res, rec, n, round(tbits/n,6) AS time_bits, round(a/n,6) AS address_bits, round(pb/n,6) AS polarity_bits, round(saving/n,6)
 AS tie_order_bits, round(n_ties/(n-1),6) AS tie_share FROM aa JOIN tm USING (res, rec) JOIN sv USING (res, rec)""")
def w16(spark, d):
    return resolution_sweep(events(spark, d), DEMO, RES, HOUR)


def resolution_sweep(ev, sensor, resolutions, unit):
    """Code length per event against the clock resolution, in canonical order inside each tick."""
    from ..operators.scans import ranked
    r = F.explode(F.array(*[F.lit(x).cast("bigint") for x in resolutions])).alias("res")
    e = ev.select("rec", F.col("seq").alias("_s"), "t_us", "x", "y", "p", r).withColumn("t", C.idiv("t_us", F.col("res") * unit))
    e = e.withColumn("_ck", C.idiv("t_us", DAY))                                  # days nest every resolution used here
    k = ["res", "rec"]
    e = ranked(e, k, ["t", "y", "x", "p", "_s"], "_ck", "seq").select(*k, "seq", "t", "x", "y", "p", C.idiv("seq", CHUNK).alias("chunk"))
    e = cut_lineage(e)
    t = L.time_bits(e, k).groupBy(*k).agg(F.sum("time_bits").alias("tb"))
    a = L.polarity_bits(L.ratemap_bits(e, k, sensor), k).groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.sum("address_bits").alias("ab"), F.sum("polarity_bits").alias("pb"))
    s = L.order_free_saving(e, k)
    n = F.col("n")
    return a.join(t, k).join(s, k).select(
        "res", "rec", "n", r6(F.col("tb") / n, "time_bits"), r6(F.col("ab") / n, "address_bits"), r6(F.col("pb") / n, "polarity_bits"),
        r6(F.col("saving_bits") / n, "tie_order_bits"), r6(F.col("n_ties") / (n - 1), "tie_share"))
