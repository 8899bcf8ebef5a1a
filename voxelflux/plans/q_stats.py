"""Derived rows, strata, gates, intervals, decisions and cross-stage checks."""
from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import stats as St
from ..sensor import DAY
from ..session import cut_lineage
from ..sources.ingest import lighting
from ..sources.tables import events
from .q_ingest import EV, r6
from .registry import query
from .sqltext import h

LIGHT = "CASE WHEN rec LIKE 'day%' THEN 'day' ELSE 'night' END"

ROWS = EV + f""", pd AS (SELECT rec, "user" AS track_id, w AS t_e, count(*) AS n, CAST(sum(tr) AS BIGINT) AS st FROM ev GROUP BY ALL), r0 AS
 (SELECT *, {h(41, 'track_id*64 + t_e', 'setting')}//65536 AS hh FROM pd, (VALUES (0::BIGINT),(1)) s(setting)), inst_rows AS (SELECT rec,
 {LIGHT} AS lighting, track_id, t_e, setting, n, CASE WHEN n = 1 THEN 'template_too_small' WHEN hh%13 = 0 THEN 'support_outside_sensor' ELSE
 '' END AS skip, CASE WHEN track_id%3 = 0 THEN 'other' ELSE 'vehicles' END AS grp, hh%4 AS speed_bin, (hh//4)%2 AS overlap,
 (hh%1000)/250.0::DOUBLE AS static_gain, (hh%1000)/250.0::DOUBLE + n*0.5::DOUBLE - (hh%7)/10.0::DOUBLE AS cmax_gain, ((hh//8)%21 -
 10)::DOUBLE AS vlx, ((hh//32)%11 - 5)::DOUBLE AS vly, ((hh//8)%21 - 10 + hh%3 - 1)::DOUBLE AS cvx, ((hh//32)%11 - 5 + (hh//3)%3 - 1)::DOUBLE
 AS cvy, [0.125::DOUBLE, 0.25, 0.5, 1.0][1 + hh%4] AS b_px, 1 + hh%9 AS n_pred, st//n AS tau FROM r0)"""


def instant_rows(spark, d):
    """One row per (track, window, setting) with model quantities derived from the counts and a row hash."""
    pd = events(spark, d).groupBy("rec", F.col("user").alias("track_id"), F.col("w").alias("t_e")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tr").alias("st"))
    r = pd.withColumn("setting", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    r = r.withColumn("hh", C.idiv(C.mix(41, F.col("track_id") * 64 + F.col("t_e"), "setting"), 65536))
    hh = F.col("hh")
    q = lambda div, mod: C.idiv(hh, div) % mod                                                     # noqa: E731
    g = (hh % 1000) / 250.0
    return r.select(
        "rec", lighting().alias("lighting"), "track_id", "t_e", "setting", "n",
        F.when(F.col("n") == 1, "template_too_small").when(hh % 13 == 0, "support_outside_sensor").otherwise("").alias("skip"),
        F.when(F.col("track_id") % 3 == 0, "other").otherwise("vehicles").alias("grp"), (hh % 4).alias("speed_bin"),
        q(4, 2).alias("overlap"), g.alias("static_gain"), (g + F.col("n") * 0.5 - (hh % 7) / 10.0).alias("cmax_gain"),
        (q(8, 21) - 10).cast("double").alias("vlx"), (q(32, 11) - 5).cast("double").alias("vly"),
        (q(8, 21) - 10 + hh % 3 - 1).cast("double").alias("cvx"), (q(32, 11) - 5 + q(3, 3) - 1).cast("double").alias("cvy"),
        F.get(F.array(*[F.lit(b) for b in (0.125, 0.25, 0.5, 1.0)]), (hh % 4).cast("int")).alias("b_px"),
        (1 + hh % 9).alias("n_pred"), C.idiv("st", "n").alias("tau"))


def derived(rows):
    """Per-instant quantities; NULL where a divisor is zero or the row was skipped."""
    sl, sc = F.hypot("vlx", "vly"), F.hypot("cvx", "cvy")
    ok = F.col("skip") == ""
    sr = F.when(sl > 0, sc / sl)
    cos = F.when((sl > 0) & (sc > 0), (F.col("cvx") * F.col("vlx") + F.col("cvy") * F.col("vly")) / (sc * sl))
    r = rows.withColumns({
        "Delta": F.when(ok, F.col("cmax_gain") - F.col("static_gain")), "speed_ratio": F.when(ok, sr),
        "angle_deg": F.when(ok, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))),
        "bmin": F.when(ok, (F.abs(F.col("b_px") - 0.125) < 1e-12).cast("double"))})
    inside = F.when(F.col("speed_ratio").isNotNull(), F.col("speed_ratio").between(0.8, 1.25).cast("double"))
    # greatest / least skip NULL, so an undefined cosine is masked afterwards
    return r.withColumns({"ratio_inside": inside, "angle_deg": F.when(cos.isNotNull(), F.col("angle_deg"))})


DERIVED = ROWS + """, dr AS (SELECT *, CASE WHEN skip = '' THEN cmax_gain - static_gain END AS Delta, CASE WHEN skip = '' AND vlx*vlx+vly*vly > 0
 THEN sqrt(cvx*cvx+cvy*cvy)/sqrt(vlx*vlx+vly*vly) END AS speed_ratio, CASE WHEN skip = '' AND vlx*vlx+vly*vly > 0 AND cvx*cvx+cvy*cvy > 0 THEN
 degrees(acos(greatest(-1.0, least(1.0, (cvx*vlx+cvy*vly)/(sqrt(cvx*cvx+cvy*cvy)*sqrt(vlx*vlx+vly*vly)))))) END AS angle_deg, CASE WHEN skip = ''
 THEN CASE WHEN abs(b_px-0.125) < 1e-12 THEN 1.0::DOUBLE ELSE 0.0 END END AS bmin FROM inst_rows)"""


@query("p21_derived", f"""WITH {DERIVED} SELECT rec, track_id, t_e, setting, round(Delta,6) AS Delta, round(speed_ratio,6) AS speed_ratio,
 round(angle_deg,3) AS angle_deg, bmin, CASE WHEN speed_ratio IS NULL THEN NULL WHEN speed_ratio BETWEEN 0.8 AND 1.25 THEN 1.0::DOUBLE ELSE 0.0
 END AS ratio_inside FROM dr""")
def p21(spark, d):
    return derived(instant_rows(spark, d)).select("rec", "track_id", "t_e", "setting", r6("Delta", "Delta"),
                                                  r6("speed_ratio", "speed_ratio"), F.round("angle_deg", 3).alias("angle_deg"),
                                                  "bmin", "ratio_inside")


@query("a19_skip_accounting", f"""WITH {ROWS} SELECT setting, lighting, grp, count(*) AS generated, count(*) FILTER (skip = '') AS scored,
 count(*) FILTER (skip = 'template_too_small') AS template_too_small, count(*) FILTER (skip = 'support_outside_sensor') AS
 support_outside_sensor, CAST(sum(n) AS BIGINT) AS events, round(sum(CASE WHEN skip = '' THEN n ELSE 0 END)/greatest(1, sum(n)),6) AS share_scored
 FROM inst_rows GROUP BY ALL""")
def a19(spark, d):
    r = instant_rows(spark, d)
    name = F.when(F.col("skip") == "", "scored").otherwise(F.col("skip"))
    reasons = ["scored", "template_too_small", "support_outside_sensor"]
    p = r.withColumn("reason", name).groupBy("setting", "lighting", "grp").pivot("reason", reasons).agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    for k in reasons:
        p = p.withColumn(k, F.coalesce(F.col(f"{k}_c"), F.lit(0)))
    ev = sum((F.coalesce(F.col(f"{k}_n"), F.lit(0)) for k in reasons[1:]), F.coalesce(F.col("scored_n"), F.lit(0)))
    return p.select("setting", "lighting", "grp", sum((F.col(k) for k in reasons[1:]), F.col("scored")).alias("generated"), *reasons,
                    ev.alias("events"), r6(F.coalesce("scored_n", F.lit(0)) / F.greatest(F.lit(1), ev), "share_scored"))


@query("a20_strata_cube", f"""WITH {DERIVED}, lv AS (SELECT *, unnest(['all', grp]) AS gl FROM dr WHERE skip = ''), lv2 AS (SELECT *, unnest(CASE
 WHEN speed_bin IN (1,2) THEN ['all', CASE WHEN speed_bin = 1 THEN '20-100' ELSE '100-300' END, '20-300'] WHEN speed_bin = 0 THEN ['all','0-20']
 ELSE ['all','300-inf'] END) AS sl FROM lv), lv3 AS (SELECT *, unnest(['all', CASE WHEN overlap = 0 THEN 'isolated' ELSE 'overlapping' END]) AS ol
 FROM lv2) SELECT rec, setting, gl AS group_level, sl AS speed_level, ol AS overlap_level, count(*) AS n_rows, round(median(Delta),6) AS Delta,
 round(median(speed_ratio),6) AS speed_ratio, round(avg(bmin),6) AS bmin FROM lv3 GROUP BY ALL""")
def a20(spark, d):
    r = St.strata_levels(derived(instant_rows(spark, d)).filter("skip = ''"))
    p = St.per_recording(r, ["rec", "setting", "group_level", "speed_level", "overlap_level"], ("Delta", "speed_ratio"), ("bmin",))
    return p.withColumns({c: r6(c) for c in ("Delta", "speed_ratio", "bmin")})


def boot_sql(src, key, agg, n_boot):
    """Replicates of `agg` over src(key, rec, ..), each row as often as it is drawn."""
    m = "+".join(f"(u >= {t})::BIGINT" for t in St.POISSON)
    return f"""bu AS (SELECT *, ('0x' || substr(md5('{St.BOOT_SEED}:' || rec || ':' || b), 1, 8))::BIGINT AS u FROM {src}, range({n_boot}) t(b)),
 bx AS (SELECT *, unnest(range({m})) AS copy FROM bu), bs AS (SELECT {key}, b, {agg} AS v FROM bx GROUP BY ALL),
 ci AS (SELECT {key}, quantile_cont(v, 0.025::DOUBLE) AS lo, quantile_cont(v, 0.975::DOUBLE) AS hi FROM bs GROUP BY ALL)"""


@query("a21_boot_median", f"""WITH {DERIVED}, pr AS (SELECT lighting, setting, rec, median(Delta) AS Delta FROM dr WHERE skip = '' GROUP BY ALL HAVING
 count(*) >= 20), {boot_sql('pr', 'lighting, setting', 'median(Delta)', 2000)}, md AS (SELECT lighting, setting, median(Delta) AS m, count(*) AS n
 FROM pr GROUP BY ALL) SELECT lighting, setting, n AS n_recordings, round(m,6) AS median, round(lo,6) AS lo, round(hi,6) AS hi FROM md JOIN ci
 USING (lighting, setting)""")
def a21(spark, d):
    r = derived(instant_rows(spark, d)).filter("skip = ''")
    p = St.per_recording(r, ["lighting", "setting", "rec"], ("Delta",))
    b = St.boot_median(p, ["lighting", "setting"], "Delta", F.col("n_rows") >= 20)
    return b.select("lighting", "setting", "n_recordings", r6("median", "median"), r6("lo", "lo"), r6("hi", "hi"))


@query("a22_boot_ratio", f"""WITH {ROWS}, pr AS (SELECT lighting, rec, CAST(sum(CASE WHEN skip = '' THEN n ELSE 0 END) AS BIGINT) AS num,
 CAST(sum(n) AS BIGINT) AS den FROM inst_rows GROUP BY ALL), {boot_sql('pr', 'lighting', 'sum(num)/sum(den)', 2000)}, md AS (SELECT lighting,
 count(*) AS n_recordings, CAST(sum(den) AS BIGINT) AS n, sum(num)/sum(den) AS value FROM pr GROUP BY ALL) SELECT lighting, n_recordings, n,
 round(value,6) AS value, round(lo,6) AS lo, round(hi,6) AS hi FROM md JOIN ci USING (lighting)""")
def a22(spark, d):
    p = instant_rows(spark, d).groupBy("lighting", "rec").agg(F.sum(F.when(F.col("skip") == "", F.col("n")).otherwise(0)).alias("num"),
                                                              F.sum("n").alias("den"))
    b = St.boot_ratio(p, ["lighting"], "num", "den")
    return b.select("lighting", "n_recordings", "n", r6("value", "value"), r6("lo", "lo"), r6("hi", "hi"))


POOLED = ROWS + """, zb AS (SELECT rec, n, (c*c+s*s)/n AS z FROM (SELECT rec, w, (y//4)*4+x//4 AS block, count(*) AS n,
 sum(cos(2*pi()*tr/86400000000.0)) AS c, sum(sin(2*pi()*tr/86400000000.0)) AS s FROM ev GROUP BY ALL)), rc AS (SELECT rec, count(*) AS n FROM ev GROUP BY
 rec), zc AS (SELECT rec, count(*) AS nb, sum(z) AS z, sum(n) AS np FROM zb WHERE n >= 5 GROUP BY rec), tc AS (SELECT rec, count(*) FILTER (skip = '' AND
 abs(cvx-vlx) + abs(cvy-vly) <= 1) AS ok, count(*) FILTER (skip <> '' AND n = 1) AS fail, count(*) FILTER (skip = '' OR n = 1) AS defined FROM inst_rows WHERE
 setting = 0 GROUP BY rec), cells AS (SELECT rec, 'mean_Z' AS cell, coalesce(z, 0)::DOUBLE AS num, coalesce(nb, 0)::BIGINT AS den FROM rc LEFT JOIN zc USING
 (rec) UNION ALL SELECT rec, 'share_tested', coalesce(np, 0)::DOUBLE, n FROM rc LEFT JOIN zc USING (rec) UNION ALL SELECT rec, 'success1', coalesce(ok,
 0)::DOUBLE, coalesce(defined, 0) FROM rc LEFT JOIN tc USING (rec) UNION ALL SELECT rec, 'fail_share', coalesce(fail, 0)::DOUBLE, coalesce(defined, 0) FROM
 rc LEFT JOIN tc USING (rec)), pc AS (SELECT """ + LIGHT + """ AS lighting, * FROM cells)"""


@query("a22_pooled_cells", f"""WITH {POOLED}, {boot_sql('pc', 'lighting, cell', 'CASE WHEN sum(den) > 0 THEN sum(num)/sum(den) END', 2000)}, md AS (SELECT
 lighting, cell, count(*) AS n_recordings, CAST(sum(den) AS BIGINT) AS n, CASE WHEN sum(den) > 0 THEN sum(num)/sum(den) END AS value FROM pc GROUP BY ALL)
 SELECT lighting, cell, n_recordings, n, round(value,6) AS value, round(lo,6) AS lo, round(hi,6) AS hi FROM md LEFT JOIN ci USING (lighting, cell)""")
def a22_pooled(spark, d):
    """Pooled mean Rayleigh statistic, coverage, and success and failure shares of a task over all recordings of a stratum, with intervals. All cells go
    through one bootstrap, so replicate b is the same draw of recordings in each."""
    ev = events(spark, d)
    a = F.lit(6.283185307179586) * F.col("tr") / float(DAY)
    b = ev.groupBy("rec", "w", C.block_id("x", "y", 4, 16).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"))
    tested, z = F.col("n") >= 5, (F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")
    rc = b.groupBy("rec").agg(F.sum("n").alias("n"), F.sum(F.when(tested, F.col("n"))).alias("np"), F.sum(F.when(tested, z)).alias("z"),
                              F.count_if(tested).alias("nb"))
    ok, small = F.col("skip") == "", F.col("n") == 1
    err = F.abs(F.col("cvx") - F.col("vlx")) + F.abs(F.col("cvy") - F.col("vly"))
    tc = instant_rows(spark, d).filter("setting = 0").groupBy("rec").agg(
        F.count_if(ok & (err <= 1)).alias("ok"), F.count_if(~ok & small).alias("fail"), F.count_if(ok | small).alias("defined"))
    cell = lambda name, num, den: F.struct(F.lit(name).alias("cell"), F.coalesce(F.col(num).cast("double"), F.lit(0.0)).alias("num"),
                                           F.coalesce(F.col(den), F.lit(0)).alias("den"))
    cells = F.explode(F.array(cell("mean_Z", "z", "nb"), cell("share_tested", "np", "n"), cell("success1", "ok", "defined"),
                              cell("fail_share", "fail", "defined"))).alias("_c")
    p = rc.join(tc, "rec", "left").select("rec", lighting().alias("lighting"), cells).select("rec", "lighting", "_c.*")
    r = St.boot_ratio(p, ["lighting", "cell"], "num", "den")
    return r.select("lighting", "cell", "n_recordings", "n", r6("value", "value"), r6("lo", "lo"), r6("hi", "hi"))


@query("a23_rayleigh", f"""WITH {EV}, b AS (SELECT rec, w, (y//4)*4+x//4 AS block, count(*) AS n, sum(cos(2*pi()*tr/86400000000.0)) AS c,
 sum(sin(2*pi()*tr/86400000000.0)) AS s FROM ev GROUP BY ALL HAVING count(*) >= 5), z AS (SELECT rec, n, (c*c+s*s)/n AS z FROM b) SELECT rec,
 count(*) AS blocks, CAST(sum(n) AS BIGINT) AS pixels, round(avg(z),6) AS mean_Z, round(avg(CASE WHEN z > 4.605170185988092 THEN 1 ELSE 0 END),6)
 AS share_above FROM z GROUP BY rec""")
def a23(spark, d):
    a = F.lit(6.283185307179586) * F.col("tr") / float(DAY)
    b = events(spark, d).groupBy("rec", "w", C.block_id("x", "y", 4, 16).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"))
    return St.rayleigh(b, ["rec"]).withColumns({c: r6(c) for c in ("mean_Z", "share_above")})


@query("a24_acceptance", f"""WITH {ROWS}, a AS (SELECT 'outside_window_or_sensor' AS "check", count(*) FILTER (tr < 0 OR tr >= 86400000000 OR x < 0
 OR x >= 16 OR y < 0 OR y >= 8) AS violations FROM ev UNION ALL SELECT 'scored_plus_skipped', count(*) FILTER (skip <> '' AND n > 1 AND skip <>
 'support_outside_sensor') FROM inst_rows UNION ALL SELECT 'duplicate_rows', count(*) FROM (SELECT 1 FROM inst_rows GROUP BY rec, track_id, t_e,
 setting HAVING count(*) > 1) UNION ALL SELECT 'missing_rows', count(*) FROM (SELECT DISTINCT rec, "user" AS track_id, w AS t_e FROM ev EXCEPT ALL
 SELECT rec, track_id, t_e FROM inst_rows WHERE setting = 0)) SELECT "check", violations, violations = 0 AS pass FROM a""")
def a24(spark, d):
    ev, r = events(spark, d), instant_rows(spark, d)
    out = (F.col("tr") < 0) | (F.col("tr") >= DAY) | (F.col("x") < 0) | (F.col("x") >= 16) | (F.col("y") < 0) | (F.col("y") >= 8)
    a = ev.agg(F.lit("outside_window_or_sensor").alias("check"), F.count_if(out).alias("violations"))
    b = r.agg(F.lit("scored_plus_skipped").alias("check"),
              F.count_if((F.col("skip") != "") & (F.col("n") > 1) & (F.col("skip") != "support_outside_sensor")).alias("violations"))
    dup = r.groupBy("rec", "track_id", "t_e", "setting").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    c = dup.agg(F.lit("duplicate_rows").alias("check"), F.count(F.lit(1)).alias("violations"))
    exp = ev.select("rec", F.col("user").alias("track_id"), F.col("w").alias("t_e")).distinct()
    m = exp.exceptAll(r.filter("setting = 0").select("rec", "track_id", "t_e")).agg(
        F.lit("missing_rows").alias("check"), F.count(F.lit(1)).alias("violations"))
    u = a.unionByName(b).unionByName(c).unionByName(m)
    return u.withColumn("pass", F.col("violations") == 0)


@query("a25_kendall_tau", f"""WITH {DERIVED}, it AS (SELECT rec, speed_bin*2 + overlap AS item, round(avg(Delta),9) AS a, round(avg(cmax_gain),9) AS b
 FROM dr WHERE skip = '' GROUP BY ALL), p AS (SELECT a.rec, sign(a.a-b.a) AS sa, sign(a.b-b.b) AS sb FROM it a JOIN it b ON a.rec = b.rec AND a.item
 < b.item) SELECT rec, round(sum(sa*sb)/sqrt(sum(abs(sa))*sum(abs(sb))),6) AS tau_b FROM p GROUP BY rec""")
def a25(spark, d):
    it = derived(instant_rows(spark, d)).filter("skip = ''").groupBy("rec", (F.col("speed_bin") * 2 + F.col("overlap")).alias("item")).agg(
        F.round(F.avg("Delta"), 9).alias("a"), F.round(F.avg("cmax_gain"), 9).alias("b"))
    return St.kendall_tau_b(it, ["rec"], "item", "a", "b").withColumn("tau_b", r6("tau_b"))


A29_SQL = f"""WITH {DERIVED}, pr AS (SELECT lighting, setting, rec, median(Delta) AS v, count(*) AS n, CAST(sum(n) AS BIGINT) AS num FROM dr WHERE
 skip = '' GROUP BY ALL), dn AS (SELECT setting, rec, CAST(sum(n) AS BIGINT) AS den FROM inst_rows GROUP BY ALL), pw AS (SELECT setting, rec,
 coalesce(num, 0) AS num, den FROM dn LEFT JOIN pr USING (setting, rec)), m AS (SELECT setting, median(v) FILTER (lighting = 'day') AS dd,
 median(v) FILTER (lighting = 'night') AS dn FROM pr GROUP BY setting), lock AS (SELECT * FROM (WITH {boot_sql('pr', 'setting', 'median(v)', 2000)}
 SELECT * FROM ci)), share AS (SELECT * FROM (WITH {boot_sql('pw', 'setting', 'sum(num)/sum(den)', 2000)} SELECT * FROM ci)) SELECT setting, round(dd,6)
 AS delta_day, round(dn,6) AS delta_night, CASE WHEN dd IS NULL OR dn IS NULL THEN 'UNDEFINED' WHEN dd >= 3 AND dn >= 3 THEN 'GO' WHEN dd < 1 AND dn <
 1 THEN 'NO-GO' ELSE 'INTERMEDIATE' END AS outcome, CASE WHEN share.hi < 0.1 THEN 'independent' WHEN share.lo > 0.3 THEN 'correlated' ELSE 'partial' END
 AS reading_share, CASE WHEN lock.hi < 2 THEN 'no lock within blocks' WHEN lock.lo > 5 THEN 'lock within blocks' ELSE 'partial' END AS reading_lock FROM
 m JOIN lock USING (setting) JOIN share USING (setting)"""


@query("a29_decision", A29_SQL)
def a29(spark, d):
    """Decision from the medians of both groups; readings from the 95 % bounds of the pooled share and of the median."""
    rows = instant_rows(spark, d)
    p = cut_lineage(St.per_recording(derived(rows).filter("skip = ''"), ["lighting", "setting", "rec"], ("Delta",)))
    m = p.groupBy("setting").agg(F.median(F.when(F.col("lighting") == "day", F.col("Delta"))).alias("dd"),
                                 F.median(F.when(F.col("lighting") == "night", F.col("Delta"))).alias("dn"))
    share = rows.groupBy("setting", "rec").agg(F.sum(F.when(F.col("skip") == "", F.col("n")).otherwise(0)).alias("num"), F.sum("n").alias("den"))
    lock = St.boot_median(p, ["setting"], "Delta").select("setting", F.col("lo").alias("lock_lo"), F.col("hi").alias("lock_hi"))
    share = St.boot_ratio(share, ["setting"], "num", "den").select("setting", F.col("lo").alias("share_lo"), F.col("hi").alias("share_hi"))
    return m.join(lock, "setting").join(share, "setting").select(
        "setting", r6("dd", "delta_day"), r6("dn", "delta_night"), St.decision("dd", "dn").alias("outcome"),
        St.reading_share("share_lo", "share_hi").alias("reading_share"), St.reading_lock("lock_lo", "lock_hi").alias("reading_lock"))


DECOMP = EV + """, c1 AS (SELECT rec, w+1 AS w, p, least(2, tr*3//86400000000) AS tb, y//2 AS by, x//2 AS bx, count(*) AS c FROM ev GROUP BY ALL), c2 AS
 (SELECT rec, w-1 AS w, p, tb, by, bx, c FROM c1), u AS (SELECT rec, w, p, tb, by, bx, c AS a, 0 AS b FROM c1 UNION ALL SELECT rec, w, p, tb, by, bx, 0,
 c FROM c2), g AS (SELECT rec, w, p, tb, by, bx, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL), q AS (SELECT rec, w, sum(a) AS np, sum(b) AS nt,
 sum(least(a,b)) AS m FROM g GROUP BY ALL), dcm AS (SELECT rec, w, np, nt, m, 2.0*m/(np+nt) AS f1, m/np AS prec, m/nt AS rec_, 2.0*least(np,nt)/(np+nt)
 AS ceiling, m/least(np,nt) AS placement, nt/np AS growth FROM q WHERE np > 0 AND nt > 0)"""


def decomposition(spark, d):
    """F1 of the repeated window split into a count ceiling and a placement share."""
    from ..operators import voxels as V
    from ..sensor import DEMO
    ev = events(spark, d)
    m = cut_lineage(V.match_repeated(ev, [(2, 3)], DEMO)).filter("n1 > 0 AND n2 > 0")
    lo = F.least("n1", "n2")
    return m.select("rec", "w", "n1", "n2", "pairs", (F.col("pairs") * 2.0 / (F.col("n1") + F.col("n2"))).alias("f1"),
                    (F.col("pairs") / F.col("n1")).alias("precision"), (F.col("pairs") / F.col("n2")).alias("recall"),
                    (lo * 2.0 / (F.col("n1") + F.col("n2"))).alias("ceiling"), (F.col("pairs") / lo).alias("placement"),
                    (F.col("n2") / F.col("n1")).alias("growth"))


@query("a30_decomposition", f"""WITH {DECOMP} SELECT rec, w, round(f1,6) AS f1, round(prec,6) AS precision, round(rec_,6) AS recall, round(ceiling,6) AS
 ceiling, round(placement,6) AS placement, abs(ceiling*placement - f1) <= 1e-12 AS identity_holds, CASE WHEN f1 < 1 AND m > 0 THEN
 round(ln(ceiling)/ln(f1),6) END AS ceiling_share_of_fall FROM dcm""")
def a30(spark, d):
    r = decomposition(spark, d)
    share = F.when((F.col("f1") < 1) & (F.col("pairs") > 0), F.ln("ceiling") / F.ln("f1"))
    return r.select("rec", "w", *[r6(c, c) for c in ("f1", "precision", "recall", "ceiling", "placement")],
                    (F.abs(F.col("ceiling") * F.col("placement") - F.col("f1")) <= 1e-12).alias("identity_holds"),
                    r6(share, "ceiling_share_of_fall"))


GROWTH_EDGES = (0.0, 0.8, 0.9, 1.1, 1.25, None)        # fixed classes


@query("a31_classed_quantiles", f"""WITH {DECOMP}, c AS (SELECT {LIGHT} AS lighting, CASE WHEN growth < 0.8 THEN 0 WHEN growth < 0.9 THEN 1 WHEN growth
 < 1.1 THEN 2 WHEN growth < 1.25 THEN 3 ELSE 4 END AS growth_class, f1 FROM dcm) SELECT lighting, growth_class, count(*) AS n_rows,
 round(quantile_cont(f1, 0.1::DOUBLE),6) AS q10, round(quantile_cont(f1, 0.5::DOUBLE),6) AS q50, round(quantile_cont(f1, 0.9::DOUBLE),6) AS q90 FROM c
 GROUP BY ALL""")
def a31(spark, d):
    r = decomposition(spark, d).withColumns({"lighting": lighting(), "growth_class": St.edges_class("growth", GROWTH_EDGES)})
    return St.classed_quantiles(r, ["lighting", "growth_class"], "f1", (0.1, 0.5, 0.9)).withColumns(
        {c: r6(c) for c in ("q10", "q50", "q90")})


@query("a39_complete_groups", f"""WITH {ROWS}, k AS (SELECT * FROM inst_rows WHERE setting = 0), g AS (SELECT rec, track_id, t_e//4*4 AS g, count(*) FILTER
 (t_e % 4 > 0 AND skip = '') AS ok, sum(CASE WHEN t_e % 4 = 0 THEN n END) AS n_key, sum(CASE WHEN t_e % 4 > 0 THEN n ELSE 0 END) AS n_true,
 sum(CASE WHEN t_e % 4 > 0 THEN n_pred ELSE 0 END) AS n_pred FROM k GROUP BY ALL) SELECT rec, track_id, g, CAST(n_key AS BIGINT) AS n_key, CAST(n_true
 AS BIGINT) AS n_true, CAST(n_pred AS BIGINT) AS n_pred, round(n_key/(n_key+n_true),6) AS share FROM g WHERE ok = 3 AND n_key IS NOT NULL""")
def a39(spark, d):
    r = instant_rows(spark, d).filter("setting = 0").withColumns({"g": C.idiv("t_e", 4) * 4, "m": F.col("t_e") % 4})
    z = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))                                        # noqa: E731
    g = r.groupBy("rec", "track_id", "g").agg(
        F.count_if((F.col("m") > 0) & (F.col("skip") == "")).alias("ok"), F.sum(F.when(F.col("m") == 0, F.col("n"))).alias("n_key"),
        z(F.col("m") > 0, "n").alias("n_true"), z(F.col("m") > 0, "n_pred").alias("n_pred"))
    return g.filter("ok = 3 AND n_key IS NOT NULL").select(
        "rec", "track_id", "g", "n_key", "n_true", "n_pred", r6(F.col("n_key") / (F.col("n_key") + F.col("n_true")), "share"))


@query("a41_outcome_classes", f"""WITH {ROWS}, o AS (SELECT lighting, CASE WHEN skip = '' THEN abs(cvx-vlx) + abs(cvy-vly) END AS err, CASE WHEN n = 1 THEN
 0 ELSE n END AS n_rec FROM inst_rows WHERE setting = 0), c AS (SELECT lighting, err, CASE WHEN err IS NOT NULL THEN 'error' WHEN n_rec > 0 THEN
 'undefined' ELSE 'failure' END AS cls FROM o), s AS (SELECT lighting, count(*) FILTER (cls <> 'undefined') AS n, count(*) FILTER (cls = 'undefined') AS
 n_undefined, count(*) FILTER (cls = 'failure') AS n_fail, count(*) FILTER (err <= 1) AS ok, median(CASE cls WHEN 'error' THEN err WHEN 'failure' THEN
 1e300::DOUBLE END) AS med FROM c GROUP BY lighting) SELECT lighting, n, n_undefined, round(ok/n,6) AS success, round(n_fail/n,6) AS fail_share, CASE
 WHEN n_fail/n < 0.5 THEN round(med,6) END AS median_err FROM s""")
def a41(spark, d):
    r = instant_rows(spark, d).filter("setting = 0")
    err = F.when(F.col("skip") == "", F.abs(F.col("cvx") - F.col("vlx")) + F.abs(F.col("cvy") - F.col("vly")))
    r = r.select("lighting", err.alias("err"), F.when(F.col("n") == 1, 0).otherwise(F.col("n")).alias("n_rec"))
    return outcome_classes(r, ["lighting"]).withColumns({c: r6(c) for c in ("success", "fail_share", "median_err")})


def outcome_classes(rows, keys):
    """Success share (error <= 1 px), failures (no event), undefined; the median counts failures as infinite errors."""
    c = F.when(F.col("err").isNotNull(), "error").when(F.col("n_rec") > 0, "undefined").otherwise("failure")
    r = rows.withColumn("cls", c)
    e = F.when(F.col("cls") == "error", F.col("err")).when(F.col("cls") == "failure", F.lit(1e300))
    s = r.groupBy(*keys).agg(F.count_if(F.col("cls") != "undefined").alias("n"), F.count_if(F.col("cls") == "undefined").alias(
        "n_undefined"), F.count_if(F.col("cls") == "failure").alias("_f"), F.count_if(F.col("err") <= 1).alias("_ok"))
    s = s.join(St.medians(r.withColumn("_m", e), keys, ["_m"]), list(keys), "left")
    fs = C.ratio(F.col("_f").cast("double"), "n")
    return s.select(*keys, "n", "n_undefined", C.ratio(F.col("_ok").cast("double"), "n").alias("success"), fs.alias("fail_share"),
                    F.when(fs < 0.5, F.col("_m")).alias("median_err"))


@query("j17_optional_lookup", f"""WITH {EV}, tau AS (SELECT rec, x, y, p, median(d) AS tau FROM (SELECT rec, x, y, p, t_us - lag(t_us) OVER (PARTITION BY
 rec, w, x, y, p ORDER BY t_us, seq) AS d FROM ev) GROUP BY ALL HAVING median(d) > 0), k AS (SELECT rec, x, y, p, count(*) AS n FROM ev GROUP BY ALL)
 SELECT rec, tau IS NULL AS no_tau, count(*) AS n_pixels, CAST(sum(n) AS BIGINT) AS n FROM k LEFT JOIN tau USING (rec, x, y, p) GROUP BY ALL""")
def j17(spark, d):
    from ..operators import trains as Tr
    ev = events(spark, d)
    tau = Tr.intervals(ev, ("rec", "w")).groupBy("rec", "x", "y", "p").agg(F.median("d").alias("tau")).filter("tau > 0")
    k = ev.groupBy("rec", "x", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    return k.join(tau, ["rec", "x", "y", "p"], "left").groupBy("rec", F.col("tau").isNull().alias("no_tau")).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum("n").alias("n"))


@query("j18_stage_join", f"""WITH {ROWS}, a AS (SELECT rec, track_id, t_e, n, b_px FROM inst_rows WHERE setting = 0 AND skip <> 'support_outside_sensor'),
 b AS (SELECT rec, track_id, t_e, n, b_px FROM inst_rows WHERE setting = 1 AND skip <> 'template_too_small') SELECT count(*) FILTER (b.rec IS NULL) AS
 only_left, count(*) FILTER (a.rec IS NULL) AS only_right, count(*) FILTER (a.rec IS NOT NULL AND b.rec IS NOT NULL) AS common, count(*) FILTER (a.rec
 IS NOT NULL AND b.rec IS NOT NULL AND a.n IS DISTINCT FROM b.n) AS unequal_n, count(*) FILTER (a.rec IS NOT NULL AND b.rec IS NOT NULL AND a.b_px IS
 DISTINCT FROM b.b_px) AS unequal_b_px FROM a FULL JOIN b ON a.rec = b.rec AND a.track_id = b.track_id AND a.t_e = b.t_e""")
def j18(spark, d):
    r = instant_rows(spark, d)
    a = r.filter("setting = 0 AND skip <> 'support_outside_sensor'")
    b = r.filter("setting = 1 AND skip <> 'template_too_small'")
    return St.compare_stages(a, b, ["rec", "track_id", "t_e"], ["n", "b_px"])


@query("t4_representative", f"""WITH {DECOMP}, s AS (SELECT {LIGHT} AS stratum, rec, w, f1 FROM dcm), m AS (SELECT stratum, median(f1) AS med FROM s GROUP BY
 stratum), one AS (SELECT stratum, rec, w, round(f1,6) AS f1, round(med,6) AS median, row_number() OVER (PARTITION BY stratum ORDER BY abs(f1-med), rec,
 w) AS rk FROM s JOIN m USING (stratum)) SELECT stratum, rec, w, f1, median FROM one WHERE rk = 1""")
def t4(spark, d):
    r = decomposition(spark, d).withColumn("stratum", lighting())
    b = St.nearest_to_median(r, ["stratum"], "f1", ["rec", "w"])
    return b.select("stratum", "rec", "w", r6("f1", "f1"), r6("median", "median"))


@query("t4_representative_two_level", f"""WITH {DECOMP}, s AS (SELECT {LIGHT} AS stratum, rec, w, f1, np, nt, m FROM dcm), fr AS (SELECT stratum, rec,
 2.0*sum(m)/sum(np+nt) AS f FROM s GROUP BY ALL), md AS (SELECT stratum, median(f) AS med FROM fr GROUP BY stratum), pick AS (SELECT stratum, rec, f, med,
 row_number() OVER (PARTITION BY stratum ORDER BY abs(f-med), rec) AS rk FROM fr JOIN md USING (stratum)), w2 AS (SELECT s.stratum, s.rec, s.w, s.f1,
 p.f, p.med, row_number() OVER (PARTITION BY s.stratum ORDER BY abs(s.f1-p.f), s.w) AS rk FROM s JOIN pick p ON p.rec = s.rec AND p.rk = 1) SELECT
 stratum, rec, w, round(f1,6) AS f1, round(f,6) AS f_rec, round(med,6) AS median FROM w2 WHERE rk = 1""")
def t4b(spark, d):
    r = decomposition(spark, d).withColumn("stratum", lighting())
    f = r.groupBy("stratum", "rec").agg((F.sum("pairs") * 2.0 / F.sum(F.col("n1") + F.col("n2"))).alias("f_rec"))
    best = St.nearest_to_median(f, ["stratum"], "f_rec", ["rec"])
    c = r.join(best, ["stratum", "rec"])
    w = F.min_by(F.struct("rec", "w", "f1", "f_rec", "median"), F.struct(F.abs(F.col("f1") - F.col("f_rec")), "w"))
    return c.groupBy("stratum").agg(w.alias("b")).select("stratum", "b.rec", "b.w", r6("b.f1", "f1"), r6("b.f_rec", "f_rec"),
                                                         r6("b.median", "median"))
