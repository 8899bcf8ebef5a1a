"""DuckDB text of the adapter tables and shared fragments, for the oracles only."""
DAY = "86400000000"


def h(seed, a, b):
    m = 2147483648
    inner = f"((({a}) % {m})*1103515245 + (({b}) % {m})*12345 + CAST({seed} AS BIGINT)*2654435761) % {m}"
    return f"((({inner})*1103515245 + 12345) % {m})"


EV = """ev0 AS (SELECT event_id AS seq, user_id AS "user", event_type,
  epoch_us(ts) - 1704067200000000 AS t_us FROM events),
ev AS (SELECT CASE WHEN ("user" // 30) % 5 < 3 THEN 'day_' ELSE 'night_' END
    || lpad(CAST("user" // 30 AS VARCHAR), 10, '0') AS rec, seq, t_us,
  (("user" % 30)*7 + (("user" % 30)//8)*3 + 2*(t_us // 86400000000)) % 16 AS x, ("user" % 30) % 8 AS y,
  CASE WHEN event_type IN ('click','error') THEN CAST(1 AS BIGINT) ELSE 0 END AS p,
  t_us // 86400000000 AS w, t_us % 86400000000 AS tr, "user" FROM ev0)"""

LABELS = EV + """,
labels_raw AS (SELECT rec, seq, "user" AS track_id, ("user" + p) % 7 AS class_id,
  (t_us // 21600000000)*21600000000 AS t_us,
  CAST(x - 1.0 + ((t_us // 21600000000) % 4)*0.5 AS DOUBLE) AS x, CAST(y - 1.0 AS DOUBLE) AS y,
  CAST(3.0 + seq % 3 AS DOUBLE) AS w, CAST(3.0 + ((t_us // 21600000000) % 5)*0.25 AS DOUBLE) AS h FROM ev)"""

# boxes: duplicate frames keep the first row; tracks: life and majority class (ties to the smallest)
BOXES = LABELS + """,
boxes AS (SELECT rec, track_id, t_us, arg_min(x, seq) AS x, arg_min(y, seq) AS y, arg_min(w, seq) AS w,
  arg_min(h, seq) AS h FROM labels_raw GROUP BY ALL),
cls0 AS (SELECT rec, track_id, class_id, count(*) AS n FROM
   (SELECT rec, track_id, t_us, arg_min(class_id, seq) AS class_id FROM labels_raw GROUP BY ALL) GROUP BY ALL),
cls AS (SELECT rec, track_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY rec, track_id
   ORDER BY n DESC, class_id) AS rn FROM cls0) WHERE rn = 1),
life AS (SELECT rec, track_id, min(t_us) AS t_first, max(t_us) AS t_last, count(*) AS n_frames FROM boxes GROUP BY ALL),
tracks AS (SELECT life.*, class_id FROM life JOIN cls USING (rec, track_id)),
seg AS (SELECT rec, track_id, t_us AS ta, x AS xa, y AS ya, w AS wa, h AS ha,
  lead(t_us) OVER q AS tb, lead(x) OVER q AS xb, lead(y) OVER q AS yb, lead(w) OVER q AS wb, lead(h) OVER q AS hb
  FROM boxes WINDOW q AS (PARTITION BY rec, track_id ORDER BY t_us))"""


def box_at(src, t, seg_alias="g"):
    """Interpolated box columns of an alias over `seg`."""
    g = seg_alias
    f = f"(CASE WHEN {g}.tb IS NULL THEN 0.0 ELSE CAST({t} - {g}.ta AS DOUBLE)/({g}.tb - {g}.ta) END)"
    return ", ".join(f"{g}.{c}a + {f}*(COALESCE({g}.{c}b, {g}.{c}a) - {g}.{c}a) AS b{c}" for c in "xywh")
