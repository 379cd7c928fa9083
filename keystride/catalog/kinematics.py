"""Kinematic operators: position is ``(value, k)``, time is the match clock in seconds."""

from pyspark.sql import functions as F

from ..operators import kinematics as K
from ..operators.ordered import rows_around
from .base import EV, ev, half_s, query, r6, rounded

XY = EV + """, xy AS (SELECT *, value AS x, k::DOUBLE AS y FROM ev)"""
LINE = "(PARTITION BY user_id, period ORDER BY clock_s, event_id)"


def track(spark, d):
    return ev(spark, d).withColumns({"x": F.col("value"), "y": F.col("k").cast("double")})


SEG = XY + f""",
 d1 AS (SELECT *, clock_s - lag(clock_s) OVER {LINE} AS dt FROM xy),
 d2 AS (SELECT *, quantile_cont(dt, 0.5) OVER (PARTITION BY user_id, period) AS med FROM d1),
 seg AS (SELECT *, sum(CASE WHEN med > 0 AND dt > 2.5 * med THEN 1 ELSE 0 END) OVER {LINE} AS segment FROM d2)"""


@query("k01_gap_segments", f"""
WITH {SEG} SELECT user_id, period, segment::BIGINT AS segment, count(*) AS n, round(min(clock_s), 5) AS t0, round(max(clock_s), 5) AS t1, count(*) >= 5 AS long_enough
FROM seg GROUP BY user_id, period, segment""")
def _(spark, d):
    t = K.segments(track(spark, d), half_s(spark, d))
    out = t.groupBy("user_id", "period", "segment").agg(
        F.count("*").alias("n"), F.min("clock_s").alias("t0"), F.max("clock_s").alias("t1"), (F.count("*") >= 5).alias("long_enough")
    )
    return rounded(out, "t0", "t1", digits=5)


@query("k02_strided_differences", f"""
WITH {XY} SELECT event_id, round((lead(x, 2) OVER w - lag(x, 2) OVER w) / 2, 8) AS v,
  round((lead(x, 2) OVER w - 2 * x + lag(x, 2) OVER w), 8) AS a,
  round((lead(x, 4) OVER w - 2 * lead(x, 2) OVER w + 2 * lag(x, 2) OVER w - lag(x, 4) OVER w) / 2, 8) AS j
FROM xy WINDOW w AS {LINE}""")
def _(spark, d):
    def build(part, w):
        return part.withColumns(dict(zip("vaj", K.strided(F.col("x"), F.lit(0.5), 2, w))))

    t = rows_around(track(spark, d), half_s(spark, d), 4, 4, build)
    return rounded(t.select("event_id", "v", "a", "j"), "v", "a", "j", digits=8)


@query("k03_moving_average", f"""
WITH {XY}, t AS (SELECT event_id, avg(vn) OVER f16 AS m16, count(vn) OVER f16 AS n16, avg(vn) OVER f5 AS m5, count(vn) OVER f5 AS n5 FROM xy
 WINDOW f16 AS (PARTITION BY user_id, period ORDER BY clock_s, event_id ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING),
        f5 AS (PARTITION BY user_id, period ORDER BY clock_s, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT event_id, CASE WHEN n16 = 16 THEN round(m16, 8) END AS ma16, CASE WHEN n5 = 5 THEN round(m5, 8) END AS ma5 FROM t""")
def _(spark, d):
    def build(part, w):
        return part.withColumns({"ma16": K.moving_average(F.col("vn"), 16, w), "ma5": K.moving_average(F.col("vn"), 5, w)})

    t = rows_around(track(spark, d), half_s(spark, d), 8, 8, build)
    return rounded(t.select("event_id", "ma16", "ma5"), "ma16", "ma5", digits=8)


def kin_sql(stride: int = 2, ma: int = 4, gap_from: str = SEG) -> str:
    """The kinematic bundle as plain window SQL per (user, period, segment)."""
    w = "(PARTITION BY user_id, period, segment ORDER BY clock_s, event_id)"
    s, lo, hi = stride, ma // 2, ma - ma // 2 - 1
    f = f"(PARTITION BY user_id, period, segment ORDER BY clock_s, event_id ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"

    def d1(c):
        return f"(lead({c}, {s}) OVER {w} - lag({c}, {s}) OVER {w}) / (2 * {s} * h)"

    def d2(c):
        return f"(lead({c}, {s}) OVER {w} - 2 * {c} + lag({c}, {s}) OVER {w}) / ({s} * h * {s} * h)"

    def d3(c):
        return (
            f"(lead({c}, {2 * s}) OVER {w} - 2 * lead({c}, {s}) OVER {w} + 2 * lag({c}, {s}) OVER {w} - lag({c}, {2 * s}) OVER {w})"
            f" / (2 * {s} * h * {s} * h * {s} * h)"
        )

    def mean(c):
        return f"CASE WHEN count({c}) OVER {f} = {ma} THEN avg({c}) OVER {f} END"

    return f"""{gap_from},
 e1 AS (SELECT *, clock_s - lag(clock_s) OVER {w} AS step0, count(*) OVER (PARTITION BY user_id, period, segment) AS sn FROM seg),
 e2 AS (SELECT *, CASE WHEN sn >= {2 * s + 1} THEN quantile_cont(step0, 0.5) OVER (PARTITION BY user_id, period, segment) END AS h0 FROM e1),
 e3 AS (SELECT *, CASE WHEN h0 > 0 THEN h0 END AS h FROM e2),
 e4 AS (SELECT *, {d1('x')} AS vx0, {d1('y')} AS vy0, {d2('x')} AS ax, {d2('y')} AS ay, {d3('x')} AS jx, {d3('y')} AS jy FROM e3),
 e5 AS (SELECT *, sqrt(vx0 * vx0 + vy0 * vy0) AS sp0, sqrt(ax * ax + ay * ay) AS acc, sqrt(jx * jx + jy * jy) AS jerk, {mean('ax')} AS axm, {mean('ay')} AS aym FROM e4),
 e6 AS (SELECT *, {d1('sp0')} AS a_tan, {d1('axm')} AS jxm, {d1('aym')} AS jym, sqrt(axm * axm + aym * aym) AS acc_use FROM e5),
 kin AS (SELECT *, {mean('a_tan')} AS a_tan_use, sqrt(jxm * jxm + jym * jym) AS jerk_use,
   CASE WHEN NOT sp0 > 15 THEN vx0 END AS vx, CASE WHEN NOT sp0 > 15 THEN vy0 END AS vy, CASE WHEN NOT sp0 > 15 THEN sp0 END AS speed FROM e6)"""


KIN_COLS = ["vx", "vy", "speed", "ax", "ay", "acc", "jx", "jy", "jerk", "a_tan", "acc_use", "jerk_use", "a_tan_use"]


def kin(spark, d, **kw):
    return K.stride_kinematics(track(spark, d), half_s(spark, d), stride=2, average=4, **kw)


@query("k04_kinematics", f"WITH {kin_sql()} SELECT event_id, {', '.join(f'round({c}, 7) AS {c}' for c in KIN_COLS)} FROM kin")
def _(spark, d):
    return rounded(kin(spark, d).select("event_id", *KIN_COLS), *KIN_COLS, digits=7)


@query("k05_step_distance", f"""
WITH {XY}, t AS (SELECT event_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, clock_s - lag(clock_s) OVER w AS dt FROM xy WINDOW w AS {LINE})
SELECT event_id, CASE WHEN dt > 0 THEN round(sqrt(dx * dx + dy * dy), 6) END AS step_dist FROM t""")
def _(spark, d):
    return K.step_distance(track(spark, d), half_s(spark, d)).select("event_id", r6(F.col("step_dist")).alias("step_dist"))


@query("k06_simple_speed", f"""
WITH {XY}, t AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / nullif(greatest(clock_s - lag(clock_s) OVER w, 0), 0) AS sp FROM xy WINDOW w AS {LINE}),
 u AS (SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN lead(sp) OVER w ELSE sp END AS sp FROM t WINDOW w AS {LINE})
SELECT event_id, CASE WHEN sp <= 15 THEN round(sp, 6) END AS speed FROM u""")
def _(spark, d):
    return K.simple_speed(track(spark, d), half_s(spark, d)).select("event_id", r6(F.col("speed")).alias("speed"))


@query("k07_time_derivative", f"""
WITH {XY}, t AS (SELECT *, (x - lag(x) OVER w) / nullif(greatest(clock_s - lag(clock_s) OVER w, 0), 0) AS r FROM xy WINDOW w AS {LINE}),
 u AS (SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN CASE WHEN lead(event_id, 2) OVER w IS NOT NULL THEN lead(r) OVER w END ELSE r END AS r FROM t WINDOW w AS {LINE})
SELECT event_id, round(r, 6) AS rate FROM u""")
def _(spark, d):
    return K.time_derivative(track(spark, d), half_s(spark, d), "x", "rate").select("event_id", r6(F.col("rate")).alias("rate"))


@query("k08_sample_interval", f"""
WITH {XY}, t AS (SELECT *, clock_s - lag(clock_s) OVER {LINE} AS dt FROM xy),
 u AS (SELECT user_id, period, count(*) AS n, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS med FROM t GROUP BY ALL)
SELECT user_id, period, n, round(coalesce(med, 1 / 29.97), 6) AS dt, round(CASE WHEN n >= 3 THEN 1 / med ELSE 29.97 END, 8) AS fps,
  round(CASE WHEN n >= 3 THEN 1 / med ELSE 30 END, 8) AS hz FROM u""")
def _(spark, d):
    out = K.sample_interval(track(spark, d), half_s(spark, d)).drop("median_dt")
    return rounded(rounded(out, "dt"), "fps", "hz", digits=8)
