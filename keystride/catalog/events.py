"""Event detection over `events`: the measure is `value` (or `vn` with gaps) on the match clock."""

from pyspark.sql import functions as F

from ..operators import events as E
from .base import EV, ev, half_s, query, rounded
from .windows import CLS_SQL, cls

KEYS = ["user_id", "period"]
LINE = "(PARTITION BY user_id, period ORDER BY clock_s, event_id)"
COLS = {"clock": "clock", "step": "vn", "acc": "a", "jerk": "j"}
SRC = EV + ", src AS (SELECT *, value - 40 AS a, vn - 30 AS j FROM ev)"
METRICS = [
    "start_time_s", "end_time_s", "start_clock_min", "end_clock_min", "peak_time_s", "peak_clock_min", "sum_speed", "mean_speed", "peak_speed",
    "distance_m", "max_acc", "min_acc", "mean_acc", "mean_abs_acc", "max_jerk", "min_jerk", "mean_jerk", "mean_abs_jerk", "duration_s",
]


def src(spark, d):
    return ev(spark, d).withColumns({"a": F.col("value") - 40, "j": F.col("vn") - 30})


def met(v: str) -> str:
    return f"""round(min(clock_s), 4) AS start_time_s, round(max(clock_s), 4) AS end_time_s, round(min(clock), 4) AS start_clock_min, round(max(clock), 4) AS end_clock_min,
 round(arg_min(clock_s, struct_pack(a := -{v}, b := clock_s)) FILTER (WHERE {v} IS NOT NULL), 4) AS peak_time_s, round(arg_min(clock, struct_pack(a := -{v}, b := clock_s)) FILTER (WHERE {v} IS NOT NULL), 4) AS peak_clock_min,
 round(sum({v}), 5) AS sum_speed, round(avg({v}), 8) AS mean_speed, max({v}) AS peak_speed, round(coalesce(sum(vn), 0), 5) AS distance_m, round(max(a), 4) AS max_acc, round(min(a), 4) AS min_acc,
 round(avg(CASE WHEN a > 0 THEN a END), 8) AS mean_acc, round(avg(abs(a)), 8) AS mean_abs_acc, round(max(j), 4) AS max_jerk, round(min(j), 4) AS min_jerk, round(avg(j), 8) AS mean_jerk, round(avg(abs(j)), 8) AS mean_abs_jerk,
 round(max(clock_s) - min(clock_s), 4) AS duration_s, count({v}) AS n_samples"""


def met_out(df):
    df = rounded(df, *[c for c in METRICS if c.startswith("mean_")], digits=8)
    df = rounded(df, "sum_speed", "distance_m", digits=5)
    return rounded(df, *[c for c in METRICS if c[:4] not in ("mean", "sum_", "dist")], digits=4)


@query("e01_speed_thresholds", f"""
WITH {EV} SELECT user_id, count(vn) AS n, CASE WHEN count(vn) >= 10 THEN round(avg(vn), 8) END AS mu_v, CASE WHEN count(vn) >= 10 THEN round(stddev_pop(vn), 7) END AS sigma_v,
 CASE WHEN count(vn) >= 10 THEN round(avg(vn) + 2.25 * stddev_pop(vn), 7) END AS t_high, CASE WHEN count(vn) >= 10 THEN round(greatest(0, avg(vn) + 0.1 * stddev_pop(vn)), 7) END AS t_low FROM ev GROUP BY user_id""")
def _(spark, d):
    out = E.speed_thresholds(ev(spark, d), ["user_id"], "vn", 2.25, -0.1)
    return rounded(rounded(out, "mu_v", digits=8), "sigma_v", "t_high", "t_low", digits=7)


def thr_sql(kh, kl, v="vn"):
    return f"th AS (SELECT user_id, avg({v}) + {kh} * stddev_pop({v}) AS t_high, greatest(0, avg({v}) - {kl} * stddev_pop({v})) AS t_low FROM src GROUP BY user_id HAVING count({v}) >= 10)"


def hyst_sql(kh, kl, v="vn"):
    """Events by the flag form: rises and falls from both neighbours, falls so far group the rows."""
    return f"""{thr_sql(kh, kl, v)}, h0 AS (SELECT src.*, t_low, t_high FROM src JOIN th USING (user_id) WHERE t_high > t_low),
 h1 AS (SELECT *, lag({v}) OVER {LINE} < t_low AND {v} >= t_low AS up, {v} >= t_low AND lead({v}) OVER {LINE} < t_low AS dn FROM h0),
 h2 AS (SELECT *, coalesce(sum(CASE WHEN dn THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, period ORDER BY clock_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM h1),
 h3 AS (SELECT *, min(CASE WHEN up THEN clock_s END) OVER (PARTITION BY user_id, period, g) AS st, last_value({v}) OVER (PARTITION BY user_id, period, g ORDER BY clock_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastv FROM h2),
 h4 AS (SELECT *, max(CASE WHEN clock_s > st THEN {v} END) OVER (PARTITION BY user_id, period, g) AS top, count(CASE WHEN clock_s >= st THEN {v} END) OVER (PARTITION BY user_id, period, g) AS nn FROM h3),
 hy AS (SELECT * FROM h4 WHERE clock_s >= st AND top >= t_high AND lastv >= t_low AND nn >= 3)"""


def with_thr(spark, d, kh, kl, v="vn"):
    s = src(spark, d)
    return s.join(E.speed_thresholds(s, ["user_id"], v, kh, kl).select("user_id", "t_low", "t_high"), "user_id")


@query("e02_hysteresis_events", f"WITH {SRC}, {hyst_sql(0.6, 0.4)} SELECT user_id, period, {met('vn')} FROM hy GROUP BY user_id, period, g")
def _(spark, d):
    return met_out(E.hysteresis_events(with_thr(spark, d, 0.6, 0.4), half_s(spark, d), "vn", **COLS).drop("t_low", "t_high"))


@query("e03_threshold_events", f"""
WITH {SRC}, a AS (SELECT *, coalesce(vn > 40, false) AS up FROM src), b AS (SELECT *, row_number() OVER {LINE} - row_number() OVER (PARTITION BY user_id, period, up ORDER BY clock_s, event_id) AS g FROM a)
SELECT user_id, period, 40.0::DOUBLE AS t_low, 40.0::DOUBLE AS t_high, {met('vn')} FROM b WHERE up GROUP BY user_id, period, g HAVING count(vn) >= 3""")
def _(spark, d):
    return met_out(E.threshold_events(src(spark, d), half_s(spark, d), "vn", 40.0, **COLS))


@query("e04_event_metrics", f"WITH {SRC} SELECT user_id, event_type, {met('value')} FROM src GROUP BY user_id, event_type")
def _(spark, d):
    return met_out(E.event_metrics(src(spark, d), ["user_id", "event_type"], "clock_s", "value", **COLS))


def merge_sql(gap, atoms="atom"):
    return f"""{atoms} AS (SELECT user_id, period, min(clock_s) AS s0, max(clock_s) AS s1 FROM hy GROUP BY user_id, period, g),
 m1 AS (SELECT *, s0 - lag(s1) OVER (PARTITION BY user_id, period ORDER BY s0) AS gap FROM {atoms}), m2 AS (SELECT *, sum(CASE WHEN gap >= 0 AND gap < {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, period ORDER BY s0) AS c FROM m1),
 m3 AS (SELECT user_id, period, c, min(s0) AS c0, max(s1) AS c1, count(*) AS n_atoms FROM m2 GROUP BY ALL),
 mr AS (SELECT src.*, c, n_atoms FROM src JOIN m3 ON src.user_id = m3.user_id AND src.period = m3.period AND clock_s BETWEEN c0 AND c1)"""


@query("e05_merge_close_events", f"WITH {SRC}, {hyst_sql(0.6, 0.4)}, {merge_sql(120)} SELECT user_id, period, n_atoms, {met('vn')} FROM mr GROUP BY user_id, period, c, n_atoms")
def _(spark, d):
    atoms = E.hysteresis_events(with_thr(spark, d, 0.6, 0.4), half_s(spark, d), "vn", **COLS)
    return met_out(E.merge_close_events(atoms, src(spark, d), half_s(spark, d), "vn", 120.0, **COLS))


INTERVALS = "iv AS (SELECT event_id, user_id, period, clock_s AS s0, clock_s + value / 2 AS s1 FROM ev)"


def intervals(spark, d):
    return ev(spark, d).select("event_id", "user_id", "period", F.col("clock_s").alias("start_time_s"), (F.col("clock_s") + F.col("value") / 2).alias("end_time_s"))


def _gap_sql(keys):
    return f"""WITH {EV}, {INTERVALS}, g AS (SELECT event_id, s0 - lag(s1) OVER (PARTITION BY {keys} ORDER BY s0, s1) AS r FROM iv) SELECT event_id, CASE WHEN r >= 0 THEN round(r, 5) END AS recovery_before_s FROM g"""


@query("e06_recovery_gap", _gap_sql("user_id"))
def _(spark, d):
    out = E.recovery_gaps(intervals(spark, d), ["user_id"], half_s(spark, d).whole)
    return rounded(out.select("event_id", "recovery_before_s"), "recovery_before_s", digits=5)


@query("e07_recovery_gap_by_period", _gap_sql("user_id, period"))
def _(spark, d):
    out = E.recovery_gaps(intervals(spark, d), KEYS, half_s(spark, d).whole)
    return rounded(out.select("event_id", "recovery_before_s"), "recovery_before_s", digits=5)


@query("e08_sprint_table", f"""
WITH {SRC}, {hyst_sql(0.5, -0.1, 'value')}, {merge_sql(120)}, ms AS (SELECT user_id, period, n_atoms, min(clock_s) AS raw0, max(clock_s) AS raw1, {met('value')} FROM mr GROUP BY user_id, period, c, n_atoms),
 rg AS (SELECT *, raw0 - lag(raw1) OVER (PARTITION BY user_id, period ORDER BY raw0) AS rec FROM ms)
SELECT * EXCLUDE (raw0, raw1, rec), CASE WHEN rec >= 0 THEN round(rec, 4) END AS recovery_before_s FROM rg""")
def _(spark, d):
    out = E.sprint_table(src(spark, d), half_s(spark, d), "value", ["user_id"], k_high=0.5, k_low=-0.1, gap=120.0, **COLS)
    return met_out(rounded(out, "recovery_before_s", digits=4))


SEGMENTS = f"""s1 AS (SELECT *, {CLS_SQL} AS cls FROM ev), s2 AS (SELECT *, row_number() OVER {LINE} - row_number() OVER (PARTITION BY user_id, period, cls ORDER BY clock_s, event_id) AS g FROM s1),
 sg AS (SELECT user_id, period, cls, min(clock_s) AS t0, max(clock_s) AS t1, count(*) AS n_frames FROM s2 GROUP BY user_id, period, cls, g)"""


def segs(spark, d):
    return E.label_segments(ev(spark, d).withColumn("cls", cls()), half_s(spark, d), "cls")


@query("e09_label_segments", f"WITH {EV}, {SEGMENTS} SELECT user_id, period, cls, round(t0, 4) AS t0, round(t1, 4) AS t1, n_frames, round(t1 - t0, 4) AS duration FROM sg")
def _(spark, d):
    return rounded(segs(spark, d).drop("segment"), "t0", "t1", "duration", digits=4)


PHASES = f"""{SEGMENTS}, dts AS (SELECT user_id, period, clock_s - lag(clock_s) OVER {LINE} AS dt FROM ev), md AS (SELECT user_id, period, quantile_cont(dt, 0.5) AS med FROM dts GROUP BY ALL),
 ph AS (SELECT sg.user_id, sg.period, cls, t0, t1, greatest(t1 - t0 + CASE WHEN med > 0 THEN med ELSE 0.04 END, CASE WHEN med > 0 THEN med ELSE 0.04 END) AS dur FROM sg JOIN md USING (user_id, period))"""


def phases(spark, d):
    return E.phase_durations(ev(spark, d).withColumn("cls", cls()), half_s(spark, d), "cls")


@query("e10_phase_durations", f"WITH {EV}, {PHASES} SELECT user_id, period, cls, round(t0, 4) AS t0, round(t1, 4) AS t1, round(dur, 4) AS duration_s, round(dur / 60, 6) AS duration_min FROM ph")
def _(spark, d):
    return rounded(rounded(phases(spark, d), "t0", "t1", "duration_s", digits=4), "duration_min")
