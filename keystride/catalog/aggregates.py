"""Summaries over `events` and `orders`."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A, fits, windows as W
from .base import EV, ev, query, rounded, user
from .events import PHASES, SEGMENTS, phases, segs
from .possession import CARRY
from .scalar import POS_SQL, POSITIONS
from .windows import CLS_SQL, CUST_LINE, ORD, REG_SQL, RELATIVE, cls, ord_line, order_gaps, reg_minutes, relative

def code_of():
    return F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), F.col("player") % 12 + 1)


CODE_SQL = POS_SQL.replace("k % 12", "player % 12")


@query("a01_reference_profiles", f"""
WITH {REG_SQL}, c AS (SELECT *, {CODE_SQL} AS code FROM minutes WHERE value IS NOT NULL),
 b AS (SELECT 'detailed' AS level, code AS "group", minute, metric, value FROM c UNION ALL SELECT 'coarse', CASE WHEN code IN ('LB','LCB','RCB','RB') THEN 'Defender' WHEN code IN ('DM','CM','AM') THEN 'Midfielder' ELSE 'Attacker' END, minute, metric, value FROM c WHERE code NOT IN ('GK', 'XX')),
 gg AS (SELECT level, "group", m.i::INT AS minute, t.metric FROM (SELECT DISTINCT level, "group" FROM b), generate_series(1, 90) m(i), (VALUES ('speed'), ('acceleration'), ('distance'), ('jerk')) t(metric))
SELECT gg.level, gg."group", gg.minute, gg.metric, count(value) AS n, round(avg(value), 8) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) END, 6) AS sd FROM gg LEFT JOIN b ON gg.level = b.level AND gg."group" = b."group" AND gg.minute = b.minute AND gg.metric = b.metric GROUP BY ALL""")
def _(spark, d):
    m = reg_minutes(spark, d).withColumn("code", code_of())
    return rounded(rounded(A.reference_profiles(m, "code"), "mean", digits=8), "sd")


@query("a02_roster_inventory", f"""
WITH {EV}, r AS (SELECT user_id, {POS_SQL} AS code FROM ev)
SELECT code, CASE WHEN code IN ('LB','LCB','RCB','RB') THEN 'Defender' WHEN code IN ('DM','CM','AM') THEN 'Midfielder' WHEN code IN ('LW','RW','CF') THEN 'Attacker' END AS coarse, count(*) AS n_roster_rows, count(DISTINCT user_id) AS n_matches FROM r GROUP BY ALL""")
def _(spark, d):
    code = F.lower(F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), F.col("k") % 12 + 1))
    return A.roster_inventory(ev(spark, d).withColumn("pos", code), "pos", "user_id")


@query("a03_value_shares", f"""
WITH {EV} SELECT coalesce(CASE WHEN k % 10 <> 0 THEN event_type END, 'NA') AS label, count(*) AS n_frames, round(100.0 * count(*) / (SELECT count(*) FROM ev), 8) AS pct FROM ev GROUP BY 1""")
def _(spark, d):
    return rounded(A.value_shares(ev(spark, d), F.when(F.col("k") % 10 != 0, F.col("event_type"))), "pct", digits=8)


@query("a04_segment_stats", f"""
WITH {EV}, {SEGMENTS} SELECT cls, count(*) AS n_segments, round(avg(t1 - t0), 6) AS mean_s, round(min(t1 - t0), 6) AS min_s, round(max(t1 - t0), 4) AS max_s, round(sum(t1 - t0), 4) AS total_s, round(quantile_cont(t1 - t0, 0.5), 4) AS median_s FROM sg GROUP BY cls""")
def _(spark, d):
    return rounded(rounded(A.segment_stats(segs(spark, d), "cls"), "mean_s", "min_s"), "max_s", "total_s", "median_s", digits=4)


@query("a05_agreement", f"""
WITH {EV}, {CARRY}, ab AS (SELECT c.team_possession AS a, g.fallback AS b FROM carried c JOIN geo g USING (event_id))
SELECT CASE WHEN grouping(a) = 1 THEN 'All' ELSE a END AS a, CASE WHEN grouping(b) = 1 THEN 'All' ELSE b END AS b, count(*) AS n, round(avg((a = b)::INT), 8) AS agree FROM ab GROUP BY CUBE (a, b)""")
def _(spark, d):
    from ..operators import possession as P
    from .possession import geo

    z = P.carry_possession(P.zone_states(geo(spark, d), 2.5, 2.0), user(spark, d))
    return rounded(A.agreement(z.select(F.col("team_possession").alias("a"), F.col("fallback").alias("b")), "a", "b"), "agree", digits=8)


@query("a06_radius_calibration", f"""
WITH {EV}, t AS (SELECT event_type, vn / 12 AS dd FROM ev WHERE vn IS NOT NULL), c AS (SELECT event_type, count(*) AS n_measured, count(*) FILTER (WHERE dd <= 8) AS n_core, avg(dd) AS mean, quantile_cont(dd, 0.5) AS median, quantile_cont(dd, 0.75) AS p75, quantile_cont(dd, 0.9) AS p90, quantile_cont(dd, 0.95) AS p95,
  quantile_cont(CASE WHEN dd <= 8 THEN dd END, 0.95) AS core_p95 FROM t GROUP BY ALL)
SELECT event_type, n_measured, n_core, round(mean, 8) AS mean, round(median, 7) AS median, round(p75, 7) AS p75, round(p90, 7) AS p90, round(p95, 7) AS p95, round(core_p95, 7) AS core_p95, round(CASE WHEN n_core >= 30 THEN core_p95 ELSE p95 END, 7) AS rpz_raw,
 round(greatest(1, least(3.5, CASE WHEN n_core >= 30 THEN core_p95 ELSE p95 END)), 7) AS rpz FROM c""")
def _(spark, d):
    out = A.radius_calibration(ev(spark, d).withColumn("dd", F.col("vn") / 12), ["event_type"], "dd")
    return rounded(rounded(out, "mean", digits=8), "median", "p75", "p90", "p95", "core_p95", "rpz_raw", "rpz", digits=7)


@query("a06_radius_calibration_pooled", f"""
WITH {EV}, t AS (SELECT value / 60 AS dd FROM ev), c AS (SELECT count(*) AS n_measured, count(*) FILTER (WHERE dd <= 8) AS n_core, avg(dd) AS mean, quantile_cont(dd, 0.5) AS median, quantile_cont(dd, 0.75) AS p75, quantile_cont(dd, 0.9) AS p90, quantile_cont(dd, 0.95) AS p95, quantile_cont(CASE WHEN dd <= 8 THEN dd END, 0.95) AS core_p95 FROM t)
SELECT n_measured, n_core, round(mean, 8) AS mean, round(median, 7) AS median, round(p75, 7) AS p75, round(p90, 7) AS p90, round(p95, 7) AS p95, round(core_p95, 7) AS core_p95, round(core_p95, 7) AS rpz_raw, round(greatest(1, least(3.5, core_p95)), 7) AS rpz FROM c""")
def _(spark, d):
    out = A.radius_calibration(ev(spark, d).withColumn("dd", F.col("value") / 60), [], "dd")
    return rounded(rounded(out, "mean", digits=8), "median", "p75", "p90", "p95", "core_p95", "rpz_raw", "rpz", digits=7)


@query("a07_speed_profile", f"""
WITH {EV}, t AS (SELECT user_id % 3 AS grp, vn / 50 AS sp, k - 50.0::DOUBLE AS acc FROM ev WHERE vn / 50 > 0.2), b AS (SELECT *, ceil(sp / 0.2) AS bin FROM t)
SELECT grp, count(*) AS n, round(avg(acc), 8) AS mean, round(quantile_cont(acc, 0.9), 7) AS p90, round(quantile_cont(acc, 0.1), 7) AS p10, quantile_cont(acc, 0.5) AS median, round((bin - 0.5) * 0.2, 6) AS centre FROM b GROUP BY grp, bin HAVING count(*) >= 15""")
def _(spark, d):
    t = ev(spark, d).select((F.col("user_id") % 3).alias("grp"), (F.col("vn") / 50).alias("sp"), (F.col("k") - 50.0).alias("acc"))
    out = A.speed_profile(t, ["grp"], "sp", "acc")
    return rounded(rounded(rounded(out, "mean", digits=8), "p90", "p10", digits=7), "centre")


NICE = """w1 AS (SELECT {k} count(*) AS n, min(dur) AS lo, max(dur) AS hi, quantile_cont(dur, 0.75) - quantile_cont(dur, 0.25) AS iqr FROM ph WHERE dur > 0 {g}),
 w2 AS (SELECT *, (hi - lo) / ceil((hi - lo) / (2 * iqr / cbrt(n))) AS raw FROM w1),
 w3 AS (SELECT {k} n, c.w, row_number() OVER ({p} ORDER BY abs(c.w - raw), c.w) AS r FROM w2, (VALUES (0.5::DOUBLE), (1), (2), (5), (10), (15), (20), (30), (45), (60), (90), (120), (180), (300)) c(w)),
 nice AS (SELECT {k} n, w AS width FROM w3 WHERE r = 1)"""


@query("a08_nice_bin_width", f"WITH {EV}, {PHASES}, {NICE.format(k='cls,', g='GROUP BY cls', p='PARTITION BY cls')} SELECT cls, n, width FROM nice")
def _(spark, d):
    return A.nice_bin_width(phases(spark, d), ["cls"], "duration_s")


@query("a09_duration_histogram", f"WITH {EV}, {PHASES}, {NICE.format(k='', g='', p='')}, md2 AS (SELECT cls, quantile_cont(dur, 0.5) AS median_s FROM ph GROUP BY cls) SELECT cls, floor(dur / width)::BIGINT AS bin, width, count(*) AS n, round(any_value(median_s), 4) AS median_s FROM ph JOIN md2 USING (cls), (SELECT width FROM nice) GROUP BY cls, floor(dur / width), width")
def _(spark, d):
    return rounded(A.duration_histogram(phases(spark, d), "cls", "duration_s"), "median_s", digits=4)


def _sweep_sql():
    parts = []
    for n, least, span in fits.SETTINGS:
        f = f"(PARTITION BY o_custkey, period ORDER BY day, o_orderkey ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for y, sy in (("y", 420000.0), ("y2", 3.0)):
            parts.append(f"SELECT o_custkey, period, day, o_orderkey, {n} AS n_window, {least} AS min_n, {span} AS min_x_s, '{y}' AS y_metric, CASE WHEN count(*) OVER {f} >= {least} AND max(x) OVER {f} - min(x) OVER {f} >= {span} THEN regr_slope({y}, x) OVER {f} END * 400.0 / {sy} AS bs FROM us")
    case = "o_custkey, n_window, min_n, min_x_s, y_metric"
    return f"""WITH {ORD}, us AS (SELECT *, (o_orderkey % 5)::DOUBLE AS y2 FROM rec WHERE x > 0), al AS ({' UNION ALL '.join(parts)}),
 an AS (SELECT *, (atan(bs) + pi() / 2) / pi() AS a, degrees(atan(bs)) AS th FROM al), tot AS (SELECT {case}, count(*) AS n_usable FROM an GROUP BY ALL),
 fi AS (SELECT *, a - lag(a) OVER (PARTITION BY {case}, period ORDER BY day, o_orderkey) AS st, lag(a) OVER (PARTITION BY {case} ORDER BY day, o_orderkey) AS pa FROM an WHERE a IS NOT NULL),
 sm AS (SELECT {case}, count(*) AS n_fit, round(min(a), 6) AS min_A, round(max(a), 6) AS max_A, round(avg(abs(st)), 6) AS mean_abs_step_A, count(*) FILTER (WHERE sign(round(a - 0.5, 9)) <> sign(round(pa - 0.5, 9))) AS n_cross_half, round(quantile_cont(a, 0.5), 6) AS median_A, round(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 6) AS iqr_A, round(quantile_cont(th, 0.5), 5) AS median_theta_star_deg FROM fi GROUP BY ALL)
SELECT tot.o_custkey, tot.n_window, tot.min_n, tot.min_x_s::DOUBLE AS min_x_s, tot.y_metric, n_usable, coalesce(n_fit, 0) AS n_fit, min_A, max_A, mean_abs_step_A, coalesce(n_cross_half, 0) AS n_cross_half, median_A, iqr_A, median_theta_star_deg FROM tot LEFT JOIN sm ON tot.o_custkey = sm.o_custkey AND tot.n_window = sm.n_window AND tot.min_n = sm.min_n AND tot.min_x_s = sm.min_x_s AND tot.y_metric = sm.y_metric"""


@query("a10_setting_sweep", _sweep_sql())
def _(spark, d):
    g = order_gaps(spark, d).withColumn("y2", (F.col("o_orderkey") % 5).cast("double"))
    line = ord_line(spark, d)
    out = fits.setting_table(g, line, CUST_LINE.bounded() if line.whole else CUST_LINE, "x", {"y": 420000.0, "y2": 3.0}, 400.0, fits.SETTINGS)
    return rounded(rounded(out, "min_A", "max_A", "mean_abs_step_A", "median_A", "iqr_A"), "median_theta_star_deg", digits=5)


@query("a11_exemplars", f"""
WITH {EV}, s AS (SELECT user_id, event_id, k / 99.0 AS score FROM ev WHERE k % 7 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, event_id, round(score, 6) AS score FROM r WHERE n <= 3 OR rn IN (1, n // 2 + 1, n)""")
def _(spark, d):
    s = ev(spark, d).select("user_id", "event_id", F.when(F.col("k") % 7 != 0, F.col("k") / 99.0).alias("score"))
    return rounded(fits.exemplars(s, ["user_id"], "score", "event_id"), "score")


@query("a12_half_ends", f"""
WITH {RELATIVE} SELECT user_id, half, round(arg_max(phi_5a, minute) FILTER (WHERE phi_5a IS NOT NULL), 6) AS phi_5a_end, round(arg_max(phi_roll10, minute) FILTER (WHERE phi_roll10 IS NOT NULL), 6) AS phi_roll10_end, round(arg_max(sum_z, minute) FILTER (WHERE sum_z IS NOT NULL), 5) AS sum_z_end FROM rs GROUP BY ALL""")
def _(spark, d):
    out = fits.half_ends(relative(spark, d), ["user_id"])
    return rounded(rounded(out, "phi_5a_end", "phi_roll10_end"), "sum_z_end", digits=5)


@query("a13_batch_summary", f"""
WITH {RELATIVE} SELECT user_id, round(avg(CASE WHEN minute <= 45 THEN phi_roll10 END), 6) AS phi_p1_mean, round(max(CASE WHEN minute = 45 THEN phi_roll10 END), 6) AS phi_p1_end, round(arg_min(coalesce(phi_roll10, -1), minute), 6) AS phi_start0,
 round(avg(CASE WHEN minute > 45 THEN phi_roll10 END), 6) AS phi_p2_mean, count(*) FILTER (WHERE minute <= 45 AND phi_roll10 > 0.5) AS n_above_half_p1 FROM rs GROUP BY ALL""")
def _(spark, d):
    s = relative(spark, d)
    out = fits.batch_summary(s, ["user_id"])
    return rounded(out.withColumn("phi_start0", F.coalesce("phi_start", F.lit(-1.0))).drop("phi_start"), "phi_p1_mean", "phi_p1_end", "phi_start0", "phi_p2_mean")


@query("a14_phase_delta", f"""
WITH {EV}, t AS (SELECT period, k % 4 AS grp, CASE WHEN (period = 1 AND clock < 15) OR (period = 2 AND clock < 60) THEN 'early' WHEN (period = 1 AND clock < 30) OR (period = 2 AND clock < 75) THEN 'middle' ELSE 'late' END AS phase, vn, value - k AS r FROM ev)
SELECT period, grp, round(quantile_cont(CASE WHEN phase = 'late' THEN vn END, 0.5) - quantile_cont(CASE WHEN phase = 'early' THEN vn END, 0.5), 6) AS delta_vn, round(quantile_cont(CASE WHEN phase = 'late' THEN r END, 0.5) - quantile_cont(CASE WHEN phase = 'early' THEN r END, 0.5), 6) AS delta_r FROM t GROUP BY ALL""")
def _(spark, d):
    t = ev(spark, d).withColumns({"phase": S.match_phase(F.col("period"), F.col("clock")), "grp": F.col("k") % 4, "r": F.col("value") - F.col("k")})
    return rounded(A.phase_delta(t, ["period", "grp"], "phase", ["vn", "r"]), "delta_vn", "delta_r")


@query("a15_clip_report", f"WITH {EV} SELECT period, count(vn) AS n, count(*) FILTER (WHERE vn - 50 > 40) AS n_hi, count(*) FILTER (WHERE vn - 50 < -40) AS n_lo FROM ev GROUP BY period")
def _(spark, d):
    return A.clip_report(ev(spark, d).withColumn("q", F.col("vn") - 50), ["period"], "q", 40.0)


@query("a16_pooled_scales", f"WITH {ORD} SELECT 'x' AS scale_of, round(quantile_cont(x, 0.9), 6) AS scale FROM rec UNION ALL SELECT 'y', round(quantile_cont(y, 0.9), 6) FROM rec")
def _(spark, d):
    return rounded(fits.pooled_scales(order_gaps(spark, d), ["x", "y"]), "scale")


@query("a17_half_totals", f"WITH {EV} SELECT user_id, period, count(*) AS n, count(*) FILTER (WHERE k >= 40) AS n_ok, round(100.0 * count(*) FILTER (WHERE k >= 40) / count(*), 8) AS overall_pct FROM ev GROUP BY ALL")
def _(spark, d):
    return rounded(A.half_totals(ev(spark, d).withColumn("ok", F.col("k") >= 40), ["user_id", "period"], "ok"), "overall_pct", digits=8)


@query("a18_class_averages", f"""
WITH {EV}, c AS (SELECT *, {CLS_SQL} AS cls FROM ev) SELECT user_id, period, round(avg(CASE WHEN cls = 'IN_POSSESSION' THEN vn END), 8) AS in_avg, round(avg(CASE WHEN cls = 'OUT_OF_POSSESSION' THEN vn END), 8) AS out_avg,
 round(100.0 * count(*) FILTER (WHERE cls = 'IN_POSSESSION') / count(*), 8) AS in_pct, round(100.0 * count(*) FILTER (WHERE cls = 'OUT_OF_POSSESSION') / count(*), 8) AS out_pct FROM c GROUP BY ALL""")
def _(spark, d):
    out = W.class_averages(ev(spark, d).withColumn("cls", cls()), ["user_id", "period"], "cls", "vn")
    return rounded(out, "in_avg", "out_avg", "in_pct", "out_pct", digits=8)
