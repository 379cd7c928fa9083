"""Windows, bins and rolling statistics over `events` (one user is one player-match)."""

from pyspark.sql import functions as F

from ..functions import codes, scalar as S
from ..operators import fits, windows as W
from ..operators.ordered import Line, neighbour
from .base import EV, W_HALF, chosen, ev, half, half_s, query, r6, r8, rounded, table
from .scalar import TEAM_OF

CLS_SQL = "CASE WHEN event_type IN ('view', 'click') THEN 'IN_POSSESSION' WHEN event_type = 'purchase' THEN 'OUT_OF_POSSESSION' ELSE 'DEAD_OR_UNRESOLVED' END"


def cls():
    """Possession class of an event type."""
    return S.collapse_team(codes.lookup(F.col("event_type"), TEAM_OF))


def grid_sql(keys: str, src: str, time: str, win: str, step: str, more: str = "") -> str:
    """All sliding windows (w) and the rows in each (inw), written as a plain range join."""
    on = " AND ".join(f"e.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    return f"""span AS (SELECT {keys}, floor(min({time})) AS lo, max({time}) AS hi FROM {src} GROUP BY ALL),
 w AS (SELECT {keys}, lo + i * {step} AS t0 FROM span, generate_series(0, 200) AS g(i) WHERE lo + i * {step} < hi - {win} + 1e-9),
 inw AS (SELECT e.*, w.t0 FROM w JOIN {src} e ON {on} AND e.{time} >= w.t0 AND e.{time} < w.t0 + {win})"""


G = grid_sql("user_id, period", "ev", "clock", "3.0::DOUBLE", "2.0::DOUBLE")
KEYS = ["user_id", "period"]


@query("w01_window_grid", f"""
WITH {EV}, {G} SELECT user_id, period, t0, count(*) AS n FROM inw GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, d):
    t = W.window_aggregate(ev(spark, d), KEYS, "clock", {}, min_frames=2)
    return t.select(*KEYS, "t0", F.col("n_frames").alias("n"))


@query("w02_rolling_peaks", f"""
WITH {EV}, {G} SELECT user_id, period, t0 + 1.5 AS t_centre, max(value) AS max_value, max(vn) AS max_vn, max(k) AS max_k FROM inw GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, d):
    return W.rolling_peaks(ev(spark, d), KEYS, "clock", ["value", "vn", "k"], min_frames=2)


@query("w03_rolling_distance", f"""
WITH {EV}, {G} SELECT user_id, period, t0 + 1.5 AS t_centre, round(coalesce(sum(vn), 0), 6) AS window_distance FROM inw GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, d):
    return rounded(W.rolling_distance(ev(spark, d), KEYS, "clock", "vn", min_frames=2), "window_distance")


@query("w04_majority_label", f"""
WITH {EV}, c AS (SELECT DISTINCT user_id, period, floor(clock) + 0.5::DOUBLE AS tc FROM ev),
 n AS (SELECT c.user_id, c.period, c.tc, count(*) FILTER (WHERE cls = 'IN_POSSESSION') AS a, count(*) FILTER (WHERE cls = 'OUT_OF_POSSESSION') AS b, count(*) FILTER (WHERE cls = 'DEAD_OR_UNRESOLVED') AS z
   FROM c LEFT JOIN (SELECT *, {CLS_SQL} AS cls FROM ev) e ON c.user_id = e.user_id AND c.period = e.period AND e.clock >= c.tc - 2.0 AND e.clock < c.tc + 2.0 GROUP BY ALL)
SELECT user_id, period, tc, CASE WHEN a > 0 AND a >= b AND a >= z THEN 'IN_POSSESSION' WHEN b > 0 AND b >= a AND b >= z THEN 'OUT_OF_POSSESSION' ELSE 'DEAD_OR_UNRESOLVED' END AS poss_class FROM n""")
def _(spark, d):
    e = ev(spark, d).withColumn("cls", cls())
    # window centres are whole half-minutes, so a row meets a fixed number of them
    centres = e.select(*KEYS, (F.floor("clock") + 0.5).alias("tc")).distinct()
    return W.majority_label(centres, e, KEYS, "tc", "clock", "cls", 4.0)


PROP = f"""cl AS (SELECT *, {CLS_SQL} AS cls FROM ev)"""


@query("w05_label_proportions", f"""
WITH {EV}, {PROP}, {grid_sql("user_id, period", "cl", "clock", "3.0::DOUBLE", "2.0::DOUBLE")},
 p AS (SELECT user_id, period, t0, count(*) AS n_frames, avg((cls = 'IN_POSSESSION')::INT) AS p_ip, avg((cls = 'OUT_OF_POSSESSION')::INT) AS p_oop, avg((cls = 'DEAD_OR_UNRESOLVED')::INT) AS p_dead FROM inw GROUP BY ALL HAVING count(*) >= 2)
SELECT user_id, period, t0, n_frames, round(p_ip, 8) AS p_ip, round(p_oop, 8) AS p_oop, round(p_dead, 8) AS p_dead, round(greatest(p_ip, p_oop, p_dead), 8) AS p_max,
 CASE WHEN p_ip >= p_oop AND p_ip >= p_dead THEN 'IN_POSSESSION' WHEN p_oop >= p_ip AND p_oop >= p_dead THEN 'OUT_OF_POSSESSION' ELSE 'DEAD_OR_UNRESOLVED' END AS poss_class FROM p""")
def _(spark, d):
    out = W.label_proportions(ev(spark, d).withColumn("cls", cls()), KEYS, "clock", "cls", min_frames=2)
    return rounded(out, "p_ip", "p_oop", "p_dead", "p_max", digits=8)


def _sweep_sql():
    parts = []
    for w in ("2.0", "4.0", "8.0"):
        g = grid_sql("user_id, period", "cl", "clock", f"{w}::DOUBLE", "1.0::DOUBLE")
        parts.append(f"""(WITH {g} SELECT {w}::DOUBLE AS win_min, user_id, period, t0, avg((cls = 'IN_POSSESSION')::INT) AS p_ip, avg((cls = 'OUT_OF_POSSESSION')::INT) AS p_oop, avg((cls = 'DEAD_OR_UNRESOLVED')::INT) AS p_dead FROM inw GROUP BY ALL HAVING count(*) >= 2)""")
    frac = []
    for th in (50, 60, 70):
        c = f"pm >= {th / 100}"
        frac.append(f"round(avg(({c})::INT), 8) AS frac_pmax_ge_{th}, round(avg(CASE WHEN {c} THEN (maj = 1)::INT END), 8) AS frac_clean_ip_{th}, round(avg(CASE WHEN {c} THEN (maj = 2)::INT END), 8) AS frac_clean_oop_{th}, round(avg((NOT {c})::INT), 8) AS frac_mixed_{th}")
    return f"""WITH {EV}, {PROP}, p AS ({' UNION ALL '.join(parts)}),
 q AS (SELECT *, greatest(p_ip, p_oop, p_dead) AS pm, CASE WHEN p_ip >= p_oop AND p_ip >= p_dead THEN 1 WHEN p_oop >= p_dead THEN 2 ELSE 3 END AS maj FROM p)
SELECT win_min, count(*) AS n_windows, round(avg(pm), 8) AS p_max_mean, round(avg(p_ip), 8) AS mean_p_ip, round(avg(p_oop), 8) AS mean_p_oop, round(avg(p_dead), 8) AS mean_p_dead,
 {', '.join(frac)}, round(quantile_cont(pm, 0.25), 8) AS p_max_p25, round(quantile_cont(pm, 0.5), 8) AS p_max_median, round(quantile_cont(pm, 0.75), 8) AS p_max_p75 FROM q GROUP BY win_min"""


@query("w06_window_length_sweep", _sweep_sql())
def _(spark, d):
    out = W.window_length_sweep(ev(spark, d).withColumn("cls", cls()), KEYS, "clock", "cls", wins=(2.0, 4.0, 8.0), step=1.0, min_frames=2)
    return rounded(out, *[c for c in out.columns if c not in ("win_min", "n_windows")], digits=8)


# peers: a match is one (event_type, period), the players are its users, two teams by user parity
PEER = EV + """, pe AS (SELECT event_type, period, user_id, user_id % 2 AS team, clock, round(value * 100) AS speed, k AS acc_use, round(vn * 100) AS jerk_use, round(vn * 100) AS step_dist FROM ev)"""


def peers(spark, d):
    e = ev(spark, d).select(
        "event_type", "period", "user_id", (F.col("user_id") % 2).alias("team"), "clock",
        F.round(F.col("value") * 100).alias("speed"), F.col("k").alias("acc_use"),
        F.round(F.col("vn") * 100).alias("jerk_use"), F.round(F.col("vn") * 100).alias("step_dist"),
    )
    return W.peer_percentiles(e, ["event_type", "period"], "user_id", "team", "clock", 12.0, 6.0, 2)


PEER_SQL = f"""{PEER}, {grid_sql("event_type, period", "pe", "clock", "12.0::DOUBLE", "6.0::DOUBLE")},
 a AS (SELECT event_type, period, t0, user_id, team, avg(speed) AS mean_speed, avg(acc_use) AS mean_acc, avg(jerk_use) AS mean_jerk, coalesce(sum(step_dist), 0) AS total_distance FROM inw GROUP BY ALL HAVING count(*) >= 2),
 pr AS (SELECT x.event_type, x.period, x.user_id, x.team, x.t0 + 6.0 AS t_centre, count(*) FILTER (WHERE y.team = x.team) AS n_team, count(*) AS n_all,
  {', '.join(f"CASE WHEN x.{m} IS NOT NULL THEN round(100.0 * count(*) FILTER (WHERE y.{m} <= x.{m} AND y.team = x.team) / nullif(count(y.{m}) FILTER (WHERE y.team = x.team), 0), 6) END AS {m}_team_pct, CASE WHEN x.{m} IS NOT NULL THEN round(100.0 * count(*) FILTER (WHERE y.{m} <= x.{m}) / nullif(count(y.{m}), 0), 6) END AS {m}_all_pct" for m in ('mean_speed', 'mean_acc', 'mean_jerk', 'total_distance'))}
  FROM a x JOIN a y ON x.event_type = y.event_type AND x.period = y.period AND x.t0 = y.t0 GROUP BY x.event_type, x.period, x.user_id, x.team, x.t0, x.mean_speed, x.mean_acc, x.mean_jerk, x.total_distance)"""


@query("w07_peer_percentiles", f"WITH {PEER_SQL} SELECT * FROM pr")
def _(spark, d):
    out = peers(spark, d)
    return rounded(out, *[c for c in out.columns if c.endswith("_pct")])


@query("w07_presence_diagnostics", f"""
WITH {PEER_SQL} SELECT event_type, n_team, n_all, count(*) AS n_windows, n_team < 10 AS short_team, n_all < 20 AS short_all FROM pr GROUP BY ALL""")
def _(spark, d):
    return W.presence_diagnostics(peers(spark, d), ["event_type"])


@query("w07_presence_by_player", f"""
WITH {PEER_SQL}, wa AS (SELECT event_type, period, count(DISTINCT t_centre) AS na FROM pr GROUP BY ALL),
 ow AS (SELECT event_type, period, user_id, count(*) AS n, count(*) FILTER (WHERE n_team < 10) AS st, count(*) FILTER (WHERE n_all < 20) AS sa FROM pr GROUP BY ALL)
SELECT p.event_type, p.period, p.user_id, coalesce(n, 0) AS n_windows, coalesce(na, 0) - coalesce(n, 0) AS focal_missing, coalesce(st, 0) AS short_team, coalesce(sa, 0) AS short_all
FROM (SELECT DISTINCT event_type, period, user_id FROM ev) p LEFT JOIN wa USING (event_type, period) LEFT JOIN ow USING (event_type, period, user_id)""")
def _(spark, d):
    return W.presence_by_player(peers(spark, d), ev(spark, d), ["event_type", "period"], "user_id")


@query("w08_second_bins", f"""
WITH {EV} SELECT user_id, period, floor(clock_s / 30)::BIGINT AS time_bin, round(avg(clock_s), 3) AS clock_s, round(avg(value), 8) AS speed, round(avg(k), 8) AS acc_use, round(avg(vn), 8) AS jerk_use,
  round(coalesce(sum(vn), 0), 6) AS distance_1s, count(value) AS n_frames FROM ev GROUP BY user_id, period, floor(clock_s / 30)""")
def _(spark, d):
    e = ev(spark, d).withColumns({"speed": F.col("value"), "acc_use": F.col("k"), "jerk_use": F.col("vn"), "step_dist": F.col("vn")})
    out = W.second_bins(e, KEYS, "clock_s", 30.0)
    return rounded(rounded(rounded(out, "speed", "acc_use", "jerk_use", digits=8), "distance_1s"), "clock_s", digits=3)


@query("w09_sliding_histogram", f"""
WITH {EV}, h AS (SELECT event_type, clock, vn FROM ev WHERE vn IS NOT NULL), span AS (SELECT event_type, min(clock) AS lo, max(clock) AS hi FROM h GROUP BY ALL),
 w AS (SELECT event_type, lo + i * 6.0::DOUBLE AS t0 FROM span, generate_series(0, 100) g(i) WHERE lo + i * 6.0 < hi - 9.0 + 6.0),
 b AS (SELECT *, bin * 10.0 AS b0, (bin + 1) * 10.0 AS b1 FROM w, generate_series(0, 19) g2(bin))
SELECT b.event_type, round(t0 + 4.5, 6) AS t_centre, b.bin::INT AS bin, count(vn) AS n FROM b LEFT JOIN h ON h.event_type = b.event_type AND clock >= t0 AND clock < t0 + 9.0
  AND vn >= b0 AND (vn < b1 OR (b.bin = 19 AND vn <= b1)) GROUP BY ALL""")
def _(spark, d):
    out = W.sliding_histogram(ev(spark, d), ["event_type"], "clock", "vn", 200.0, 20, 9.0, 6.0)
    return rounded(out, "t_centre")


FP = EV + """, fp AS (SELECT *, value AS speed, vn - 30 AS jerk_use, value - 40 AS a_tan_use, vn AS step_dist FROM ev)"""


def fp(spark, d):
    return ev(spark, d).withColumns(
        {"speed": F.col("value"), "jerk_use": F.col("vn") - 30, "a_tan_use": F.col("value") - 40, "step_dist": F.col("vn")}
    )


@query("w10_fingerprint", f"""
WITH {FP}, g AS (SELECT user_id, period, clock_s - lag(clock_s) OVER (PARTITION BY user_id, period ORDER BY clock_s, event_id) AS dt FROM fp),
 s AS (SELECT user_id, period, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS med, count(*) AS n FROM g GROUP BY ALL),
 e AS (SELECT user_id, period, min(clock_s) AS lo, max(clock_s) AS hi FROM fp GROUP BY ALL),
 q AS (SELECT e.*, greatest(3, floor(0.8 * 240 * CASE WHEN n >= 3 THEN 1 / med ELSE 30 END)) AS need FROM e JOIN s USING (user_id, period)),
 w AS (SELECT *, lo + i * 240.0::DOUBLE AS s0 FROM q, generate_series(0, 40) g(i) WHERE lo + i * 240.0 < hi - 240 + 1e-9)
SELECT w.user_id, w.period, round(s0 + 120, 6) AS t_s, round(avg(abs(jerk_use)), 8) AS jerk, round(avg(greatest(a_tan_use, 0)), 8) AS acc, round(avg(speed), 8) AS speed, round(sum(step_dist), 6) AS distance, count(*) AS n_frames
FROM w JOIN fp ON fp.user_id = w.user_id AND fp.period = w.period AND clock_s >= s0 AND clock_s < s0 + 240 GROUP BY w.user_id, w.period, s0, need HAVING count(*) >= need""")
def _(spark, d):
    out = W.fingerprint(fp(spark, d), half_s(spark, d), 240.0)
    return rounded(rounded(out, "jerk", "acc", "speed", digits=8), "t_s", "distance")


@query("w10_fingerprint_frames", f"""
WITH {FP} SELECT user_id, period, round(clock_s, 3) AS t_s, round(abs(jerk_use), 6) AS jerk, round(greatest(a_tan_use, 0), 6) AS acc, speed, step_dist AS distance, 1::BIGINT AS n_frames FROM fp""")
def _(spark, d):
    return rounded(rounded(W.fingerprint(fp(spark, d), half_s(spark, d), None), "jerk", "acc"), "t_s", digits=3)


REGMIN = EV + """, rm AS (SELECT k % 20 AS player, event_id, period, clock_s, value AS speed, vn AS acc_use, CASE WHEN k % 3 = 0 THEN NULL ELSE value END AS jerk_use, vn AS step_dist FROM ev)"""
REG_LINE = Line(("player",), "clock_s", ("event_id",))
REG_SQL = f"""{REGMIN}, dts AS (SELECT player, clock_s - lag(clock_s) OVER (PARTITION BY player ORDER BY clock_s, event_id) AS dt FROM rm),
 need AS (SELECT player, greatest(3, floor(0.7 * greatest(1, 60 / coalesce(quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5), 1 / 30.0)))) AS need FROM dts GROUP BY ALL),
 a AS (SELECT player, floor(clock_s / 60)::INT + 1 AS minute, count(*) AS n, avg(speed) AS sp, count(speed) AS nsp, avg(acc_use) AS ac, count(acc_use) AS nac, avg(jerk_use) AS jk, count(jerk_use) AS njk, sum(step_dist) AS di
   FROM rm WHERE (period = 1 AND clock_s < 2700) OR (period = 2 AND clock_s >= 2700 AND clock_s < 5400) GROUP BY ALL),
 g AS (SELECT player, need, i::INT AS minute FROM need, generate_series(1, 90) s(i)),
 j AS (SELECT g.player, g.minute, need, n, sp, nsp, ac, nac, jk, njk, di FROM g LEFT JOIN a ON g.player = a.player AND g.minute = a.minute),
 minutes AS (SELECT player, minute, 'speed' AS metric, CASE WHEN n >= need AND nsp >= need THEN sp END AS value FROM j
  UNION ALL SELECT player, minute, 'acceleration', CASE WHEN n >= need AND nac >= need THEN ac END FROM j
  UNION ALL SELECT player, minute, 'distance', CASE WHEN n >= need THEN di END FROM j
  UNION ALL SELECT player, minute, 'jerk', CASE WHEN n >= need AND njk >= need THEN jk END FROM j)"""


def reg_minutes(spark, d):
    k = F.col("k")
    e = ev(spark, d).withColumns(
        {"player": k % 20, "speed": F.col("value"), "acc_use": F.col("vn"), "jerk_use": F.when(k % 3 != 0, F.col("value")), "step_dist": F.col("vn")}
    )
    return W.regulation_minutes(e, chosen(spark, REG_LINE))


@query("w11_regulation_minutes", f"WITH {REG_SQL} SELECT player, minute, metric, round(value, 6) AS value FROM minutes")
def _(spark, d):
    return rounded(reg_minutes(spark, d), "value")


@query("w13_hop_success", f"""
WITH {EV}, ends AS (SELECT user_id, period, max(clock) AS hi, CASE period WHEN 1 THEN 0.0::DOUBLE ELSE 45.0::DOUBLE END AS s0 FROM ev GROUP BY ALL),
 g AS (SELECT user_id, period, s0 + i AS ws FROM ends, generate_series(0, 60) s(i) WHERE s0 + i < hi + 1e-9)
SELECT g.user_id, g.period, ws + 2.5 AS t_min, ws AS window_start_min, ws + 5 AS window_end_min, count(e.event_id) AS n,
  round(CASE WHEN count(e.event_id) >= 2 THEN count(*) FILTER (WHERE e.k >= 40) / count(e.event_id) END, 8) AS P
FROM g LEFT JOIN ev e ON e.user_id = g.user_id AND e.period = g.period AND e.clock >= ws AND e.clock < ws + 5 GROUP BY g.user_id, g.period, ws""")
def _(spark, d):
    e = ev(spark, d).withColumn("ok", F.col("k") >= 40)
    out = W.hop_success(e, KEYS, "clock", "ok", F.when(F.col("period") == 1, 0.0).otherwise(45.0))
    return rounded(out, "P", digits=8)


@query("w14_centred_mean", f"""
WITH {EV} SELECT event_id, {', '.join(f"round(avg(vn) OVER (PARTITION BY user_id, period ORDER BY clock RANGE BETWEEN {w / 2 + 1e-6!r} PRECEDING AND {w / 2 + 1e-6!r} FOLLOWING), 8) AS m_w{w}" for w in (1, 3, 5, 7, 10))} FROM ev""")
def _(spark, d):
    names = {f"m_w{w}": float(w) for w in (1, 3, 5, 7, 10)}
    out = W.centred_mean(ev(spark, d), half(spark, d), "vn", names).select("event_id", *names)
    return rounded(out, *names, digits=8)


@query("w15_centred_median", f"""
WITH {EV} SELECT event_id, round(quantile_cont(vn, 0.5) OVER (PARTITION BY user_id, period ORDER BY clock RANGE BETWEEN 4.5 PRECEDING AND 4.5 FOLLOWING), 6) AS med FROM ev""")
def _(spark, d):
    return W.centred_median(ev(spark, d), half(spark, d), "vn", "med").select("event_id", r6(F.col("med")).alias("med"))


@query("w16_trailing_mean", f"""
WITH {EV}, t AS (SELECT event_id, round(avg(vn) OVER (PARTITION BY user_id, period ORDER BY clock, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS roll10 FROM ev WHERE vn IS NOT NULL)
SELECT ev.event_id, roll10 FROM ev LEFT JOIN t ON ev.event_id = t.event_id""")
def _(spark, d):
    return W.trailing_mean(ev(spark, d), half(spark, d), "vn", "roll10").select("event_id", r8(F.col("roll10")).alias("roll10"))


@query("w17_running_sums", f"""
WITH {EV} SELECT event_id, CASE WHEN vn IS NOT NULL THEN round(sum(vn) OVER {W_HALF}, 6) END AS cum, CASE WHEN vn IS NOT NULL THEN count(vn) OVER {W_HALF} END AS n_so_far,
 CASE WHEN vn IS NOT NULL THEN round(sum(vn) OVER {W_HALF} / count(vn) OVER {W_HALF}, 8) END AS mean_so_far FROM ev""")
def _(spark, d):
    out = W.running_sums(ev(spark, d), half(spark, d), "vn").select("event_id", "cum", "n_so_far", "mean_so_far")
    return rounded(rounded(out, "cum"), "mean_so_far", digits=8)


@query("w18_signed_lead", f"""
WITH {EV}, r AS (SELECT event_id, user_id, period, clock, 'teammates' AS reference, vn - 50 AS r FROM ev UNION ALL SELECT event_id, user_id, period, clock, 'opponents', vn - k FROM ev),
 c AS (SELECT *, CASE WHEN r IS NOT NULL THEN sum(r) OVER (PARTITION BY user_id, period, reference ORDER BY clock, event_id) END AS C,
   avg(r) OVER (PARTITION BY user_id, period, reference ORDER BY clock RANGE BETWEEN 3.500001 PRECEDING AND 3.500001 FOLLOWING) AS ma7 FROM r)
SELECT event_id, reference, round(r, 6) AS r, round(ma7, 8) AS ma7, round(C, 6) AS C, CASE WHEN C IS NOT NULL THEN round(greatest(0, least(1, (C + 600) / 1200)), 8) END AS N FROM c""")
def _(spark, d):
    e = ev(spark, d).withColumns({"d_resid_tm": F.col("vn") - 50, "d_resid_op": F.col("vn") - F.col("k")})
    out = W.signed_lead(e, half(spark, d), {"d_resid_tm": "teammates", "d_resid_op": "opponents"})
    return rounded(rounded(out.select("event_id", "reference", "r", "ma7", "C", "N"), "r", "C"), "ma7", "N", digits=8)


@query("w19_period_to_date", f"""
WITH {EV} SELECT event_id, round(sum(value) OVER {W_HALF}, 6) AS dp, sum(k) OVER {W_HALF}::DOUBLE AS dn FROM ev""")
def _(spark, d):
    out = W.period_to_date(ev(spark, d), half(spark, d), {"dp": F.col("value"), "dn": F.col("k").cast("double")})
    return rounded(out.select("event_id", "dp", "dn"), "dp")


# sprint-like table: orders of a customer, recovery = days since the previous order
ORD = """od AS (SELECT o_orderkey, o_custkey, (epoch_us(o_orderdate) / 86400000000)::DOUBLE AS day, CASE WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN 1 ELSE 2 END AS period, o_totalprice AS y FROM orders),
 rec AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey, period ORDER BY day, o_orderkey) >= 0 THEN day - lag(day) OVER (PARTITION BY o_custkey, period ORDER BY day, o_orderkey) END AS x FROM od)"""
ORD_LINE = Line(("o_custkey", "period"), "day", ("o_orderkey",))
CUST_LINE = Line(("o_custkey",), "day", ("o_orderkey",))


def ord_line(spark, d):
    return chosen(spark, ORD_LINE)


def order_gaps(spark, d):
    o = table(spark, d, "orders")
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("double")
    early = F.expr("o_orderdate < TIMESTAMP_NTZ'1998-06-01 00:00:00'")
    o = o.select("o_orderkey", "o_custkey", day.alias("day"), F.when(early, 1).otherwise(2).alias("period"), F.col("o_totalprice").alias("y"))
    gap = F.col("day") - F.col("_p")
    return neighbour(o, ord_line(spark, d), {"_p": F.col("day")}).withColumn("x", F.when(gap >= 0, gap)).drop("_p")


def line_sql(rows: int, least: int, span: float) -> str:
    f = f"(PARTITION BY o_custkey, period ORDER BY day, o_orderkey ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"""us AS (SELECT * FROM rec WHERE x > 0 AND y IS NOT NULL),
 fr AS (SELECT *, count(*) OVER {f} AS roll_n, max(x) OVER {f} - min(x) OVER {f} AS span, regr_slope(y, x) OVER {f} AS b, regr_intercept(y, x) OVER {f} AS a FROM us),
 st AS (SELECT *, CASE WHEN roll_n < {least} THEN 'too_few' WHEN span < {span} THEN 'x_range' ELSE 'ols' END AS roll_method FROM fr)"""


LINE_OUT = """round(CASE WHEN roll_method = 'ols' THEN b END, 4) AS roll_slope, round(CASE WHEN roll_method = 'ols' THEN degrees(atan(b * sx / sy)) END, 5) AS roll_theta_deg,
  round(CASE WHEN roll_method = 'ols' THEN (atan(b * sx / sy) + pi() / 2) / pi() END, 7) AS roll_A, round(CASE WHEN roll_method = 'ols' THEN a + b * xr END, 3) AS roll_H"""


def _line_out(df):
    df = df.withColumns({"roll_slope": F.round("roll_slope", 4), "roll_theta_deg": F.round("roll_theta_deg", 5), "roll_A": F.round("roll_A", 7), "roll_H": F.round("roll_H", 3)})
    return df.select("o_orderkey", "roll_n", "roll_method", "roll_slope", "roll_theta_deg", "roll_A", "roll_H")


@query("w20_rolling_line", f"""
WITH {ORD}, {line_sql(6, 4, 20.0)}, sc AS (SELECT o_custkey, quantile_cont(x, 0.9) AS sx, quantile_cont(y, 0.9) AS sy, quantile_cont(x, 0.5) AS xr FROM us GROUP BY ALL),
 o AS (SELECT st.*, sx, sy, xr FROM st JOIN sc USING (o_custkey))
SELECT rec.o_orderkey, o.roll_n, o.roll_method, {LINE_OUT} FROM rec LEFT JOIN o ON rec.o_orderkey = o.o_orderkey""")
def _(spark, d):
    return _line_out(fits.rolling_line(order_gaps(spark, d), ord_line(spark, d), "x", "y", table_keys=["o_custkey"], rows=6, min_rows=4))


@query("w20_rolling_line_frozen_scales", f"""
WITH {ORD}, {line_sql(6, 4, 20.0)}, o AS (SELECT *, 400.0 AS sx, 420000.0 AS sy, 100.0 AS xr FROM st)
SELECT rec.o_orderkey, o.roll_n, o.roll_method, {LINE_OUT} FROM rec LEFT JOIN o ON rec.o_orderkey = o.o_orderkey""")
def _(spark, d):
    out = fits.rolling_line(order_gaps(spark, d), ord_line(spark, d), "x", "y", table_keys=["o_custkey"], rows=6, min_rows=4, s_x=400.0, s_y=420000.0, x_ref=100.0)
    return _line_out(out)


@query("w21_theil_sen_line", f"""
WITH {ORD}, us AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, period ORDER BY day, o_orderkey) AS rn FROM rec WHERE x > 0),
 win AS (SELECT a.o_orderkey, b.x, b.y, b.rn FROM us a JOIN us b ON a.o_custkey = b.o_custkey AND a.period = b.period AND b.rn BETWEEN a.rn - 4 AND a.rn),
 g AS (SELECT o_orderkey, count(*) AS n, max(x) - min(x) AS span, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM win GROUP BY ALL),
 sl AS (SELECT a.o_orderkey, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM win a JOIN win b ON a.o_orderkey = b.o_orderkey AND b.x > a.x GROUP BY ALL)
SELECT rec.o_orderkey, CASE WHEN n < 4 THEN 'too_few' WHEN span < 20 THEN 'x_range' WHEN n >= 4 THEN 'theilsen' END AS roll_method, round(CASE WHEN n >= 4 AND span >= 20 THEN slope END, 4) AS slope, round(CASE WHEN n >= 4 AND span >= 20 THEN my - slope * mx END, 3) AS intercept
 FROM rec LEFT JOIN g ON rec.o_orderkey = g.o_orderkey LEFT JOIN sl ON rec.o_orderkey = sl.o_orderkey""")
def _(spark, d):
    out = fits.rolling_line(
        order_gaps(spark, d), ord_line(spark, d), "x", "y", table_keys=["o_custkey"], rows=5, min_rows=4, s_x=1.0, s_y=1.0, x_ref=0.0, method="theilsen"
    )
    return out.select("o_orderkey", "roll_method", F.round("roll_slope", 4).alias("slope"), F.round("roll_intercept", 3).alias("intercept"))


# minute curve of a user group against the profile of its coarse group
LOW = f"""{EV}, mn AS (SELECT user_id, floor(clock)::INT + 1 AS minute, avg(value) AS value FROM ev GROUP BY ALL),
 lp AS (SELECT *, CASE WHEN minute <= 45 THEN 1 ELSE 2 END AS half, row_number() OVER () AS id FROM mn)"""


def lowess_sql(src: str, keys: str, y: str, out: str) -> str:
    """Local linear fit of column y per (keys, half), as a self join with tricube weights."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    sel = ", ".join(f"a.{k}" for k in ks)
    return f"""{out}_src AS (SELECT {keys}, minute, {y} AS y FROM {src} WHERE {y} IS NOT NULL),
 {out}_n AS (SELECT {keys}, count(*) AS n, floor(least(1.0, greatest(0.5, 3.0 / count(*))) * count(*))::INT AS kk FROM {out}_src GROUP BY ALL),
 {out}_d AS (SELECT {sel}, a.minute, a.y AS y0, b.minute - a.minute AS u, b.y, row_number() OVER (PARTITION BY {sel}, a.minute ORDER BY abs(b.minute - a.minute)) AS rk FROM {out}_src a JOIN {out}_src b ON {on}),
 {out}_h AS (SELECT d.*, n, max(CASE WHEN rk = kk THEN abs(u) END) OVER (PARTITION BY {", ".join("d." + k for k in ks)}, minute) AS h FROM {out}_d d JOIN {out}_n USING ({keys})),
 {out}_w AS (SELECT *, CASE WHEN abs(u) < h THEN power(1 - power(abs(u) / h::DOUBLE, 3), 3) ELSE 0 END AS w FROM {out}_h),
 {out}_s AS (SELECT {keys}, minute, any_value(y0) AS y0, any_value(n) AS n, sum(w) AS sw, sum(w * u) / sum(w) AS um, sum(w * y) / sum(w) AS ym, sum(w * u * u) / sum(w) AS uu, sum(w * u * y) / sum(w) AS uy FROM {out}_w GROUP BY {keys}, minute),
 {out} AS (SELECT {keys}, minute, CASE WHEN n >= 4 THEN CASE WHEN sw > 0 THEN CASE WHEN uu - um * um > 1e-12 THEN ym - um * (uy - um * ym) / (uu - um * um) ELSE ym END ELSE y0 END END AS fit FROM {out}_s)"""


@query("w22_lowess", f"WITH {LOW}, {lowess_sql('lp', 'user_id, half', 'value', 'fit')} SELECT user_id, half, minute, round(fit, 6) AS fit FROM fit")
def _(spark, d):
    m = ev(spark, d).groupBy("user_id", (F.floor("clock") + 1).cast("int").alias("minute")).agg(F.avg("value").alias("value"))
    m = m.withColumn("half", fits.half_of(F.col("minute")))
    out = fits.lowess(m, ["user_id", "half"], "minute", {"fit": "value"})
    return out.select("user_id", "half", F.col("minute").cast("int").alias("minute"), r6(F.col("fit")).alias("fit"))


# users stand for players, user_id % 10 for the position code
REL = f"""{LOW}, pf AS (SELECT user_id % 10 AS grp, minute, avg(value) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(value) END AS sd FROM mn GROUP BY ALL),
 mg AS (SELECT m.user_id, m.minute, m.value, p.mean, p.sd, CASE WHEN m.minute <= 45 THEN 1 ELSE 2 END AS half FROM mn m JOIN pf p ON m.user_id % 10 = p.grp AND m.minute = p.minute),
 {lowess_sql('mg', 'user_id, half', 'value', 'pfit')}, {lowess_sql('mg', 'user_id, half', 'mean', 'rfit')},
 zz AS (SELECT mg.user_id, mg.half, mg.minute, pfit.fit - rfit.fit AS residual, CASE WHEN mg.sd > 0 THEN (pfit.fit - rfit.fit) / mg.sd END AS z FROM mg JOIN pfit USING (user_id, half, minute) JOIN rfit USING (user_id, half, minute)),
 zn AS (SELECT *, sum(z) OVER (PARTITION BY user_id, half ORDER BY minute) AS sum_z, avg(z) OVER (PARTITION BY user_id, half ORDER BY minute) AS m5a,
   avg(z) OVER (PARTITION BY user_id, half ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r10 FROM zz WHERE z IS NOT NULL)"""


def phi(z):
    from .scalar import phi_sql

    return phi_sql(z)


RELATIVE = f"""{REL}, rs AS (SELECT zz.user_id, zz.half, zz.minute, zz.residual, zz.z, zn.sum_z, zn.r10 AS roll10_z, {phi('zn.m5a')} AS phi_5a, {phi('zn.r10')} AS phi_roll10
  FROM zz LEFT JOIN zn ON zz.user_id = zn.user_id AND zz.half = zn.half AND zz.minute = zn.minute)"""


def relative(spark, d):
    m = ev(spark, d).groupBy("user_id", (F.floor("clock") + 1).cast("int").alias("minute")).agg(F.avg("value").alias("value"))
    m = m.withColumn("grp", F.col("user_id") % 10)
    pf = m.groupBy("grp", "minute").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return fits.relative_scores(m, pf, ["user_id"], ["grp"])


@query("w23_relative_scores", f"WITH {RELATIVE} SELECT user_id, half, minute, round(residual, 5) AS residual, round(z, 5) AS z, round(sum_z, 5) AS sum_z, round(roll10_z, 5) AS roll10_z, round(phi_5a, 6) AS phi_5a, round(phi_roll10, 6) AS phi_roll10 FROM rs")
def _(spark, d):
    out = relative(spark, d).select("user_id", "half", F.col("minute").cast("int").alias("minute"), "residual", "z", "sum_z", "roll10_z", "phi_5a", "phi_roll10")
    return rounded(rounded(out, "residual", "z", "sum_z", "roll10_z", digits=5), "phi_5a", "phi_roll10")


KERNEL = """pt AS (SELECT DISTINCT user_id, period, floor(clock) + 0.5::DOUBLE AS t FROM ev), sh AS (SELECT user_id, period, clock AS ct, k / 100.0 AS xg FROM ev WHERE event_type = 'purchase'),
 km AS (SELECT pt.user_id, pt.period, pt.t, coalesce(sum(exp(-0.5 * power((t - ct) / 1.25, 2))), 0) AS sg, sum(exp(-0.5 * power((t - ct) / 1.25, 2)) * xg) AS sq FROM pt LEFT JOIN sh ON pt.user_id = sh.user_id AND pt.period = sh.period AND abs(t - ct) <= 2.5 GROUP BY ALL)"""


@query("w24_kernel_modifier", f"WITH {EV}, {KERNEL} SELECT user_id, period, t, round(0.15 * least(sg, 1), 7) AS w, round(sq / nullif(sg, 0), 7) AS Q FROM km")
def _(spark, d):
    e = ev(spark, d)
    points = e.select(*KEYS, (F.floor("clock") + 0.5).alias("t")).distinct()
    marks = e.where(F.col("event_type") == "purchase").withColumn("xg", F.col("k") / 100.0)
    return rounded(W.kernel_modifier(points, marks, KEYS, "t", "clock", "xg"), "w", "Q", digits=7)


@query("w25_synergy_windows", f"""
WITH {EV}, s AS (SELECT *, (0.5 * (greatest(-1, least(1, (value - 50) / 97)) + 1) + 0.5 * (greatest(-1, least(1, (k - 50) * 40 / 1450.0)) + 1)) / 2 AS m0 FROM ev)
SELECT event_id, round(m0, 9) AS m, {', '.join(f"round(avg(m0) OVER (PARTITION BY user_id, period ORDER BY clock RANGE BETWEEN {w / 2 + 1e-6!r} PRECEDING AND {w / 2 + 1e-6!r} FOLLOWING), 9) AS m_w{w}" for w in (1, 3, 5, 10))} FROM s""")
def _(spark, d):
    e = ev(spark, d).withColumns({"p": (F.col("value") - 50) * 80 / 97, "t": (F.col("k") - 50) * 40.0})
    out = W.synergy_windows(e, half(spark, d), "p", "t").select("event_id", "m", "m_w1", "m_w3", "m_w5", "m_w10")
    return rounded(out, "m", "m_w1", "m_w3", "m_w5", "m_w10", digits=9)
