"""The whole jobs' further tables over `events` and `embeddings`: report, work rate, speed ends, fit settings, totals."""

import re

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import fits
from ..plans import jobs
from .base import EV, REGISTRY, ev, query, rounded
from .events import PHASES
from .joins import NEAR_SQL, em
from .possession import DEAD, OTB
from .plans import PANEL, PASS_SQL, POSS, RG, dense_panel, dense_positions, panel, sprint_sql, whole
from .windows import CLS_SQL, PEER, PEER_SQL, cls, grid_sql

P_KEYS = "user_id % 7 AS match_id, user_id AS player_id"


def labelled_panel(spark, d):
    t = ev(spark, d).select(
        (F.col("user_id") % 7).alias("match_id"), F.col("user_id").alias("player_id"), (F.col("user_id") % 2).alias("team_id"), "period",
        F.col("event_id").alias("frameNum"), F.col("clock_s").alias("video_time_s"), F.col("clock_s").alias("periodGameClockTime"),
        F.col("value").alias("x"), F.col("k").cast("double").alias("y"), cls().alias("label"),
    )
    return jobs.kinematic_panel(t, whole(spark), stride=1, average=2)


def report(spark, d):
    return jobs.player_report(
        labelled_panel(spark, d), whole=whole(spark), min_frames=2, win=6.0, step=4.0, labels="label", fingerprint_s=240.0, heat_s=(900.0, 900.0)
    )


@query("c10_fingerprint", f"""
WITH {PANEL}, g AS (SELECT user_id, period, clock_s - lag(clock_s) OVER (PARTITION BY user_id, period ORDER BY clock_s, event_id) AS dt FROM panel),
 s AS (SELECT user_id, period, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS med, count(*) AS n FROM g GROUP BY ALL),
 e AS (SELECT user_id, period, min(clock_s) AS lo, max(clock_s) AS hi FROM panel GROUP BY ALL),
 q AS (SELECT e.*, greatest(3, floor(0.8 * 240 * CASE WHEN n >= 3 THEN 1 / med ELSE 30 END)) AS need FROM e JOIN s USING (user_id, period)),
 w AS (SELECT *, lo + i * 240.0::DOUBLE AS s0 FROM q, generate_series(0, 40) g(i) WHERE lo + i * 240.0 < hi - 240 + 1e-9)
SELECT w.user_id % 7 AS match_id, w.user_id AS player_id, w.period, round(s0 + 120, 6) AS t_s, round(avg(abs(jerk_use)), 6) AS jerk, round(avg(CASE WHEN a_tan_use IS NOT NULL THEN greatest(a_tan_use, 0) END), 6) AS acc, round(avg(speed), 7) AS speed, round(sum(step_dist), 5) AS distance, count(*) AS n_frames
FROM w JOIN panel p ON p.user_id = w.user_id AND p.period = w.period AND clock_s >= s0 AND clock_s < s0 + 240 GROUP BY w.user_id, w.period, s0, need HAVING count(*) >= need""")
def _(spark, d):
    return rounded(rounded(rounded(report(spark, d)["fingerprint"], "t_s", "jerk", "acc"), "speed", digits=7), "distance", digits=5)


PEERS = PEER_SQL.replace(PEER, "@").replace("event_type", "match_id").replace("6.0::DOUBLE", "4.0::DOUBLE").replace("12.0::DOUBLE", "6.0::DOUBLE").replace("x.t0 + 6.0 AS", "x.t0 + 3.0 AS")
PEERS = PEERS.replace("@", PANEL + ", pe AS (SELECT user_id % 7 AS match_id, period, user_id, user_id % 2 AS team, clock, speed, acc_use, jerk_use, step_dist FROM panel)", 1)


# metrics are ranked at nine decimals: the same values summed in another order tie
RANKED = PEERS
for _m in ("avg(speed)", "avg(acc_use)", "avg(jerk_use)", "coalesce(sum(step_dist), 0)"):
    RANKED = RANKED.replace(f"{_m} AS", f"round({_m}, 9) AS")


@query("c10_peers", f"WITH {RANKED} SELECT * RENAME (user_id AS player_id, team AS team_id) FROM pr")
def _(spark, d):
    out = report(spark, d)["peers"]
    return rounded(out, *[c for c in out.columns if c.endswith("_pct")])


@query("c10_presence", f"""
WITH {PEERS} SELECT match_id, period, n_team, n_all, count(*) AS n_windows, n_team < 10 AS short_team, n_all < 20 AS short_all FROM pr GROUP BY ALL""")
def _(spark, d):
    return report(spark, d)["presence"]


@query("c10_presence_by_player", f"""
WITH {PEERS}, wa AS (SELECT match_id, period, count(DISTINCT t_centre) AS na FROM pr GROUP BY ALL),
 ow AS (SELECT match_id, period, user_id, count(*) AS n, count(*) FILTER (WHERE n_team < 10) AS st, count(*) FILTER (WHERE n_all < 20) AS sa FROM pr GROUP BY ALL)
SELECT p.match_id, p.period, p.user_id AS player_id, coalesce(n, 0) AS n_windows, coalesce(na, 0) - coalesce(n, 0) AS focal_missing, coalesce(st, 0) AS short_team, coalesce(sa, 0) AS short_all
FROM (SELECT DISTINCT user_id % 7 AS match_id, period, user_id FROM ev) p LEFT JOIN wa USING (match_id, period) LEFT JOIN ow USING (match_id, period, user_id)""")
def _(spark, d):
    return report(spark, d)["presence_by_player"]


def _heat_part(metric: str, top: float) -> str:
    return f"""SELECT h.user_id, h.period, lo + i * 900.0::DOUBLE + 450 AS t_centre, least(floor(v * 40 / {top}), 39)::INT AS bin, '{metric}' AS metric
 FROM (SELECT user_id, period, cs, {metric} AS v FROM sec WHERE {metric} IS NOT NULL) h JOIN (SELECT user_id, period, min(cs) AS lo, max(cs) AS hi FROM sec WHERE {metric} IS NOT NULL GROUP BY ALL) s ON s.user_id = h.user_id AND s.period = h.period,
  generate_series(0, 9) g(i) WHERE lo + i * 900.0 < hi AND cs >= lo + i * 900.0 AND cs < lo + i * 900.0 + 900 AND v >= 0 AND v <= {top}"""


@query("c10_heat", f"""
WITH {PANEL}, sec AS (SELECT user_id, period, floor(clock_s) AS tb, round(avg(clock_s), 9) AS cs, round(avg(speed), 9) AS speed, round(avg(acc_use), 9) AS acc_use, round(avg(jerk_use), 9) AS jerk_use, round(coalesce(sum(step_dist), 0), 9) AS distance_1s FROM panel GROUP BY user_id, period, floor(clock_s)),
 hh AS ({" UNION ALL ".join(_heat_part(m, t) for m, t in (("speed", 10.0), ("acc_use", 5.0), ("jerk_use", 8.0), ("distance_1s", 10.0)))})
SELECT {P_KEYS}, period, round(t_centre, 4) AS t_centre, metric, bin, count(*) AS n FROM hh GROUP BY ALL""")
def _(spark, d):
    """Cells with rows; the table itself has the empty ones too. Times and values are taken at nine decimals."""
    return report(spark, d)["heat"].where("n > 0").withColumn("t_centre", S.at_digits(F.col("t_centre"), 4))


@query("c10_speed_profile", f"""
WITH {PANEL}, b AS (SELECT user_id, period, ceil(speed / 0.2)::BIGINT AS bin, a_tan_use AS a FROM panel WHERE speed > 0.2 AND a_tan_use IS NOT NULL)
SELECT {P_KEYS}, period, round((bin - 0.5) * 0.2, 4) AS centre, count(*) AS n, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.9), 6) AS p90, round(quantile_cont(a, 0.1), 6) AS p10, round(quantile_cont(a, 0.5), 6) AS median FROM b GROUP BY user_id, period, bin HAVING count(*) >= 15""")
def _(spark, d):
    return rounded(rounded(report(spark, d)["speed_profile"], "mean", "p90", "p10", "median"), "centre", digits=4)


@query("c10_phases", f"WITH {EV}, {PHASES} SELECT {P_KEYS}, period, cls AS label, round(t0, 4) AS t0, round(t1, 4) AS t1, round(dur, 4) AS duration_s, round(dur / 60, 6) AS duration_min FROM ph")
def _(spark, d):
    return rounded(rounded(report(spark, d)["phases"], "t0", "t1", "duration_s", digits=4), "duration_min")


@query("c10_phase_stats", f"""
WITH {EV}, {PHASES} SELECT cls AS label, count(*) AS n_segments, round(avg(dur), 5) AS mean_s, round(min(dur), 5) AS min_s, round(max(dur), 4) AS max_s, round(sum(dur), 3) AS total_s, round(quantile_cont(dur, 0.5), 4) AS median_s FROM ph GROUP BY cls""")
def _(spark, d):
    return rounded(rounded(rounded(report(spark, d)["phase_stats"], "mean_s", "min_s", digits=5), "max_s", "median_s", digits=4), "total_s", digits=3)


@query("c10_class_averages", f"""
WITH {RG}, lw AS (SELECT user_id, period, t0, max(speed) AS ms, count(*) FILTER (WHERE cls = 'IN_POSSESSION') AS a, count(*) FILTER (WHERE cls = 'OUT_OF_POSSESSION') AS b, count(*) FILTER (WHERE cls = 'DEAD_OR_UNRESOLVED') AS z FROM (SELECT *, {CLS_SQL} AS cls FROM inw) GROUP BY ALL HAVING count(*) >= 2),
 lc AS (SELECT *, CASE WHEN a > 0 AND a >= b AND a >= z THEN 1 WHEN b > 0 AND b >= a AND b >= z THEN 2 ELSE 3 END AS c FROM lw)
SELECT {P_KEYS}, period, round(avg(CASE WHEN c = 1 THEN ms END), 6) AS in_avg, round(avg(CASE WHEN c = 2 THEN ms END), 6) AS out_avg, round(100.0 * count(*) FILTER (WHERE c = 1) / count(*), 6) AS in_pct, round(100.0 * count(*) FILTER (WHERE c = 2) / count(*), 6) AS out_pct FROM lc GROUP BY user_id, period""")
def _(spark, d):
    return rounded(report(spark, d)["class_averages"], "in_avg", "out_avg", "in_pct", "out_pct")


# near neighbours: the twenty vectors of a frame are its players, nine frames in turn belong to one match
WORK = NEAR_SQL + """, m AS (SELECT *, (frame // 9) % 3 AS match_id, vec_id % 20 AS player_id, frame * 20.0::DOUBLE AS clock_s FROM near),
 dt0 AS (SELECT DISTINCT (frame // 9) % 3 AS match_id, vec_id % 20 AS player_id, frame * 20.0::DOUBLE AS t FROM em), dt1 AS (SELECT match_id, player_id, t - lag(t) OVER (PARTITION BY match_id, player_id ORDER BY t) AS dt FROM dt0),
 fp AS (SELECT match_id, player_id, 1 / quantile_cont(dt, 0.5) AS fps FROM dt1 WHERE dt > 0 GROUP BY ALL),
 b AS (SELECT m.match_id, m.player_id, floor(clock_s / 60) AS mb, avg(s_player) - avg(s_tm) AS s_resid_tm, sum(d_player) AS dp, sum(d_tm) AS dt, sum(d_op) AS dop, count(*) AS n FROM m JOIN fp USING (match_id, player_id) GROUP BY m.match_id, m.player_id, floor(clock_s / 60), fps HAVING count(*) >= ceil(0.7 * 60 * fps)),
 c AS (SELECT *, mb + 0.5 AS t, dp - dt AS rt, dp - dop AS ro FROM b)"""


def work_panel(spark, d):
    f = F.col("frame")
    e = em(spark, d).select(
        (F.floor(f / 9) % 3).alias("match_id"), F.lit(1).alias("period"), f.alias("frameNum"), (F.col("vec_id") % 20).alias("player_id"), F.col("team").alias("team_id"),
        (f * 20.0).alias("periodGameClockTime"), (f * 20.0).alias("video_time_s"), "x", "y", "speed", "step_dist",
    )
    return e


def work(spark, d):
    return jobs.local_work_rate(work_panel(spark, d), coverage=0.7, floor_m=1.0, whole=whole(spark))


@query("c04_work_rate_minutes", f"""
WITH {WORK}, s AS (SELECT *, sum(dp) OVER w AS sp, sum(dt) OVER w AS st, sum(dop) OVER w AS so, quantile_cont(rt, 0.5) OVER r AS mt, quantile_cont(ro, 0.5) OVER r AS mo FROM c WINDOW w AS (PARTITION BY match_id, player_id ORDER BY t), r AS (PARTITION BY match_id, player_id ORDER BY t RANGE BETWEEN 4.5 PRECEDING AND 4.5 FOLLOWING))
SELECT match_id, player_id, t AS t_centre_min, CASE WHEN t < 15 THEN 'early' WHEN t < 30 THEN 'middle' ELSE 'late' END AS phase, n AS n_frames, round(s_resid_tm, 7) AS s_resid_tm, round(rt, 7) AS d_resid_tm, round(ro, 7) AS d_resid_op, round(mt, 7) AS med_tm, round(mo, 7) AS med_op,
 round(CASE WHEN sp + st >= 1 THEN ((sp - st) / (sp + st) + 1) / 2 END, 7) AS share_tm, round(CASE WHEN sp + so >= 1 THEN ((sp - so) / (sp + so) + 1) / 2 END, 7) AS share_op FROM s""")
def _(spark, d):
    t = work(spark, d)["minutes"].withColumnsRenamed({"d_resid_tm_med9": "med_tm", "d_resid_op_med9": "med_op"})
    out = t.select("match_id", "player_id", "t_centre_min", "phase", "n_frames", "s_resid_tm", "d_resid_tm", "d_resid_op", "med_tm", "med_op", "share_tm", "share_op")
    return rounded(out, *out.columns[5:], digits=7)


@query("c04_work_rate_lead", f"""
WITH {WORK}, l AS (SELECT match_id, player_id, t, 'teammates' AS reference, rt AS r FROM c UNION ALL SELECT match_id, player_id, t, 'opponents', ro FROM c)
SELECT match_id, player_id, t AS t_centre_min, reference, round(r, 7) AS r, round(sum(r) OVER w, 6) AS "C", round(greatest(0, least(1, (sum(r) OVER w + 600) / 1200)), 8) AS "N",
 round(avg(r) OVER (PARTITION BY match_id, player_id, reference ORDER BY t RANGE BETWEEN 3.500001 PRECEDING AND 3.500001 FOLLOWING), 7) AS ma7 FROM l WINDOW w AS (PARTITION BY match_id, player_id, reference ORDER BY t)""")
def _(spark, d):
    return rounded(rounded(work(spark, d)["lead"].drop("period"), "r", "ma7", digits=7), "C").withColumn("N", F.round("N", 8))


@query("c04_work_rate_phases", f"""
WITH {WORK}, p AS (SELECT *, CASE WHEN t < 15 THEN 'early' WHEN t < 30 THEN 'middle' ELSE 'late' END AS phase FROM c)
SELECT match_id, player_id, round(quantile_cont(rt, 0.5) FILTER (WHERE phase = 'late') - quantile_cont(rt, 0.5) FILTER (WHERE phase = 'early'), 7) AS delta_d_resid_tm, round(quantile_cont(ro, 0.5) FILTER (WHERE phase = 'late') - quantile_cont(ro, 0.5) FILTER (WHERE phase = 'early'), 7) AS delta_d_resid_op FROM p GROUP BY ALL""")
def _(spark, d):
    return rounded(work(spark, d)["phase_delta"].drop("period"), "delta_d_resid_tm", "delta_d_resid_op", digits=7)


def speed_tables(spark, d):
    p, pos, w = dense_panel(spark, d), dense_positions(spark, d), whole(spark)
    return jobs.relative_speed_tables(jobs.relative_speed(p, pos, jobs.profiles(p, pos, w), ("speed", "acceleration", "distance", "jerk"), w))


SPEED = f"sp AS ({REGISTRY['c02_relative_speed'][1]})"


@query("c02_half_ends", f"""
WITH {SPEED} SELECT match_id, player_id, metric, half, arg_max(phi_5a, minute) FILTER (WHERE phi_5a IS NOT NULL) AS phi_5a_end, arg_max(phi_roll10, minute) FILTER (WHERE phi_roll10 IS NOT NULL) AS phi_roll10_end FROM sp GROUP BY ALL""")
def _(spark, d):
    return rounded(speed_tables(spark, d)["half_ends"].drop("sum_z_end"), "phi_5a_end", "phi_roll10_end")


# the summary is taken of the scores themselves, not of rounded ones
SCORES = re.sub(r"round\((.*?), [56]\) AS (z|phi_5a|phi_roll10)\b", r"\1 AS \2", SPEED)


@query("c02_summary", f"""
WITH {SCORES} SELECT match_id, player_id, metric, round(max(CASE WHEN minute = 45 THEN phi_roll10 END), 6) AS phi_p1_end, count(*) FILTER (WHERE minute <= 45 AND phi_roll10 > 0.5) AS n_above_half_p1, round(avg(CASE WHEN minute <= 45 THEN phi_roll10 END), 5) AS phi_p1_mean, round(avg(CASE WHEN minute > 45 THEN phi_roll10 END), 5) AS phi_p2_mean FROM sp GROUP BY ALL""")
def _(spark, d):
    out = speed_tables(spark, d)["summary"].drop("phi_start")
    return rounded(rounded(out, "phi_p1_end"), "phi_p1_mean", "phi_p2_mean", digits=5)


SETTINGS = ((3, 2, 20.0), (4, 2, 20.0), (4, 3, 60.0))


def _settings_sql() -> str:
    parts = []
    for y, sy in fits.SCALE_Y.items():
        for n, least, span in SETTINGS:
            f = f"(PARTITION BY user_id, period ORDER BY s0 ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            parts.append(f"""SELECT user_id, period, s0, '{y}' AS y_metric, {n} AS n_window, {least} AS min_n, {span}::DOUBLE AS min_x_s,
 CASE WHEN count(*) OVER {f} >= {least} AND max(x) OVER {f} - min(x) OVER {f} >= {span} THEN (atan(regr_slope({y}, x) OVER {f} * (200.0 / {sy})) + pi() / 2) / pi() END AS a FROM sr WHERE x > 0 AND {y} IS NOT NULL""")
    return f"""WITH {sprint_sql()}, st AS ({' UNION ALL '.join(parts)})
SELECT {P_KEYS}, n_window, min_n, min_x_s, y_metric, count(*) AS n_usable, count(a) AS n_fit, round(min(a), 6) AS "min_A", round(max(a), 6) AS "max_A", round(quantile_cont(a, 0.5), 6) AS "median_A" FROM st GROUP BY ALL"""


@query("c03_settings", _settings_sql())
def _(spark, d):
    w = whole(spark)
    table = jobs.sprints(panel(spark, d), w, k_high=0.3, k_low=0.2, gap=60.0)
    out = jobs.sprint_settings(table, w, SETTINGS)
    return rounded(out, "min_A", "max_A", "median_A").select("match_id", "player_id", "n_window", "min_n", "min_x_s", "y_metric", "n_usable", "n_fit", "min_A", "max_A", "median_A")


@query("c01_pass_totals", f"""
WITH {EV}, {PASS_SQL} SELECT user_id % 7 AS match_id, user_id AS player_id, period, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS overall_pct FROM ps GROUP BY ALL""")
def _(spark, d):
    p = ev(spark, d).where(F.col("event_type").isin("view", "click")).select(
        (F.col("user_id") % 7).alias("match_id"), F.col("user_id").alias("player_id"), "period", F.col("clock").alias("game_clock_min"), (F.col("k") % 3 != 0).alias("success")
    )
    return rounded(jobs.pass_totals(p), "overall_pct")


# possession from events and frames: a user is a match, with two players on either side; on-ball ids are k % 40, and every row is a
# frame with the ball at the centre spot (now and then lost)
ACTOR = "CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 11 ELSE 12 END"
FROM_EVENTS = f"""{DEAD},
 rw AS (SELECT user_id, event_id, k % 40 AS gid, clock AS st, clock + (k % 4) * 0.2 AS en, {ACTOR} AS pl, CASE WHEN k % 7 <> 0 THEN (k % 4) // 2 END AS tm, CASE WHEN k % 5 <> 0 THEN k // 25 END AS sq FROM ev WHERE event_type <> 'error'),
 og AS (SELECT user_id, gid AS event_id, min(st) AS t0, max(en) AS te, arg_min(pl, event_id) AS pl, arg_min(tm, event_id) AS tm, arg_min(sq, event_id) AS seq FROM rw GROUP BY ALL),
 oi AS (SELECT user_id, event_id, t0, CASE WHEN te - t0 <= 0 THEN t0 + 0.01 ELSE te END AS t1, pl, tm, seq, te - t0 <= 0 AS inst, CASE tm WHEN 0 THEN 'FOCAL' WHEN 1 THEN 'OPP' END AS label FROM og),
 otb AS (SELECT user_id, event_id, t0, t1, label, seq FROM oi WHERE label IS NOT NULL),
 pos AS (SELECT event_id, user_id, clock, CASE WHEN k % 23 <> 0 THEN 0.0::DOUBLE END AS ball_x, [(k % 7) * 0.5::DOUBLE + 0.25, (k % 5) * 0.75::DOUBLE + 0.125, (k % 3) * 1.25::DOUBLE + 0.375, (k % 11) * 0.625::DOUBLE + 0.0625] AS ds FROM ev),
 ac AS (SELECT o.user_id, o.event_id, arg_min(p.ds[CASE o.pl WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 11 THEN 3 ELSE 4 END], (p.ds[CASE o.pl WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 11 THEN 3 ELSE 4 END], abs(p.clock - o.t0))) AS dist FROM oi o JOIN pos p ON p.user_id = o.user_id AND p.ball_x IS NOT NULL AND p.clock >= o.t0 - 0.15 AND p.clock <= o.t0 + 0.15 GROUP BY ALL),
 rad AS (SELECT greatest(1.0, least(3.5, coalesce(CASE WHEN count(*) FILTER (WHERE dist <= 8) >= 30 THEN quantile_cont(dist, 0.95) FILTER (WHERE dist <= 8) ELSE quantile_cont(dist, 0.95) END, 1.5))) AS rpz, count(*) AS n_measured FROM ac)"""


def _from_events_sql() -> str:
    """The two labellings' SQL over these intervals, markers and frames; spans are bounded by the frames."""
    q = POSS.replace(f"{DEAD}, {OTB}", FROM_EVENTS).replace("(SELECT user_id, max(t1) AS tend FROM otb GROUP BY ALL)", "(SELECT user_id, max(clock) AS tend FROM ev GROUP BY ALL)")
    a, b = q.index(", fr AS ("), q.index(" la AS (")
    lead = """,
 ld0 AS (SELECT f.user_id, f.t_min AS t0, o.tf AS t1 FROM (SELECT user_id, min(clock) AS t_min FROM ev GROUP BY ALL) f JOIN (SELECT user_id, min(t0) AS tf FROM otb GROUP BY ALL) o USING (user_id) JOIN (SELECT user_id, min(td) AS fm FROM dead GROUP BY ALL) m USING (user_id) WHERE t_min < tf AND fm <= tf)"""
    frames = f"""{lead}, fr AS (SELECT event_id, user_id, clock, ball_x, CASE WHEN ball_x IS NOT NULL THEN least(ds[1], ds[2]) END AS d_focal, CASE WHEN ball_x IS NOT NULL THEN least(ds[3], ds[4]) END AS d_opp FROM pos),
 ol AS (SELECT user_id, t0, t1, CASE WHEN pl = 1 THEN 'FOCAL' WHEN tm = 0 THEN 'TEAMMATE' WHEN tm = 1 THEN 'OPPONENT' ELSE 'NONE' END AS player FROM oi),
 sp2 AS (SELECT user_id, t0, t1, team_possession FROM spans UNION ALL SELECT user_id, t0, t1, 'DEAD' FROM ld0),
"""
    q = q[:a] + frames + q[b:]
    q = q.replace("LEFT JOIN spans s", "LEFT JOIN sp2 s")
    return q.replace("< 2.5", "< (SELECT rpz FROM rad)")


POSS_EVENTS = _from_events_sql()


def from_events(spark, d):
    k, e = F.col("k"), ev(spark, d)
    error = F.col("event_type") == "error"
    actor = F.element_at(F.array(*[F.lit(p).cast("long") for p in (1, 2, 11, 12)]), k % 4 + 1)
    events = e.select(
        "user_id", F.col("event_id").alias("_order"), (k % 40).alias("gameEventId"), F.when(~error, "OTB").when(k % 4 == 3, "FOUL").when(k % 4 == 0, "END").otherwise("OUT").alias("event_kind"),
        F.when(error & (k % 3 != 0), F.col("clock")).alias("eventTime"), F.when(error, F.col("clock") - 0.01).otherwise(F.col("clock")).alias("startTime"),
        (F.col("clock") + (k % 4) * 0.2).alias("endTime"), F.lit(None).cast("double").alias("duration"), actor.alias("player_id"), F.when(k % 7 != 0, F.floor((k % 4) / 2)).alias("team_id"),
        F.when(k % 5 != 0, F.floor(k / 25)).alias("sequence"), "period", F.when(F.col("event_type") == "view", "PA").otherwise(F.col("event_type")).alias("poss_type"),
        F.when(k % 3 != 0, "C").alias("pass_outcome"), F.when(k % 8 != 0, F.element_at(F.array(*[F.lit(p).cast("long") for p in (1, 2, 11, 12)]), (k + 1) % 4 + 1)).alias("receiver_id"),
    )

    def side(*xs):
        return F.array(*[F.struct(F.lit(str(i + 1)).alias("jerseyNum"), x.alias("x"), F.lit(0.0).alias("y")) for i, x in enumerate(xs)])

    frames = e.select(
        "user_id", "event_id", "clock", F.when(k % 23 != 0, 0.0).alias("ball_x"), F.lit(0.0).alias("ball_y"),
        side((k % 7) * 0.5 + 0.25, (k % 5) * 0.75 + 0.125).alias("home"), side((k % 3) * 1.25 + 0.375, (k % 11) * 0.625 + 0.0625).alias("away"),
    )
    sides = [("home", "1", 1), ("home", "2", 2), ("away", "1", 11), ("away", "2", 12)]
    squad = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("shirt"), F.lit(p).cast("long").alias("player_id")) for s, n, p in sides])
    roster = e.select("user_id").distinct().select("user_id", F.inline(squad))
    return jobs.possession_from_events(
        events, frames, roster, None, ("user_id",), focal_home=F.lit(True), focal_team=F.lit(0), focal_player=F.lit(1), time="clock", frame="event_id", whole=whole(spark), epsilon=0.01
    )


@query("c07_from_events", f"""
WITH {EV}, {POSS_EVENTS} SELECT event_id, player_a, team_a, CASE WHEN hold IS NOT NULL THEN hold WHEN held IN ('FOCAL', 'OPP') THEN held WHEN stuck IS NOT NULL THEN stuck WHEN team_a = 'DEAD' THEN 'DEAD' ELSE 'UNRESOLVED' END AS team_b FROM lg""")
def _(spark, d):
    return from_events(spark, d)["labels"].select("event_id", "player_a", "team_a", "team_b")


@query("c07_radius", f"WITH {EV}, {POSS_EVENTS} SELECT n_measured, round(rpz, 6) AS rpz FROM rad")
def _(spark, d):
    return rounded(from_events(spark, d)["radius"].select("n_measured", "rpz"), "rpz")


@query("c07_handoffs", f"""
WITH {EV}, {POSS_EVENTS}, ps AS (SELECT user_id, event_id AS i, k % 40 AS gid, CASE (k + 1) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 11 ELSE 12 END AS rc, clock AS pt FROM ev WHERE event_type = 'view' AND k % 3 <> 0 AND k % 8 <> 0),
 nx AS (SELECT DISTINCT p.user_id, p.gid, p.pt, p.rc, o.t0, o.pl, p.rc = o.pl AS hit FROM ps p LEFT JOIN oi o ON o.user_id = p.user_id AND o.t0 >= p.pt - 1e-6 AND o.t0 <= p.pt + 5),
 bs AS (SELECT user_id, gid, pt, rc, arg_min(pl, (NOT coalesce(hit, false), t0, pl)) AS np, arg_min(t0, (NOT coalesce(hit, false), t0, pl)) AS nt FROM nx GROUP BY ALL)
SELECT user_id, gid AS "gameEventId", round(pt, 5) AS pt, rc AS receiver_id, np AS next_player, round(nt - pt, 5) AS gap_s, coalesce(np = rc, false) AS receiver_match FROM bs""")
def _(spark, d):
    """Passes without a receiver are left out; repeated passes of one id at one time count once."""
    return rounded(from_events(spark, d)["handoff"].withColumnRenamed("_pt", "pt"), "pt", "gap_s", digits=5)
