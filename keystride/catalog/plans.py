"""Composite jobs over `events`: each user is a player of match ``user_id % 7``, on a 90-minute clock."""

from pyspark.sql import functions as F

from ..operators.ordered import Line
from ..plans import jobs
from .base import EV, chosen, ev, half, query, rounded, user
from .joins import NEAR_SQL, em
from .kinematics import kin_sql
from .possession import dead, otb, span_sql
from .scalar import POS_SQL, POSITIONS, phi_sql
from .windows import grid_sql, lowess_sql

def whole(spark):
    """Whether a player's half is taken for bounded."""
    return user(spark, "").whole


TRACK = EV + """, xy AS (SELECT *, user_id % 7 AS match_id, user_id AS player_id, value AS x, k::DOUBLE AS y FROM ev)"""
SEG1 = TRACK + """,
 d1 AS (SELECT *, clock_s - lag(clock_s) OVER (PARTITION BY user_id, period ORDER BY clock_s, event_id) AS dt FROM xy),
 d2 AS (SELECT *, quantile_cont(dt, 0.5) OVER (PARTITION BY user_id, period) AS med FROM d1),
 seg AS (SELECT *, sum(CASE WHEN med > 0 AND dt > 2.5 * med THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, period ORDER BY clock_s, event_id) AS segment FROM d2)"""
PANEL = f"""{kin_sql(1, 2, SEG1)},
 panel AS (SELECT *, CASE WHEN clock_s - lag(clock_s) OVER w > 0 THEN sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) END AS step_dist FROM kin WINDOW w AS (PARTITION BY user_id, period ORDER BY clock_s, event_id))"""


def track(spark, d):
    return ev(spark, d).select(
        (F.col("user_id") % 7).alias("match_id"), F.col("user_id").alias("player_id"), (F.col("user_id") % 2).alias("team_id"), "period",
        F.col("event_id").alias("frameNum"), F.col("clock_s").alias("video_time_s"), F.col("clock_s").alias("periodGameClockTime"),
        F.col("value").alias("x"), F.col("k").cast("double").alias("y"),
    )


def panel(spark, d):
    return jobs.kinematic_panel(track(spark, d), whole(spark), stride=1, average=2)


def positions(spark, d):
    code = F.element_at(F.array(*[F.lit(p) for p in POSITIONS[:10]]), (F.col("user_id") % 10 + 1).cast("int"))
    return ev(spark, d).select((F.col("user_id") % 7).alias("match_id"), F.col("user_id").alias("player_id"), code.alias("position")).distinct()


PASS_SQL = """ps AS (SELECT user_id, period, clock AS t, k % 3 <> 0 AS ok FROM ev WHERE event_type IN ('view', 'click')), sh AS (SELECT user_id, period, clock AS ct, k / 100.0 AS xg FROM ev WHERE event_type = 'purchase'),
 ends AS (SELECT user_id, period, max(t) AS hi, CASE period WHEN 1 THEN 0.0::DOUBLE ELSE 45.0::DOUBLE END AS s0 FROM ps GROUP BY ALL), g AS (SELECT user_id, period, s0 + i AS ws FROM ends, generate_series(0, 60) s(i) WHERE s0 + i < hi + 1e-9),
 cu AS (SELECT g.user_id, g.period, ws, count(t) AS n, CASE WHEN count(t) >= 2 THEN count(*) FILTER (WHERE ok) / count(t) END AS p FROM g LEFT JOIN ps ON ps.user_id = g.user_id AND ps.period = g.period AND t >= ws AND t < ws + 5 GROUP BY ALL),
 km AS (SELECT cu.user_id, cu.period, ws, n, p, coalesce(sum(exp(-0.5 * power((ws + 2.5 - ct) / 1.25, 2))), 0) AS sg, sum(exp(-0.5 * power((ws + 2.5 - ct) / 1.25, 2)) * xg) AS sq FROM cu LEFT JOIN sh ON cu.user_id = sh.user_id AND cu.period = sh.period AND abs(ws + 2.5 - ct) <= 2.5 GROUP BY ALL),
 wq AS (SELECT *, 0.15 * least(sg, 1) AS w, sq / nullif(sg, 0) AS q FROM km)"""


@query("c01_pass_quality", f"""
WITH {EV}, {PASS_SQL} SELECT user_id % 7 AS match_id, user_id AS player_id, period, ws + 2.5 AS t_min, n, round(p, 8) AS "P", round(w, 8) AS w, round(q, 8) AS "Q", round(CASE WHEN w > 0 THEN (1 - w) * p + w * q ELSE p END, 8) AS "C" FROM wq""")
def _(spark, d):
    e, k = ev(spark, d), F.col("k")
    base = [(F.col("user_id") % 7).alias("match_id"), F.col("user_id").alias("player_id"), "period", F.col("clock").alias("game_clock_min")]
    passes = e.where(F.col("event_type").isin("view", "click")).select(*base, (k % 3 != 0).alias("success"))
    shots = e.where(F.col("event_type") == "purchase").select(*base, (k / 100.0).alias("xG"))
    out = jobs.pass_quality(passes, shots).select("match_id", "player_id", "period", "t_min", "n", "P", "w", "Q", "C")
    return rounded(out, "P", "w", "Q", "C", digits=8)


def minutes_sql(cov: float) -> str:
    return f"""mdt AS (SELECT user_id, clock_s - lag(clock_s) OVER (PARTITION BY user_id ORDER BY clock_s, event_id) AS dt FROM panel),
 need AS (SELECT user_id, greatest(3, floor({cov} * greatest(1, 60 / coalesce(quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5), 1 / 30.0)))) AS need FROM mdt GROUP BY ALL),
 a AS (SELECT user_id, floor(clock_s / 60)::INT + 1 AS minute, count(*) AS n, avg(speed) AS sp, count(speed) AS nsp, avg(acc_use) AS ac, count(acc_use) AS nac, avg(jerk_use) AS jk, count(jerk_use) AS njk, sum(step_dist) AS di FROM panel GROUP BY ALL),
 mins AS (SELECT a.*, need FROM a JOIN need USING (user_id) WHERE n >= need),
 minutes AS (SELECT user_id, minute, 'speed' AS metric, sp AS value FROM mins WHERE nsp >= need UNION ALL SELECT user_id, minute, 'acceleration', ac FROM mins WHERE nac >= need UNION ALL SELECT user_id, minute, 'distance', di FROM mins WHERE di IS NOT NULL UNION ALL SELECT user_id, minute, 'jerk', jk FROM mins WHERE njk >= need)"""


# players of the minute tables are the 20 residues of k, dense enough for the coverage gate
DENSE = EV.replace("ev AS (", "ev0 AS (", 1) + ", ev AS (SELECT * REPLACE (k % 20 AS user_id) FROM ev0)"
DENSE_PANEL = PANEL.replace(EV, DENSE)


def dense_track(spark, d):
    return track(spark, d).withColumns({"player_id": F.col("y").cast("int") % 20}).withColumn("match_id", F.col("player_id") % 7)


def dense_panel(spark, d):
    return jobs.kinematic_panel(dense_track(spark, d), whole(spark), stride=1, average=2)


def dense_positions(spark, d):
    p = F.col("player_id")
    code = F.element_at(F.array(*[F.lit(x) for x in POSITIONS[:10]]), (p % 10 + 1).cast("int"))
    return dense_track(spark, d).select("match_id", "player_id").distinct().withColumn("position", code)


DPOS = POS_SQL.replace("k % 12", "user_id % 10")
PROFILE_SQL = f"""{DENSE_PANEL}, {minutes_sql(0.7)}, cc AS (SELECT *, {DPOS} AS code FROM minutes),
 bb AS (SELECT 'detailed' AS level, code AS "group", minute, metric, value FROM cc UNION ALL SELECT 'coarse', CASE WHEN code IN ('LB','LCB','RCB','RB') THEN 'Defender' WHEN code IN ('DM','CM','AM') THEN 'Midfielder' ELSE 'Attacker' END, minute, metric, value FROM cc),
 gg AS (SELECT level, "group", m.i::INT AS minute, t.metric FROM (SELECT DISTINCT level, "group" FROM bb), generate_series(1, 90) m(i), (VALUES ('speed'), ('acceleration'), ('distance'), ('jerk')) t(metric)),
 prof AS (SELECT gg.level, gg."group", gg.minute, gg.metric, count(value) AS n, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_samp(value) END AS sd FROM gg LEFT JOIN bb ON gg.level = bb.level AND gg."group" = bb."group" AND gg.minute = bb.minute AND gg.metric = bb.metric GROUP BY ALL)"""


@query("c02_relative_speed", f"""
WITH {PROFILE_SQL}, um AS (SELECT user_id, metric, i::INT AS minute FROM (SELECT DISTINCT user_id FROM panel), (VALUES ('speed'), ('acceleration'), ('distance'), ('jerk')) t(metric), generate_series(1, 90) s(i)),
 mg AS (SELECT u.user_id, u.metric, u.minute, c.value, p.mean, p.sd, CASE WHEN u.minute <= 45 THEN 1 ELSE 2 END AS half FROM um u JOIN prof p ON p.level = 'detailed' AND p."group" = {DPOS.replace('user_id', 'u.user_id')} AND p.minute = u.minute AND p.metric = u.metric LEFT JOIN cc c ON c.user_id = u.user_id AND c.metric = u.metric AND c.minute = u.minute),
 {lowess_sql('mg', 'user_id, metric, half', 'value', 'pfit')}, {lowess_sql('mg', 'user_id, metric, half', 'mean', 'rfit')},
 zz AS (SELECT mg.user_id, mg.metric, mg.half, mg.minute, CASE WHEN mg.sd > 0 THEN (pfit.fit - rfit.fit) / mg.sd END AS z FROM mg LEFT JOIN pfit USING (user_id, metric, half, minute) LEFT JOIN rfit USING (user_id, metric, half, minute)),
 zn AS (SELECT *, avg(z) OVER (PARTITION BY user_id, metric, half ORDER BY minute) AS m5a, avg(z) OVER (PARTITION BY user_id, metric, half ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r10 FROM zz WHERE z IS NOT NULL)
SELECT user_id % 7 AS match_id, user_id AS player_id, metric, half, minute, round(zz.z, 5) AS z, round({phi_sql('m5a')}, 6) AS phi_5a, round({phi_sql('r10')}, 6) AS phi_roll10 FROM zz LEFT JOIN zn USING (user_id, metric, half, minute)""")
def _(spark, d):
    p, pos = dense_panel(spark, d), dense_positions(spark, d)
    w = whole(spark)
    s = jobs.relative_speed(p, pos, jobs.profiles(p, pos, w), ("speed", "acceleration", "distance", "jerk"), w)
    s = s.select("match_id", "player_id", "metric", "half", F.col("minute").cast("int").alias("minute"), "z", "phi_5a", "phi_roll10")
    return rounded(rounded(s, "z", digits=5), "phi_5a", "phi_roll10")


@query("c08_profiles", f'WITH {PROFILE_SQL} SELECT level, "group", minute, metric, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM prof')
def _(spark, d):
    return rounded(jobs.profiles(dense_panel(spark, d), dense_positions(spark, d), whole(spark)), "mean", "sd")


SPRINT_SQL = f"""{PANEL}, jj AS (SELECT *, (a_tan_use - lag(a_tan_use) OVER w) / nullif(greatest(clock_s - lag(clock_s) OVER w, 0), 0) AS jt0 FROM panel WINDOW w AS (PARTITION BY user_id, period ORDER BY clock_s, event_id)),
 src AS (SELECT * REPLACE (step_dist AS vn), a_tan_use AS a, CASE WHEN row_number() OVER w = 1 THEN CASE WHEN lead(event_id, 2) OVER w IS NOT NULL THEN lead(jt0) OVER w END ELSE jt0 END AS j FROM jj WINDOW w AS (PARTITION BY user_id, period ORDER BY clock_s, event_id))"""


def sprint_sql() -> str:
    from .events import hyst_sql, merge_sql

    return f"""{SPRINT_SQL}, {hyst_sql(0.3, 0.2, 'speed')}, {merge_sql(60)}, sprints AS (SELECT user_id, period, n_atoms, min(clock_s) AS s0, max(clock_s) AS s1, min(clock) AS cm, sum(vn) AS distance_m, max(speed) AS peak_speed, count(speed) AS n_samples FROM mr GROUP BY user_id, period, c, n_atoms),
 sr AS (SELECT *, CASE WHEN s0 - lag(s1) OVER w >= 0 THEN s0 - lag(s1) OVER w END AS x FROM sprints WINDOW w AS (PARTITION BY user_id, period ORDER BY s0))"""


def _line_part(y, sy):
    f = "(PARTITION BY user_id, period ORDER BY s0 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    return f"""SELECT user_id, period, cm, '{y}' AS y_metric, CASE WHEN x > 0 AND {y} IS NOT NULL THEN CASE WHEN count(*) OVER {f} >= 2 AND max(x) OVER {f} - min(x) OVER {f} >= 20 THEN regr_slope({y}, x) OVER {f} END END * (200.0 / {sy}) AS b FROM sr WHERE x > 0 AND {y} IS NOT NULL
 UNION ALL SELECT user_id, period, cm, '{y}', NULL FROM sr WHERE NOT coalesce(x > 0 AND {y} IS NOT NULL, false)"""


@query("c03_sprint_recovery", f"""
WITH {sprint_sql()}, ln AS ({_line_part('distance_m', 42.0)} UNION ALL {_line_part('peak_speed', 7.0)})
SELECT user_id % 7 AS match_id, user_id AS player_id, 'ols_line_angle' AS section, y_metric, period, round(cm, 4) AS minute, round((atan(b) + pi() / 2) / pi(), 6) AS "roll_A" FROM ln""")
def _(spark, d):
    w = whole(spark)
    table = jobs.sprints(panel(spark, d), w, k_high=0.3, k_low=0.2, gap=60.0)
    from ..session import stage

    out = jobs.sprint_recovery(stage(table), rows=4, min_rows=2, whole=w)
    return rounded(rounded(out, "minute", digits=4), "roll_A")


@query("c04_local_work_rate", f"""
WITH {NEAR_SQL}, m AS (SELECT *, frame % 3 AS match_id, vec_id % 10 AS player_id, frame * 20.0::DOUBLE AS clock_s FROM near),
 dt0 AS (SELECT DISTINCT frame % 3 AS match_id, vec_id % 10 AS player_id, frame * 20.0::DOUBLE AS t FROM em), dt1 AS (SELECT match_id, player_id, t - lag(t) OVER (PARTITION BY match_id, player_id ORDER BY t) AS dt FROM dt0),
 fp AS (SELECT match_id, player_id, 1 / quantile_cont(dt, 0.5) AS fps FROM dt1 WHERE dt > 0 GROUP BY ALL),
 b AS (SELECT m.match_id, m.player_id, floor(clock_s / 60) AS mb, sum(d_player) - sum(d_tm) AS rt, sum(d_player) - sum(d_op) AS ro, count(*) AS n FROM m JOIN fp USING (match_id, player_id) GROUP BY m.match_id, m.player_id, floor(clock_s / 60), fps HAVING count(*) >= ceil(0.75 * 60 * fps)),
 l AS (SELECT match_id, player_id, mb + 0.5 AS t, 'teammates' AS reference, rt AS r FROM b UNION ALL SELECT match_id, player_id, mb + 0.5, 'opponents', ro FROM b)
SELECT match_id, player_id, t AS t_centre_min, reference, round(r, 7) AS r, round(sum(r) OVER w, 6) AS "C", round(greatest(0, least(1, (sum(r) OVER w + 600) / 1200)), 8) AS "N", round(avg(r) OVER (PARTITION BY match_id, player_id, reference ORDER BY t RANGE BETWEEN 3.500001 PRECEDING AND 3.500001 FOLLOWING), 7) AS ma7 FROM l WINDOW w AS (PARTITION BY match_id, player_id, reference ORDER BY t)""")
def _(spark, d):
    # near rows are per vector; a vector stands for player vec_id % 10 of match frame % 3
    e = em(spark, d).withColumns({"period": F.lit(1), "frameNum": F.col("frame"), "periodGameClockTime": F.col("frame") * 20.0})
    near = jobs.N.k_nearest(e, ["frame"], "vec_id", "team").withColumns(
        {"match_id": F.col("frame") % 3, "player_id": F.col("vec_id") % 10, "period": F.lit(1), "periodGameClockTime": F.col("frame") * 20.0}
    )
    clock = e.select((F.col("frame") % 3).alias("match_id"), (F.col("vec_id") % 10).alias("player_id"), F.col("periodGameClockTime").alias("video_time_s"), F.lit(0).alias("frameNum")).distinct()
    mins = jobs.N.nearest_minutes(near, jobs.N.fps_of(clock, jobs.player_line()), list(jobs.HALF), "periodGameClockTime")
    lead = jobs.W.signed_lead(mins, Line(jobs.HALF, "t_centre_min"), {"d_resid_tm": "teammates", "d_resid_op": "opponents"})
    return rounded(rounded(lead.drop("period"), "r", "ma7", digits=7), "C").withColumn("N", F.round("N", 8))


@query("c05_synergy_windows", f"""
WITH {EV}, s AS (SELECT user_id % 7 AS match_id, user_id AS player_id, period, clock, (0.5 * (greatest(-1, least(1, (value - 50) / 97)) + 1) + 0.5 * (greatest(-1, least(1, (k - 50) * 40 / 1450.0)) + 1)) / 2 AS m FROM ev)
SELECT match_id, player_id, period, round(clock, 4) AS minute, round(m, 9) AS m, {', '.join(f"round(avg(m) OVER (PARTITION BY match_id, player_id, period ORDER BY clock RANGE BETWEEN {w / 2 + 1e-6!r} PRECEDING AND {w / 2 + 1e-6!r} FOLLOWING), 9) AS m_w{w}" for w in (1, 3, 5, 10))} FROM s""")
def _(spark, d):
    e = ev(spark, d).select(
        (F.col("user_id") % 7).alias("match_id"), F.col("user_id").alias("player_id"), "period", F.col("clock_s").alias("game_clock_s"), F.col("clock").alias("minute"),
        ((F.col("value") - 50) * 80 / 97).alias("individual_synergy"), ((F.col("k") - 50) * 40.0).alias("team_synergy"),
    )
    out = jobs.synergy_curve(e, whole=half(spark, d).whole).select("match_id", "player_id", "period", "minute", "m", "m_w1", "m_w3", "m_w5", "m_w10")
    return rounded(rounded(out, "m", "m_w1", "m_w3", "m_w5", "m_w10", digits=9), "minute", digits=4)


@query("c06_standing_norm", f"""
WITH {EV}, t AS (SELECT event_id, vn / 400 - 0.2 AS r, value / 2000 AS v FROM ev)
SELECT event_id, 'standing_position' AS section, round(r, 8) AS trailing_median_5min, CASE WHEN r IS NOT NULL THEN round(least(r + 0.5, 1), 8) END AS trailing_median_5min_norm,
 round(greatest(0, least(1, CASE WHEN v <= 0.0256378650665283 THEN 0.5 * v / 0.0256378650665283 ELSE 0.5 + 0.5 * (v - 0.0256378650665283) / (0.11229975186288345 - 0.0256378650665283) END)), 8) AS worst_vulnerability_5min_norm FROM t""")
def _(spark, d):
    t = ev(spark, d).select("event_id", (F.col("vn") / 400 - 0.2).alias("best_regret_5min"), (F.col("value") / 2000).alias("worst_vulnerability_5min"))
    out = jobs.standing_curve(t).drop("best_regret_5min", "worst_vulnerability_5min")
    return rounded(out, "trailing_median_5min", "trailing_median_5min_norm", "worst_vulnerability_5min_norm", digits=8)


# both labellings: on-ball rows and markers as in the span query, all events as frames
POSS = f"""{span_sql()}, fr AS (SELECT event_id, user_id, clock, CASE WHEN k % 23 <> 0 THEN value END AS ball_x, CASE WHEN k % 19 <> 0 THEN value / 10 END AS d_focal, CASE WHEN k % 13 <> 0 THEN k / 10.0 END AS d_opp, k % 11 AS pf, k % 7 + 20 AS po FROM ev),
 ol AS (SELECT user_id, t0, t1, CASE (event_id % 4) WHEN 0 THEN 'FOCAL' WHEN 1 THEN 'TEAMMATE' ELSE 'OPPONENT' END AS player, event_id % 2 = 0 AS inst FROM otb),
 la AS (SELECT f.*, arg_max(struct_pack(t1 := o.t1, p := o.player), o.t0) AS o FROM fr f LEFT JOIN ol o ON o.user_id = f.user_id AND o.t0 <= f.clock GROUP BY ALL),
 lb AS (SELECT la.*, arg_max(struct_pack(t1 := s.t1, p := s.team_possession), s.t0) AS s FROM la LEFT JOIN spans s ON s.user_id = la.user_id AND s.t0 <= la.clock GROUP BY ALL),
 lc AS (SELECT *, CASE WHEN clock < o.t1 THEN o.p ELSE 'NONE' END AS player_a, CASE WHEN clock < s.t1 THEN s.p ELSE 'UNRESOLVED' END AS team_a FROM lb),
 ld AS (SELECT *, ball_x IS NOT NULL AND coalesce(d_focal < 2.5, false) AS fi, ball_x IS NOT NULL AND coalesce(d_opp < 2.5, false) AS oi FROM lc),
 le AS (SELECT *, CASE WHEN team_a = 'DEAD' THEN 'DEAD' WHEN fi <> oi THEN CASE WHEN fi THEN 'FOCAL' ELSE 'OPP' END END AS hold FROM ld),
 lf AS (SELECT *, count(hold) OVER (PARTITION BY user_id ORDER BY clock, event_id) AS sg2 FROM le),
 lg AS (SELECT *, max(hold) OVER (PARTITION BY user_id, sg2) AS held, arg_min(team_a, clock) FILTER (WHERE hold IS NULL AND team_a IN ('FOCAL', 'OPP')) OVER (PARTITION BY user_id, sg2 ORDER BY clock, event_id) AS stuck FROM lf)"""


def possession(spark, d):
    e, k = ev(spark, d), F.col("k")
    i = F.col("event_id")
    lab = F.when(i % 4 == 0, "FOCAL").when(i % 4 == 1, "TEAMMATE").otherwise("OPPONENT")
    o = otb(spark, d).withColumns({"player_otb": lab, "is_instant": i % 2 == 0})
    fr = e.select(
        "event_id", "user_id", "clock", F.when(k % 23 != 0, F.col("value")).alias("ball_x"), k.cast("double").alias("ball_y"), F.when(k % 19 != 0, F.col("value") / 10).alias("d_focal"),
        F.when(k % 13 != 0, k / 10.0).alias("d_opp"), (k % 11).alias("player_id_focal_nearest"), (k % 7 + 20).alias("player_id_opp_nearest"),
    )
    return jobs.possession(o, dead(spark, d), fr, ("user_id",), radius=2.5, focal_player=F.lit(3), time="clock", ident="event_id", frame="event_id", whole=user(spark, d).whole)


@query("e16_possession_both", f"""
WITH {EV}, {POSS} SELECT event_id, player_a, team_a, CASE WHEN hold IS NOT NULL THEN hold WHEN held IN ('FOCAL', 'OPP') THEN held WHEN stuck IS NOT NULL THEN stuck WHEN team_a = 'DEAD' THEN 'DEAD' ELSE 'UNRESOLVED' END AS team_b FROM lg""")
def _(spark, d):
    return possession(spark, d).select("event_id", "player_a", "team_a", "team_b")


@query("c07_possession", f"""
WITH {EV}, {POSS}, lh AS (SELECT user_id, team_a, CASE WHEN hold IS NOT NULL THEN hold WHEN held IN ('FOCAL', 'OPP') THEN held WHEN stuck IS NOT NULL THEN stuck WHEN team_a = 'DEAD' THEN 'DEAD' ELSE 'UNRESOLVED' END AS team_b FROM lg)
SELECT user_id, team_a, team_b, count(*) AS n_frames FROM lh GROUP BY ALL""")
def _(spark, d):
    """Frames per pair of labels, the basis of shares and agreement per match."""
    return possession(spark, d).groupBy("user_id", "team_a", "team_b").agg(F.count("*").alias("n_frames"))


def report(spark, d):
    return jobs.player_report(panel(spark, d), whole=whole(spark), min_frames=2, win=6.0, step=4.0)


RG = f"{PANEL}, {grid_sql('user_id, period', 'panel', 'clock', '6.0::DOUBLE', '4.0::DOUBLE')}"


@query("c10_report_windows", f"""
WITH {RG} SELECT user_id % 7 AS match_id, user_id AS player_id, period, t0 + 3 AS t_centre, round(max(speed), 6) AS max_speed, round(max(acc_use), 6) AS max_acc_use, round(max(jerk_use), 6) AS max_jerk_use, round(coalesce(sum(step_dist), 0), 5) AS window_distance FROM inw GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, d):
    t = report(spark, d)
    out = t["peaks"].join(t["distance"], [*jobs.HALF, "t_centre"])
    return rounded(rounded(out, "max_speed", "max_acc_use", "max_jerk_use"), "window_distance", digits=5)


@query("c10_report_seconds", f"""
WITH {PANEL} SELECT user_id % 7 AS match_id, user_id AS player_id, period, floor(clock_s)::BIGINT AS time_bin, round(avg(speed), 7) AS speed, round(avg(acc_use), 7) AS acc_use, round(coalesce(sum(step_dist), 0), 6) AS distance_1s, count(speed) AS n_frames FROM panel GROUP BY user_id, period, floor(clock_s)""")
def _(spark, d):
    out = report(spark, d)["seconds"].drop("periodGameClockTime", "jerk_use")
    return rounded(rounded(out, "speed", "acc_use", digits=7), "distance_1s")
