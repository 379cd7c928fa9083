"""Interval labels, band joins and neighbours over `events` and `embeddings`."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins as J, nearest as N, possession as P
from ..operators.ordered import Line
from .base import EV, ev, query, rounded, table, user


SIGN = """iv AS (SELECT user_id, clock AS t0, clock + value / 20 AS t1, k AS tag FROM ev WHERE event_type = 'signup'),
 pt AS (SELECT event_id, user_id, clock FROM ev WHERE event_type <> 'signup')"""


@query("j01_as_of_label", f"""
WITH {EV}, {SIGN}, h AS (SELECT p.event_id, p.clock, arg_max(i.t1, i.t0) AS t1, arg_max(i.tag, i.t0) AS tag FROM pt p LEFT JOIN iv i ON i.user_id = p.user_id AND i.t0 <= p.clock GROUP BY ALL)
SELECT event_id, CASE WHEN clock < t1 THEN tag ELSE -1 END AS tag FROM h""")
def _(spark, d):
    e = ev(spark, d)
    iv = e.where(F.col("event_type") == "signup").select("user_id", F.col("clock").alias("t0"), (F.col("clock") + F.col("value") / 20).alias("t1"), F.col("k").alias("tag"))
    pts = e.where(F.col("event_type") != "signup").select("event_id", "user_id", "clock")
    return J.as_of_label(pts, iv, ["user_id"], "clock", "t0", "t1", {"tag": -1}, whole=user(spark, d).whole).select("event_id", "tag")


@query("j02_as_of_frames", f"""
WITH {EV}, iv AS (SELECT user_id, floor(clock_s) AS f0, floor(clock_s) + k AS f1 FROM ev WHERE event_type = 'signup'), pt AS (SELECT event_id, user_id, floor(clock_s) AS f FROM ev WHERE event_type <> 'signup'),
 h AS (SELECT p.event_id, p.f, max(struct_pack(a := i.f0, b := i.f1)) AS m FROM pt p LEFT JOIN iv i ON i.user_id = p.user_id AND i.f0 <= p.f GROUP BY ALL)
SELECT event_id, CASE WHEN f <= m.b THEN m.b ELSE -1 END::BIGINT AS f1 FROM h""")
def _(spark, d):
    e = ev(spark, d).withColumn("f", F.floor("clock_s"))
    iv = e.where(F.col("event_type") == "signup").select("user_id", F.col("f").alias("f0"), (F.col("f") + F.col("k")).alias("f1"))
    pts = e.where(F.col("event_type") != "signup").select("event_id", "user_id", "f")
    return J.as_of_label(pts, iv, ["user_id"], "f", "f0", "f1", {"f1": -1}, whole=user(spark, d).whole, closed=True).select("event_id", "f1")


LAB = """ob AS (SELECT user_id, clock AS t0, clock + 0.5 + k / 40.0 AS t1, k % 3 = 0 AS is_instant, CASE WHEN k % 11 = 3 THEN 'FOCAL' WHEN k % 2 = 1 THEN 'TEAMMATE' ELSE 'OPPONENT' END AS player_otb FROM ev WHERE event_type = 'view'),
 sp AS (SELECT user_id, clock AS t0, clock + 1 + value / 30 AS t1, CASE k % 3 WHEN 0 THEN 'FOCAL' WHEN 1 THEN 'OPP' ELSE 'DEAD' END AS team FROM ev WHERE event_type = 'purchase'),
 pt AS (SELECT event_id, user_id, clock FROM ev WHERE event_type NOT IN ('view', 'purchase'))"""


@query("j03_label_frames", f"""
WITH {EV}, {LAB}, a AS (SELECT p.event_id, p.user_id, p.clock, arg_max(o.t1, o.t0) AS o1, arg_max(o.player_otb, o.t0) AS pl, arg_max(o.is_instant, o.t0) AS ins FROM pt p LEFT JOIN ob o ON o.user_id = p.user_id AND o.t0 <= p.clock GROUP BY ALL),
 b AS (SELECT a.*, arg_max(s.t1, s.t0) AS s1, arg_max(s.team, s.t0) AS tm FROM a LEFT JOIN sp s ON s.user_id = a.user_id AND s.t0 <= a.clock GROUP BY ALL),
 c AS (SELECT event_id, CASE WHEN clock < o1 THEN pl ELSE 'NONE' END AS player_otb, CASE WHEN clock < o1 THEN ins ELSE false END AS is_instant, CASE WHEN clock < s1 THEN tm ELSE 'UNRESOLVED' END AS team_possession FROM b)
SELECT *, CASE team_possession WHEN 'DEAD' THEN 'BALL_OUT_OR_DEAD' WHEN 'OPP' THEN 'OPPOSITION_POSSESSION' WHEN 'FOCAL' THEN CASE WHEN player_otb = 'FOCAL' THEN 'PLAYER_ON_BALL' ELSE 'TEAM_POSSESSION_OFF_BALL' END ELSE 'UNRESOLVED' END AS possession_context FROM c""")
def _(spark, d):
    e, k = ev(spark, d), F.col("k")
    lab = S.player_label(k % 11, k % 2, F.lit(3), F.lit(1))
    otb = e.where(F.col("event_type") == "view").select("user_id", F.col("clock").alias("t0"), (F.col("clock") + 0.5 + k / 40.0).alias("t1"), (k % 3 == 0).alias("is_instant"), lab.alias("player_otb"))
    team = F.when(k % 3 == 0, "FOCAL").when(k % 3 == 1, "OPP").otherwise("DEAD")
    spans = e.where(F.col("event_type") == "purchase").select("user_id", F.col("clock").alias("t0"), (F.col("clock") + 1 + F.col("value") / 30).alias("t1"), team.alias("team_possession"))
    pts = e.where(~F.col("event_type").isin("view", "purchase")).select("event_id", "user_id", "clock")
    return P.label_frames(pts, otb, spans, ["user_id"], time="clock", whole=user(spark, d).whole).drop("user_id", "clock")


@query("j04_enrich_intervals", f"""
WITH {EV}, ix AS (SELECT user_id, k, arg_min(clock_s, clock_s) AS f0, arg_min(value, clock_s) AS f1, arg_min(event_type, clock_s) AS hb, arg_min(vn, clock_s) AS sq FROM (SELECT * REPLACE (coalesce(vn, -1) AS vn) FROM ev) WHERE event_type <> 'view' GROUP BY ALL)
SELECT e.event_id, round(f0, 3) AS frame0, f1 AS frame1, hb AS home_ball, coalesce(CASE WHEN e.k % 3 = 0 THEN e.k::DOUBLE END, sq) AS sequence FROM ev e LEFT JOIN ix ON e.user_id = ix.user_id AND e.k = ix.k WHERE e.event_type = 'view'""")
def _(spark, d):
    e = ev(spark, d)
    otb = e.where(F.col("event_type") == "view").select("event_id", "user_id", "k", F.when(F.col("k") % 3 == 0, F.col("k").cast("double")).alias("sequence"))
    ix = e.where(F.col("event_type") != "view").select(
        "user_id", "k", F.col("clock_s").alias("frame0"), F.col("value").alias("frame1"), F.col("event_type").alias("home_ball"), F.coalesce("vn", F.lit(-1.0)).alias("sequence_tracking")
    )
    out = J.enrich_intervals(otb, ix, ["user_id"], "k").select("event_id", "frame0", "frame1", "home_ball", "sequence")
    return rounded(out, "frame0", digits=3)


EM = """em AS (SELECT vec_id, vec_id // 20 AS frame, label % 2 AS team, embedding[1]::DOUBLE * 50 AS x, embedding[2]::DOUBLE * 50 AS y, CASE WHEN vec_id % 17 <> 0 THEN abs(embedding[3]::DOUBLE) * 10 END AS speed, abs(embedding[4]::DOUBLE) AS step_dist FROM embeddings)"""


def em(spark, d):
    def at(i):
        return F.get("embedding", i).cast("double")

    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        "vec_id", F.floor(v / 20).alias("frame"), (F.col("label") % 2).alias("team"), (at(0) * 50).alias("x"), (at(1) * 50).alias("y"),
        F.when(v % 17 != 0, F.abs(at(2)) * 10).alias("speed"), F.abs(at(3)).alias("step_dist"), "label",
    )


NEAR_SQL = EM + """, ok AS (SELECT * FROM em WHERE speed IS NOT NULL),
 pr AS (SELECT a.frame, a.vec_id, a.team, a.speed AS s_player, a.step_dist AS d_player, b.speed AS s, b.step_dist AS dd, (a.team = b.team)::INT AS same, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM ok a JOIN ok b ON a.frame = b.frame AND a.vec_id <> b.vec_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id, same ORDER BY dist) AS r FROM pr),
 near AS (SELECT frame, vec_id, team, s_player, d_player, avg(CASE WHEN same = 1 THEN s END) AS s_tm, avg(CASE WHEN same = 0 THEN s END) AS s_op, avg(CASE WHEN same = 1 THEN dd END) AS d_tm, avg(CASE WHEN same = 0 THEN dd END) AS d_op,
   min(CASE WHEN same = 1 THEN dist END) AS dist_tm, min(CASE WHEN same = 0 THEN dist END) AS dist_op FROM rk WHERE r <= 2 GROUP BY ALL HAVING count(*) = 4)"""


@query("j05_k_nearest", f"WITH {NEAR_SQL} SELECT frame, vec_id, team, round(s_player, 6) AS s_player, round(d_player, 6) AS d_player, round(s_tm, 6) AS s_tm, round(s_op, 6) AS s_op, round(d_tm, 6) AS d_tm, round(d_op, 6) AS d_op, round(dist_tm, 6) AS dist_tm, round(dist_op, 6) AS dist_op FROM near")
def _(spark, d):
    out = N.k_nearest(em(spark, d), ["frame"], "vec_id", "team")
    return rounded(out, "s_player", "d_player", "s_tm", "s_op", "d_tm", "d_op", "dist_tm", "dist_op")


@query("w12_nearest_minutes", f"""
WITH {NEAR_SQL}, m AS (SELECT *, vec_id % 10 AS player, frame * 20 AS clock_s FROM near),
 g AS (SELECT player, 1.0 / 20 AS fps FROM m GROUP BY ALL),
 b AS (SELECT player, floor(clock_s / 60.0) AS minute_bin, avg(s_player) AS s_player, avg(s_tm) AS s_tm, avg(s_op) AS s_op, sum(d_player) AS d_player, sum(d_tm) AS d_tm, sum(d_op) AS d_op, count(*) AS n_frames FROM m GROUP BY ALL HAVING count(*) >= ceil(0.75 * 60 / 20))
SELECT player, minute_bin, minute_bin + 0.5 AS t_centre_min, round(s_player, 7) AS s_player, round(s_tm, 7) AS s_tm, round(s_op, 7) AS s_op, round(d_player, 7) AS d_player, round(d_tm, 7) AS d_tm, round(d_op, 7) AS d_op,
 round(s_player - s_tm, 7) AS s_resid_tm, round(s_player - s_op, 7) AS s_resid_op, round(d_player - d_tm, 7) AS d_resid_tm, round(d_player - d_op, 7) AS d_resid_op, n_frames, round(n_frames / 3.0, 6) AS coverage FROM b""")
def _(spark, d):
    near = N.k_nearest(em(spark, d), ["frame"], "vec_id", "team")
    near = near.withColumns({"player": F.col("vec_id") % 10, "clock_s": (F.col("frame") * 20).cast("double")})
    fps = N.fps_of(near.select("player", "clock_s").distinct(), Line(("player",), "clock_s", ()))
    out = N.nearest_minutes(near, fps, ["player"], "clock_s")
    return rounded(rounded(out, *[c for c in out.columns if c[:2] in ("s_", "d_")], digits=7), "coverage")


@query("j06_nearest_to_ball", f"""
WITH {EM}, ball AS (SELECT frame, max(CASE WHEN vec_id % 20 = 0 THEN x END) AS bx, max(CASE WHEN vec_id % 20 = 0 AND frame % 7 <> 0 THEN y END) AS b_y FROM em GROUP BY ALL),
 dd AS (SELECT em.frame, em.vec_id, em.team, sqrt(power(x - bx, 2) + power(y - b_y, 2)) AS d FROM em JOIN ball ON em.frame = ball.frame WHERE vec_id % 20 <> 0),
 g AS (SELECT frame, min(CASE WHEN team = 0 THEN d END) AS d_home, arg_min(vec_id, d) FILTER (WHERE team = 0) AS j_home, min(CASE WHEN team = 1 THEN d END) AS d_away, arg_min(vec_id, d) FILTER (WHERE team = 1) AS j_away FROM dd GROUP BY ALL)
SELECT frame, round(d_home, 6) AS d_focal, round(d_away, 6) AS d_opp, j_home::VARCHAR AS jersey_focal, j_away::VARCHAR AS jersey_opp, round(least(d_home, d_away), 6) AS d_min,
 CASE WHEN d_home IS NULL AND d_away IS NULL THEN NULL WHEN d_away IS NULL OR d_home <= d_away THEN 'FOCAL' ELSE 'OPP' END AS nearest_side FROM g""")
def _(spark, d):
    e, v = em(spark, d), F.col("vec_id")
    p = F.struct(v.cast("string").alias("jerseyNum"), "x", "y")

    def side(t):
        return F.array_sort(F.collect_list(F.when((v % 20 != 0) & (F.col("team") == t), p)))

    # one frame has at most 20 vectors
    frames = e.groupBy("frame").agg(
        side(0).alias("home"), side(1).alias("away"), F.max(F.when(v % 20 == 0, F.col("x"))).alias("bx"),
        F.max(F.when((v % 20 == 0) & (F.col("frame") % 7 != 0), F.col("y"))).alias("by"),
    )
    near = {s: N.nearest_to_ball(F.col(s), F.col("bx"), F.col("by")) for s in ("home", "away")}
    geo = frames.withColumns(near).select(
        "frame", *[F.col(f"{s}.{a}").alias(f"{b}_{s}") for s in near for a, b in (("d", "d"), ("jersey", "jersey"))]
    )
    out = N.team_distances(geo, F.lit(True)).select("frame", "d_focal", "d_opp", "jersey_focal", "jersey_opp", "d_min", "nearest_side")
    return rounded(out, "d_focal", "d_opp", "d_min")


@query("j07_actor_ball_distance", f"""
WITH {EV}, p AS (SELECT event_id, user_id, clock AS t FROM ev WHERE event_type = 'purchase'), f AS (SELECT user_id, clock AS ft, CASE WHEN k % 9 <> 0 THEN k / 10.0 END AS d, k % 2 = 0 AS v FROM ev WHERE event_type <> 'purchase'),
 r AS (SELECT p.event_id, p.user_id, ft, d, v, ft - t AS dt, row_number() OVER (PARTITION BY p.event_id ORDER BY NOT v, d, abs(ft - t)) AS rn FROM p JOIN f ON p.user_id = f.user_id AND ft BETWEEN t - 1.5 AND t + 1.5 WHERE d IS NOT NULL)
SELECT user_id, event_id, round(ft, 4) AS t_frame, d AS dist_m, round(dt, 6) AS dt_s, v AS ball_visible FROM r WHERE rn = 1""")
def _(spark, d):
    e, k = ev(spark, d), F.col("k")
    p = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", F.col("clock").alias("t"))
    f = e.where(F.col("event_type") != "purchase").select("user_id", F.col("clock").alias("ft"), F.when(k % 9 != 0, k / 10.0).alias("d"), (k % 2 == 0).alias("v"))
    out = J.actor_ball_distance(p, f, ["user_id"], "event_id", "t", "ft", distance="d", visible="v", sync=1.5)
    return rounded(rounded(out, "dt_s"), "t_frame", digits=4)


@query("j08_pass_handoff", f"""
WITH {EV}, p AS (SELECT event_id, user_id, clock AS t, (k + event_id) % 5 AS receiver FROM ev WHERE event_type = 'view'), o AS (SELECT user_id, clock AS t0, k % 5 AS pl FROM ev WHERE event_type <> 'view'),
 r AS (SELECT p.event_id, pl, t0 - t AS gap, pl = receiver AS m, row_number() OVER (PARTITION BY p.event_id ORDER BY pl <> receiver, t0) AS rn FROM p JOIN o ON p.user_id = o.user_id AND t0 >= t - 1e-6 AND t0 <= t + 5)
SELECT p.event_id, p.receiver, r.pl AS next_player, round(r.gap, 6) AS gap_s, coalesce(r.m, false) AS receiver_match FROM p LEFT JOIN r ON p.event_id = r.event_id AND rn = 1""")
def _(spark, d):
    e, k = ev(spark, d), F.col("k")
    p = e.where(F.col("event_type") == "view").select("event_id", "user_id", F.col("clock").alias("t"), ((k + F.col("event_id")) % 5).alias("receiver"))
    o = e.where(F.col("event_type") != "view").select("user_id", F.col("clock").alias("t0"), (k % 5).alias("pl"))
    out = J.pass_handoffs(p, o, ["user_id"], "event_id", "t", "receiver", "t0", "pl")
    return rounded(out.select("event_id", "receiver", "next_player", "gap_s", "receiver_match"), "gap_s")


@query("j09_instant_recovery", f"""
WITH {EV}, p AS (SELECT event_id, user_id, clock AS t, k AS pk FROM ev WHERE event_type = 'purchase'), f AS (SELECT user_id, clock AS ft, k AS fk, value FROM ev),
 j AS (SELECT p.event_id, p.user_id, t, ft, CASE WHEN fk % 3 <> pk % 3 THEN value / 20 END AS dd FROM p JOIN f ON p.user_id = f.user_id AND ft BETWEEN t - 3 AND t + 3),
 i AS (SELECT *, coalesce(dd < 2.5, false) AS ins, row_number() OVER (PARTITION BY event_id ORDER BY ft) - row_number() OVER (PARTITION BY event_id, coalesce(dd < 2.5, false) ORDER BY ft) AS grp FROM j),
 runs AS (SELECT event_id, user_id, t, ins, grp, min(ft) AS t0, max(ft) AS t1, count(*) AS n, min(dd) AS dm, min(abs(ft - t)) AS near FROM i GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY NOT ins, near) AS rn, min(dm) OVER (PARTITION BY event_id) AS anyd FROM runs)
SELECT user_id, event_id, round(t, 4) AS t_event, ins AS recovered, CASE WHEN ins THEN round(t0, 4) END AS t0, CASE WHEN ins THEN round(t1, 4) END AS t1, CASE WHEN ins THEN n ELSE 0 END AS n_frames, round(CASE WHEN ins THEN dm ELSE anyd END, 6) AS min_dist FROM b WHERE rn = 1""")
def _(spark, d):
    e = ev(spark, d)
    p = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", F.col("clock").alias("t"), F.col("k").alias("pk"))
    f = e.select("user_id", F.col("clock").alias("ft"), F.col("k").alias("fk"), "value")
    dist = F.when(F.col("fk") % 3 != F.col("pk") % 3, F.col("value") / 20)
    out = J.instant_recovery(p, f, ["user_id"], "event_id", "t", "ft", dist, 2.5, 3.0)
    return rounded(rounded(out, "min_dist"), "t_event", "t0", "t1", digits=4)


@query("j10_attach_frame_labels", f"""
WITH {EV}, r AS (SELECT user_id, k, arg_min(event_type, event_id) AS ball_state, arg_min(value, event_id) AS d_min FROM ev WHERE event_type <> 'view' GROUP BY ALL)
SELECT e.event_id, r.ball_state, r.d_min FROM ev e LEFT JOIN r ON e.user_id = r.user_id AND e.k = r.k WHERE e.event_type = 'view'""")
def _(spark, d):
    e = ev(spark, d)
    right = e.where(F.col("event_type") != "view").select("user_id", "k", "event_id", F.col("event_type").alias("ball_state"), F.col("value").alias("d_min"))
    left = e.where(F.col("event_type") == "view").select("event_id", "user_id", "k")
    return J.attach_once(left, right, ["user_id", "k"], ["ball_state", "d_min"], order=["event_id"]).select("event_id", "ball_state", "d_min")


@query("j11_complete_panel", f"""
WITH {EV}, a AS (SELECT user_id, period, k, min(event_id) AS event_id, arg_min(value, event_id) AS speed FROM ev WHERE event_type <> 'click' GROUP BY ALL), b AS (SELECT user_id, period, k, arg_min(value, event_id) AS x, arg_min(m, event_id) AS y FROM ev WHERE event_type = 'click' GROUP BY ALL)
SELECT a.user_id, a.period, a.k, a.event_id, a.speed, b.x, round(b.y, 5) AS y FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.period = b.period AND a.k = b.k""")
def _(spark, d):
    e = ev(spark, d)
    kin = e.where(F.col("event_type") != "click").select("user_id", "period", "k", "event_id", F.col("value").alias("speed"))
    xy = e.where(F.col("event_type") == "click").select("user_id", "period", "k", "event_id", F.col("value").alias("x"), F.col("m").alias("y"))
    return rounded(J.complete_panel(kin, xy, ["user_id", "period", "k"], ["event_id"]), "y", digits=5)


@query("j12_nearest_is_actor", f"""
WITH {EV}, p AS (SELECT event_id, user_id, clock AS t, k % 5 AS actor FROM ev WHERE event_type = 'purchase' AND k % 7 <> 0), f AS (SELECT user_id, clock AS ft, k % 5 AS near FROM ev WHERE event_type <> 'purchase'),
 r AS (SELECT p.event_id, actor, near, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(ft - t), ft) AS rn FROM p LEFT JOIN f ON p.user_id = f.user_id)
SELECT count(*) AS n_events, round(avg(coalesce(near = actor, false)::INT), 8) AS p_nearest_is_actor FROM r WHERE rn = 1""")
def _(spark, d):
    e, k = ev(spark, d), F.col("k")
    p = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", F.col("clock").alias("t"), F.when(k % 7 != 0, k % 5).alias("actor"))
    f = e.where(F.col("event_type") != "purchase").select("user_id", F.col("clock").alias("ft"), (k % 5).alias("near"))
    return rounded(J.nearest_is_actor(p, f, ["user_id"], "t", "ft", "actor", "near", whole=user(spark, d).whole), "p_nearest_is_actor", digits=8)
