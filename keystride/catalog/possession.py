"""Possession operators over `events`: one user is one match, on-ball rows are its non-error events."""

from pyspark.sql import functions as F

from ..operators import possession as P
from .base import EV, ev, query, rounded, user

M = ["user_id"]

RAW = EV + """, raw AS (SELECT user_id, event_id, k % 40 AS gid, clock AS st, clock + (k % 4) * 0.2 AS en, CASE WHEN k % 3 = 0 THEN (k % 4) * 0.2 END AS du, CASE WHEN k % 13 <> 0 THEN k % 11 END AS pl, CASE WHEN k % 7 <> 0 THEN k % 2 END AS tm, CASE WHEN k % 5 <> 0 THEN k // 25 END AS sq, period, CASE WHEN event_type <> 'click' THEN event_type END AS ty FROM ev WHERE event_type <> 'error')"""


def raw(spark, d):
    k = F.col("k")
    return ev(spark, d).where(F.col("event_type") != "error").select(
        "user_id", "event_id", (k % 40).alias("gid"), F.col("clock").alias("startTime"), (F.col("clock") + (k % 4) * 0.2).alias("endTime"),
        F.when(k % 3 == 0, (k % 4) * 0.2).alias("duration"), F.when(k % 13 != 0, k % 11).alias("player_id"), F.when(k % 7 != 0, k % 2).alias("team_id"),
        F.when(k % 5 != 0, F.floor(k / 25)).alias("sequence"), "period", F.when(F.col("event_type") != "click", F.col("event_type")).alias("poss_type"),
    )


@query("e11_on_ball_intervals", f"""
WITH {RAW}, ty AS (SELECT user_id, gid, string_agg(ty, ',' ORDER BY o) AS poss_types FROM (SELECT user_id, gid, ty, min(event_id) AS o FROM raw WHERE ty IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 g AS (SELECT user_id, gid, min(st) AS t0, max(en) AS t1, coalesce(max(du), max(en) - min(st)) AS duration, arg_min(pl, event_id) AS player_id, arg_min(tm, event_id) AS team_id, arg_min(sq, event_id) AS sequence, arg_min(period, event_id) AS period, count(*) AS n_rows FROM raw GROUP BY ALL),
 h AS (SELECT *, duration <= 0 OR t1 - t0 <= 0 AS is_instant FROM g)
SELECT h.user_id, h.gid, round(t0, 4) AS t0, round(CASE WHEN is_instant THEN t0 + 1 / 29.97 ELSE t1 END, 4) AS t1, round(duration, 4) AS duration, player_id, team_id, sequence::BIGINT AS sequence, period, n_rows, is_instant, coalesce(poss_types, '') AS poss_types
FROM h LEFT JOIN ty ON h.user_id = ty.user_id AND h.gid = ty.gid""")
def _(spark, d):
    return rounded(P.on_ball_intervals(raw(spark, d), M, "gid", "event_id"), "t0", "t1", "duration", digits=4)


DEAD = "dead AS (SELECT user_id, coalesce(CASE WHEN k % 3 <> 0 THEN clock END, clock - 0.01) AS td FROM ev WHERE event_type = 'error' AND k % 4 <> 3)"


def dead(spark, d):
    k = F.col("k")
    e = ev(spark, d).where(F.col("event_type") == "error").select(
        "user_id", F.when(k % 4 == 3, "FOUL").when(k % 4 == 0, "END").otherwise("OUT").alias("event_kind"),
        F.when(k % 3 != 0, F.col("clock")).alias("eventTime"), (F.col("clock") - 0.01).alias("startTime"),
    )
    return P.dead_markers(e, M)


@query("e12_dead_markers", f"WITH {EV}, {DEAD} SELECT user_id, round(td, 4) AS t_dead FROM dead")
def _(spark, d):
    return rounded(dead(spark, d), "t_dead", digits=4)


# on-ball intervals with a resolved team: 0 opponent, 1 focal, unresolved now and then
OTB = """otb AS (SELECT user_id, event_id, clock AS t0, clock + 0.1 + value / 400 AS t1, CASE WHEN k % 17 = 0 THEN 'UNRESOLVED' WHEN k % 10 < 7 THEN 'FOCAL' ELSE 'OPP' END AS label, CASE WHEN k % 6 <> 0 THEN k // 50 END AS seq FROM ev WHERE event_type <> 'error')"""


def otb(spark, d):
    k = F.col("k")
    return ev(spark, d).where(F.col("event_type") != "error").select(
        "user_id", "event_id", F.col("clock").alias("t0"), (F.col("clock") + 0.1 + F.col("value") / 400).alias("t1"),
        F.when(k % 17 == 0, "UNRESOLVED").when(k % 10 < 7, "FOCAL").otherwise("OPP").alias("label"),
        F.when(k % 6 != 0, F.floor(k / 50)).alias("sequence"), F.lit("team_id").alias("how"),
    )


def span_sql() -> str:
    w = "(PARTITION BY user_id ORDER BY t0, event_id)"
    return f"""{DEAD}, {OTB},
 a1 AS (SELECT o.*, (SELECT max(td) FROM dead x WHERE x.user_id = o.user_id AND x.td < o.t0) AS lm, (SELECT min(td) FROM dead x WHERE x.user_id = o.user_id AND x.td > o.t0) AS nm FROM otb o),
 a2 AS (SELECT *, lag(t0) OVER {w} AS pt0, lag(label) OVER {w} AS pl FROM a1),
 a3 AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> label OR lm > pt0 THEN 1 ELSE 0 END) OVER {w} AS h FROM a2),
 a4 AS (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY user_id, h ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM a3),
 a5 AS (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY t0, event_id) = 1 OR coalesce(ps <> seq, false) AS st FROM a4),
 a6 AS (SELECT *, sum(st::INT) OVER {w} AS sp FROM a5),
 b1 AS (SELECT user_id, sp, min(t0) AS t0, arg_min(label, t0) AS label, arg_max(t1, t0) AS lt1, arg_max(nm, t0) AS nm FROM a6 GROUP BY ALL),
 b2 AS (SELECT b1.*, lead(t0) OVER (PARTITION BY user_id ORDER BY sp) AS nt0, lead(label) OVER (PARTITION BY user_id ORDER BY sp) AS nl, tend FROM b1 JOIN (SELECT user_id, max(t1) AS tend FROM otb GROUP BY ALL) USING (user_id)),
 b3 AS (SELECT *, coalesce(nt0, tend) AS upto, coalesce(nm < coalesce(nt0, tend), false) AS died FROM b2),
 c1 AS (SELECT user_id, t0, CASE WHEN died THEN nm WHEN nl IS NULL OR nl <> label THEN upto ELSE least(lt1, nt0) END AS t1, label, 'otb_start:team_id' AS reason FROM b3 UNION ALL SELECT user_id, nm, upto, 'DEAD', 'after_out_or_end' FROM b3 WHERE died),
 c2 AS (SELECT *, lag(t1) OVER (PARTITION BY user_id ORDER BY t0, t1) AS q1, lag(label) OVER (PARTITION BY user_id ORDER BY t0, t1) AS ql FROM c1 WHERE t1 > t0),
 c3 AS (SELECT *, sum(CASE WHEN ql = label AND abs(t0 - q1) < 1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t0, t1) AS id FROM c2),
 spans AS (SELECT user_id, min(t0) AS t0, max(t1) AS t1, any_value(label) AS team_possession, arg_min(reason, t0) AS reason FROM c3 GROUP BY user_id, id)"""


@query("e13_possession_spans", f"WITH {EV}, {span_sql()} SELECT user_id, round(t0, 4) AS t0, round(t1, 4) AS t1, team_possession, reason FROM spans")
def _(spark, d):
    return rounded(P.possession_spans(otb(spark, d), dead(spark, d), M, "event_id", whole=user(spark, d).whole), "t0", "t1", digits=4)


GEO = """geo AS (SELECT event_id, user_id, clock, CASE WHEN k % 23 <> 0 THEN value END AS ball_x, k::DOUBLE AS ball_y, CASE WHEN k % 19 <> 0 THEN value / 10 END AS d_focal, CASE WHEN k % 13 <> 0 THEN k / 10.0 END AS d_opp, k % 11 AS pf, k % 7 + 20 AS po, event_type = 'error' AS event_dead,
  CASE k % 6 WHEN 0 THEN 'FOCAL' WHEN 1 THEN 'OPP' WHEN 2 THEN 'DEAD' ELSE 'UNRESOLVED' END AS fallback FROM ev),
 z1 AS (SELECT *, ball_x IS NOT NULL AND coalesce(d_focal < 2.5, false) AS fi, ball_x IS NOT NULL AND coalesce(d_opp < 2.5, false) AS oi FROM geo),
 z2 AS (SELECT *, ball_x IS NOT NULL AND coalesce(d_focal < 2.0 AND d_opp < 2.0, false) AS duel FROM z1),
 z3 AS (SELECT *, CASE WHEN duel THEN 'DUEL' WHEN fi OR oi THEN 'CONTROL' ELSE 'FREE' END AS bs FROM z2),
 zone AS (SELECT *, CASE WHEN bs = 'CONTROL' THEN CASE WHEN fi AND (NOT oi OR d_focal <= d_opp) THEN 'FOCAL' ELSE 'OPP' END END AS ct FROM z3)"""


def geo(spark, d):
    k = F.col("k")
    return ev(spark, d).select(
        "event_id", "user_id", "clock", F.when(k % 23 != 0, F.col("value")).alias("ball_x"), k.cast("double").alias("ball_y"),
        F.when(k % 19 != 0, F.col("value") / 10).alias("d_focal"), F.when(k % 13 != 0, k / 10.0).alias("d_opp"),
        (k % 11).alias("player_id_focal_nearest"), (k % 7 + 20).alias("player_id_opp_nearest"), (F.col("event_type") == "error").alias("event_dead"),
        F.when(k % 6 == 0, "FOCAL").when(k % 6 == 1, "OPP").when(k % 6 == 2, "DEAD").otherwise("UNRESOLVED").alias("fallback"),
    )


@query("e14_zone_states", f"WITH {EV}, {GEO} SELECT event_id, bs AS ball_state, ct AS control_team, CASE ct WHEN 'FOCAL' THEN pf WHEN 'OPP' THEN po END AS control_player_id FROM zone")
def _(spark, d):
    return P.zone_states(geo(spark, d), 2.5, 2.0).select("event_id", "ball_state", "control_team", "control_player_id")


CARRY = f"""{GEO}, y1 AS (SELECT *, CASE WHEN event_dead THEN 'DEAD' ELSE ct END AS s, CASE WHEN event_dead THEN 'DEAD' ELSE bs END AS ball_state FROM zone),
 y2 AS (SELECT *, count(s) OVER (PARTITION BY user_id ORDER BY clock, event_id) AS seg FROM y1),
 y3 AS (SELECT *, max(s) OVER (PARTITION BY user_id, seg) AS held, arg_min(fallback, clock) FILTER (WHERE s IS NULL AND fallback IN ('FOCAL', 'OPP')) OVER (PARTITION BY user_id, seg ORDER BY clock, event_id) AS stuck FROM y2),
 y4 AS (SELECT *, CASE WHEN s IS NOT NULL THEN s WHEN held IN ('FOCAL', 'OPP') THEN held WHEN stuck IS NOT NULL THEN stuck WHEN fallback = 'DEAD' THEN 'DEAD' ELSE 'UNRESOLVED' END AS team_possession,
   CASE ball_state WHEN 'DUEL' THEN 'DUEL' WHEN 'CONTROL' THEN CASE WHEN ct = 'FOCAL' THEN CASE WHEN pf = 3 THEN 'FOCAL' ELSE 'TEAMMATE' END ELSE 'OPPONENT' END ELSE 'NONE' END AS player_otb FROM y3),
 carried AS (SELECT event_id, user_id, clock, ball_state, team_possession, player_otb, CASE team_possession WHEN 'DEAD' THEN 'BALL_OUT_OR_DEAD' WHEN 'OPP' THEN 'OPPOSITION_POSSESSION' WHEN 'FOCAL' THEN CASE WHEN player_otb = 'FOCAL' THEN 'PLAYER_ON_BALL' ELSE 'TEAM_POSSESSION_OFF_BALL' END ELSE 'UNRESOLVED' END AS possession_context FROM y4)"""


@query("e15_carry_possession", f"WITH {EV}, {CARRY} SELECT event_id, ball_state, team_possession, player_otb, possession_context FROM carried")
def _(spark, d):
    z = P.zone_states(geo(spark, d), 2.5, 2.0)
    out = P.carry_possession(z, user(spark, d), focal_player=F.lit(3))
    return out.select("event_id", "ball_state", "team_possession", "player_otb", "possession_context")
