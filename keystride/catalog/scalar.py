"""Projection and scalar functions over `events`."""

from pyspark.sql import functions as F

from ..functions import codes, scalar as S
from ..operators import fits, windows
from .base import EV, ev, half, query, r6, r8, rounded, table


@query("p01_numeric_coercion", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN 'NaN'
                            ELSE CAST(value AS VARCHAR) END AS raw FROM events)
SELECT event_id, CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS number FROM t""")
def _(spark, d):
    raw = (
        F.when(F.col("event_id") % 7 == 0, "n/a")
        .when(F.col("event_id") % 11 == 0, "NaN")
        .otherwise(F.col("value").cast("string"))
    )
    return table(spark, d, "events").select("event_id", S.num(raw).alias("number"))


@query("p02_clip_unit", f"""
WITH {EV} SELECT event_id,
  round(greatest(0, least(1, ((value - 50) * 10 + 350) / 700)), 6) AS lead_350,
  round(greatest(0, least(1, ((value - 50) * 10 + 600) / 1200)), 6) AS lead_600,
  CASE WHEN vn IS NOT NULL THEN round(greatest(0, least(1, (vn - 50 + 42.5) / 85)), 6) END AS angle
FROM ev""")
def _(spark, d):
    lead = (F.col("value") - 50) * 10
    return ev(spark, d).select(
        "event_id",
        r6(S.clip_unit(lead, S.LEAD_HALF_RANGE_M)).alias("lead_350"),
        r6(S.clip_unit(lead, S.LEAD_WIDE_HALF_RANGE_M)).alias("lead_600"),
        r6(S.clip_unit(F.col("vn") - 50, S.ANGLE_HALF_RANGE_DEG)).alias("angle"),
    )


@query("p03_angle_unit", f"""
WITH {EV} SELECT event_id,
  round(greatest(0, least(1, (degrees(k / 99.0 * pi() - pi() / 2) + 42.5) / 85)), 6) AS unit FROM ev""")
def _(spark, d):
    return ev(spark, d).select("event_id", r6(S.angle_unit(F.col("k") / 99.0)).alias("unit"))


@query("p04_capped_synergy", f"""
WITH {EV}, t AS (SELECT *, 0.5 * (greatest(-1, least(1, (value - 50) / 80)) + 1) AS u,
   0.5 * (greatest(-1, least(1, (k - 50) * 40 / 1450.0)) + 1) AS v FROM ev)
SELECT event_id, round(u, 8) AS u, round(v, 8) AS v, round((u + v) / 2, 8) AS m,
  round(coalesce(CASE WHEN k % 3 = 0 THEN k / 100.0 END, (u + v) / 2), 8) AS m_kept,
  round(coalesce(CASE WHEN k % 2 = 0 THEN clock END, clock_s / 60), 6) AS minute FROM t""")
def _(spark, d):
    s = S.capped_synergy(F.col("value") - 50, (F.col("k") - 50) * 40.0)
    e = ev(spark, d).withColumn("s", s)
    return e.select(
        "event_id",
        *[r8(F.col(f"s.{c}")).alias(c) for c in "uvm"],
        r8(F.coalesce(F.when(F.col("k") % 3 == 0, F.col("k") / 100.0), F.col("s.m"))).alias("m_kept"),
        r6(F.coalesce(F.when(F.col("k") % 2 == 0, F.col("clock")), S.clock_minutes(F.col("clock_s")))).alias("minute"),
    )


@query("p05_two_piece_norm", f"""
WITH {EV}, t AS (SELECT event_id, vn / 1000 - 0.01 AS v FROM ev)
SELECT event_id, CASE WHEN v IS NOT NULL THEN round(greatest(0, least(1,
  CASE WHEN v <= 0.0256378650665283 THEN 0.5 * greatest(v, 0) / 0.0256378650665283
       ELSE 0.5 + 0.5 * (v - 0.0256378650665283) / (0.11229975186288345 - 0.0256378650665283) END)), 6) END AS norm FROM t""")
def _(spark, d):
    return ev(spark, d).select("event_id", r6(S.two_piece_norm(F.col("vn") / 1000 - 0.01)).alias("norm"))


@query("p06_benefit_and_shift", f"""
WITH {EV} SELECT event_id, round(1 - vn / 500, 6) AS benefit,
  CASE WHEN vn IS NOT NULL THEN round(least(vn / 500 + 0.5, 1), 6) END AS shifted FROM ev""")
def _(spark, d):
    x = F.col("vn") / 500
    return ev(spark, d).select("event_id", r6(S.benefit(x)).alias("benefit"), r6(S.shift_half(x)).alias("shifted"))


@query("p07_period_inference", f"""
WITH {EV}, t AS (SELECT event_id, clock * 4 / 3 AS minute, vn AS value FROM ev)
SELECT event_id, CASE WHEN minute <= 45 THEN 1 WHEN minute <= 90 THEN 2 WHEN minute <= 105 THEN 3 ELSE 4 END AS period,
  round(minute, 6) AS minute, value FROM t WHERE value IS NOT NULL""")
def _(spark, d):
    t = ev(spark, d).select("event_id", (F.col("clock") * 4 / 3).alias("minute"), F.col("vn").alias("value"))
    return t.select("event_id", S.infer_period(F.col("minute")).alias("period"), r6(F.col("minute")).alias("minute"),
                    "value").dropna(subset=["period", "minute", "value"])


@query("p08_regulation_minute", f"""
WITH {EV}, t AS (SELECT event_id, 1 + k % 3 AS period, clock_s FROM ev)
SELECT event_id, CASE WHEN period = 1 AND clock_s < 2700 THEN floor(clock_s / 60)
  WHEN period = 2 AND clock_s >= 2700 AND clock_s < 5400 THEN floor(clock_s / 60) END::INTEGER AS minute FROM t""")
def _(spark, d):
    return ev(spark, d).select(
        "event_id", S.regulation_minute(1 + F.col("k") % 3, F.col("clock_s")).alias("minute")
    )


@query("p09_video_seconds", f"""
WITH {EV}, t AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN m * 60000 END AS ms, CASE WHEN k % 3 = 1 THEN m * 60 END AS s,
   m * 3 AS mixed FROM ev)
SELECT event_id, round(coalesce(ms / 1000, s, CASE WHEN mixed > 10000 THEN mixed / 1000 ELSE mixed END), 6) AS t FROM t""")
def _(spark, d):
    k = F.col("k") % 3
    t = S.video_seconds(F.when(k == 0, F.col("m") * 60000), F.when(k == 1, F.col("m") * 60), F.col("m") * 3)
    return ev(spark, d).select("event_id", F.round(t, 6).alias("t"))


@query("p10_clock_minutes", f"""
WITH {EV} SELECT user_id, period, count(*) AS n, round(min(clock_s / 60), 6) AS first_min, round(max(clock_s / 60), 6) AS last_min
FROM ev WHERE period = 2 GROUP BY ALL""")
def _(spark, d):
    minute = S.clock_minutes(F.col("clock_s"))
    return (
        ev(spark, d)
        .where(F.col("period") == 2)
        .groupBy("user_id", "period")
        .agg(F.count("*").alias("n"), r6(F.min(minute)).alias("first_min"), r6(F.max(minute)).alias("last_min"))
    )


@query("p11_match_phase", f"""
WITH {EV} SELECT event_id, CASE
  WHEN period = 1 THEN CASE WHEN clock < 15 THEN 'early' WHEN clock < 30 THEN 'middle' ELSE 'late' END
  ELSE CASE WHEN clock < 60 THEN 'early' WHEN clock < 75 THEN 'middle' ELSE 'late' END END AS phase FROM ev""")
def _(spark, d):
    return ev(spark, d).select("event_id", S.match_phase(F.col("period"), F.col("clock")).alias("phase"))


TEAM_OF = {"view": "FOCAL", "click": "FOCAL", "purchase": "OPP", "signup": "UNRESOLVED", "error": "DEAD"}
CTX_OF = {
    "view": "PLAYER_ON_BALL", "click": "TEAM_POSSESSION_OFF_BALL", "purchase": "OPPOSITION_POSSESSION",
    "signup": "UNRESOLVED", "error": "BALL_OUT_OR_DEAD",
}


@query("p12_class_collapse", """
SELECT event_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'IN_POSSESSION' WHEN event_type = 'purchase' THEN 'OUT_OF_POSSESSION'
       ELSE 'DEAD_OR_UNRESOLVED' END AS by_team,
  CASE event_type WHEN 'view' THEN 'PLAYER_ON_BALL' WHEN 'click' THEN 'TEAM_POSSESSION_OFF_BALL'
       WHEN 'purchase' THEN 'OPPOSITION_POSSESSION' ELSE 'DEAD_OR_UNRESOLVED' END AS four,
  CASE WHEN event_type IN ('view', 'click') THEN 'IN_POSSESSION' WHEN event_type = 'purchase' THEN 'OUT_OF_POSSESSION'
       ELSE 'DEAD_OR_UNRESOLVED' END AS three,
  event_type IN ('signup', 'error') AS is_dead
FROM events""")
def _(spark, d):
    t = table(spark, d, "events")
    ctx = codes.lookup(F.col("event_type"), CTX_OF)
    return t.select(
        "event_id",
        S.collapse_team(codes.lookup(F.col("event_type"), TEAM_OF)).alias("by_team"),
        S.collapse_context(ctx, 4).alias("four"),
        S.collapse_context(ctx, 3).alias("three"),
        S.in_class(ctx, S.NEUTRAL).alias("is_dead"),
    )


@query("p13_player_label", f"""
WITH {EV}, t AS (SELECT event_id, CASE WHEN k % 13 <> 0 THEN k % 11 END AS player, CASE WHEN k % 7 <> 0 THEN k % 2 END AS team FROM ev)
SELECT event_id, CASE WHEN player IS NULL THEN 'NONE' WHEN player = 3 THEN 'FOCAL' WHEN team = 1 THEN 'TEAMMATE'
  WHEN team IS NOT NULL THEN 'OPPONENT' ELSE 'NONE' END AS label FROM t""")
def _(spark, d):
    k = F.col("k")
    lab = S.player_label(F.when(k % 13 != 0, k % 11), F.when(k % 7 != 0, k % 2), F.lit(3), F.lit(1))
    return ev(spark, d).select("event_id", lab.alias("label"))


@query("p14_possession_context", f"""
WITH {EV}, t AS (SELECT event_id, CASE k % 4 WHEN 0 THEN 'FOCAL' WHEN 1 THEN 'TEAMMATE' WHEN 2 THEN 'OPPONENT' ELSE 'NONE' END AS p,
  CASE event_type WHEN 'view' THEN 'FOCAL' WHEN 'click' THEN 'FOCAL' WHEN 'purchase' THEN 'OPP' WHEN 'signup' THEN 'UNRESOLVED' ELSE 'DEAD' END AS t FROM ev)
SELECT event_id, CASE t WHEN 'DEAD' THEN 'BALL_OUT_OR_DEAD' WHEN 'UNRESOLVED' THEN 'UNRESOLVED' WHEN 'OPP' THEN 'OPPOSITION_POSSESSION'
  ELSE CASE p WHEN 'FOCAL' THEN 'PLAYER_ON_BALL' ELSE 'TEAM_POSSESSION_OFF_BALL' END END AS context FROM t""")
def _(spark, d):
    who = codes.lookup(F.col("k") % 4, {0: "FOCAL", 1: "TEAMMATE", 2: "OPPONENT", 3: "NONE"})
    return ev(spark, d).select(
        "event_id", S.possession_context(who, codes.lookup(F.col("event_type"), TEAM_OF)).alias("context")
    )


@query("p15_team_label", f"""
WITH {EV}, t AS (SELECT event_id, CASE WHEN k % 3 <> 0 THEN k % 2 END AS team,
   CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 < 3 THEN ' True' ELSE '0' END AS hb FROM ev),
 u AS (SELECT *, CASE WHEN team = 1 THEN 'FOCAL' WHEN team = 0 THEN 'OPP' END AS a,
   CASE WHEN hb = ' True' THEN 'OPP' WHEN hb = '0' THEN 'FOCAL' END AS b FROM t)
SELECT event_id, coalesce(a, b, 'UNRESOLVED') AS label, CASE WHEN a IS NULL AND b IS NULL THEN 'unresolved' WHEN a IS NULL THEN 'home_ball'
  WHEN b IS NULL OR a = b THEN 'team_id' ELSE 'team_id_over_home_ball_conflict' END AS how FROM u""")
def _(spark, d):
    k = F.col("k")
    hb = F.when(k % 5 == 0, None).when(k % 5 < 3, " True").otherwise("0")
    lab = S.team_label(F.when(k % 3 != 0, k % 2), hb, F.lit(1), F.lit(0))
    return ev(spark, d).select("event_id", lab.alias("r")).select("event_id", "r.label", "r.how")


POSITIONS = ["LB", "LCB", "RCB", "RB", "DM", "CM", "AM", "LW", "RW", "CF", "GK", "XX"]
POS_SQL = "['LB','LCB','RCB','RB','DM','CM','AM','LW','RW','CF','GK','XX'][k % 12 + 1]"


@query("p16_coarse_position", f"""
WITH {EV}, t AS (SELECT {POS_SQL} AS code FROM ev)
SELECT code, CASE WHEN code IN ('LB','LCB','RCB','RB') THEN 'Defender' WHEN code IN ('DM','CM','AM') THEN 'Midfielder'
  WHEN code IN ('LW','RW','CF') THEN 'Attacker' END AS coarse, code IN ('GK', 'XX') AS is_unknown, count(*) AS n FROM t GROUP BY ALL""")
def _(spark, d):
    code = F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), F.col("k") % 12 + 1)
    t = ev(spark, d).select(code.alias("code"))
    return (
        t.withColumn("coarse", codes.coarse_position(F.col("code")))
        .groupBy("code", "coarse", F.col("coarse").isNull().alias("is_unknown"))
        .agg(F.count("*").alias("n"))
    )


@query("p17_attack_grid", f"""
WITH {EV}, t AS (SELECT event_id, value / 10 - 10 AS x, k / 2.0 - 25 AS y, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'R' END AS dir FROM ev)
SELECT event_id, round(CASE WHEN dir = 'left' THEN (52.5 - x) ELSE x + 52.5 END * 120 / 105, 6) AS gx,
  round(CASE WHEN dir = 'left' THEN (34 - y) ELSE y + 34 END * 80 / 68, 6) AS gy FROM t""")
def _(spark, d):
    k = F.col("k")
    g = S.to_attack_grid(F.col("value") / 10 - 10, k / 2.0 - 25, F.when(k % 2 == 0, "left").otherwise("R"))
    return rounded(ev(spark, d).select("event_id", g.alias("g")).select("event_id", F.col("g.x").alias("gx"), F.col("g.y").alias("gy")), "gx", "gy")


@query("p18_code_maps", f"""
WITH {EV}, t AS (SELECT event_id, ['R','L','HE','O','?'][k % 5 + 1] AS body, ['O','F','P','C','K','G','T','?'][k % 8 + 1] AS sp,
  ['S','V','O','D','F','I','H','?'][k % 7 + 1] AS shot, 1 + k % 5 AS p, ['G','S','B','C','O','F','L','?'][k % 8 + 1] AS oc FROM ev)
SELECT event_id, CASE body WHEN 'L' THEN 'Left Foot' WHEN 'HE' THEN 'Head' WHEN 'O' THEN 'Other' ELSE 'Right Foot' END AS body,
 CASE sp WHEN 'F' THEN 'Free Kick' WHEN 'P' THEN 'Penalty' WHEN 'C' THEN 'Corner' ELSE 'Open Play' END AS set_piece,
 CASE WHEN shot = 'D' AND body = 'HE' THEN 'Diving Header' WHEN shot = 'V' THEN 'Volley' WHEN shot = 'O' THEN 'Overhead Kick' ELSE 'Normal' END AS technique,
 CASE p WHEN 2 THEN 'Second Half' WHEN 3 THEN 'Extra Time 1' WHEN 4 THEN 'Extra Time 2' ELSE 'First Half' END AS game_period,
 CASE oc WHEN 'G' THEN 'Goal' WHEN 'S' THEN 'Save on target' WHEN 'B' THEN 'Block on target' WHEN 'C' THEN 'Block off target'
   WHEN 'O' THEN 'Off target' WHEN 'F' THEN 'Save off target' WHEN 'L' THEN 'Goalline clearance' ELSE oc END AS outcome FROM t""")
def _(spark, d):
    def pick(vals, n):
        return F.element_at(F.array(*[F.lit(v) for v in vals]), F.col("k") % n + 1)

    body = pick(["R", "L", "HE", "O", "?"], 5)
    return ev(spark, d).select(
        "event_id",
        codes.body_part(body).alias("body"),
        codes.set_piece(pick(["O", "F", "P", "C", "K", "G", "T", "?"], 8)).alias("set_piece"),
        codes.technique(pick(["S", "V", "O", "D", "F", "I", "H", "?"], 7), body).alias("technique"),
        codes.game_period(1 + F.col("k") % 5).alias("game_period"),
        codes.outcome(pick(["G", "S", "B", "C", "O", "F", "L", "?"], 8)).alias("outcome"),
    )


def phi_sql(z: str) -> str:
    """The normal distribution function as SQL: Horner forms over |z|, continued fraction in the tail."""
    def horner(cs):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * abs({z}) + {c!r}::DOUBLE)"
        return out

    body = f"exp(-({z}) * ({z}) / 2) * {horner(S.HART_NUM)} / {horner(S.HART_DEN)}"
    cf = f"(abs({z}) + 0.65)"
    for n in (4, 3, 2, 1):
        cf = f"(abs({z}) + {n} / {cf})"
    up = f"CASE WHEN abs({z}) < {S.HART_LIMIT}::DOUBLE THEN {body} WHEN abs({z}) <= 37 THEN exp(-({z}) * ({z}) / 2) / {cf} / 2.506628274631 WHEN ({z}) IS NOT NULL THEN 0 END"
    return f"(CASE WHEN ({z}) > 0 THEN 1 - {up} ELSE {up} END)"


@query("p19_normal_cdf", f"""
WITH {EV}, t AS (SELECT event_id, (vn - 50) / 12 AS z FROM ev) SELECT event_id, round({phi_sql('z')}, 9) AS phi FROM t""")
def _(spark, d):
    return ev(spark, d).select("event_id", F.round(S.normal_cdf((F.col("vn") - 50) / 12), 9).alias("phi"))


@query("p20_distance_share", f"""
WITH {EV}, t AS (SELECT user_id, period, clock, event_id, sum(value * 80 / 97) OVER w AS dp, sum(k::DOUBLE) OVER w AS dn FROM ev
  WINDOW w AS (PARTITION BY user_id, period ORDER BY clock, event_id))
SELECT event_id, CASE WHEN dp + dn >= 200 THEN round(((dp - dn) / (dp + dn) + 1) / 2, 8) END AS share,
  CASE WHEN dp + dn >= 200 AND dn >= 200 THEN round(greatest(0, least(1, (greatest(-1, least(1, dp / dn - 1)) + 1) / 2)), 8) END AS ratio FROM t""")
def _(spark, d):
    t = windows.period_to_date(ev(spark, d), half(spark, d), {"dp": F.col("value") * 80 / 97, "dn": F.col("k").cast("double")})
    q = S.distance_ratio(F.col("dp"), F.col("dn"), 200.0)
    return t.select(
        "event_id",
        F.round(S.distance_share(F.col("dp"), F.col("dn"), 200.0), 8).alias("share"),
        F.round(S.clip_unit(q, 1.0), 8).alias("ratio"),
    )


@query("p21_maxnorm_recovery", f"""
WITH {EV}, t AS (SELECT *, clock_s - lag(clock_s) OVER (PARTITION BY user_id, period ORDER BY clock, event_id) AS x, vn AS y FROM ev),
 o AS (SELECT *, x > 0 AND y >= 0 AS ok FROM t),
 s AS (SELECT *, x / max(CASE WHEN ok THEN x END) OVER (PARTITION BY user_id) AS xn, y / max(CASE WHEN ok THEN y END) OVER (PARTITION BY user_id) AS yn FROM o)
SELECT event_id, CASE WHEN ok THEN round(xn, 6) END AS x_norm, CASE WHEN ok THEN round(yn, 6) END AS y_norm,
 CASE WHEN ok THEN round(yn / xn, 4) END AS q_yx, CASE WHEN ok THEN round(2 / pi() * atan(yn / xn), 6) END AS s_angle,
 CASE WHEN ok THEN round(yn / (xn + yn), 6) END AS s_ratio FROM s""")
def _(spark, d):
    from ..operators.ordered import neighbour

    t = neighbour(ev(spark, d), half(spark, d), {"p": F.col("clock_s")}).withColumn("x", F.col("clock_s") - F.col("p"))
    t = fits.maxnorm_scores(t, ["user_id"], "x", "vn")
    t = t.withColumn("q_yx", F.round("q_yx", 4))
    return rounded(t, "x_norm", "y_norm", "s_angle", "s_ratio").select("event_id", "x_norm", "y_norm", "q_yx", "s_angle", "s_ratio")


@query("p22_match_max_norm", f"""
WITH {EV} SELECT event_id,
  CASE WHEN max(vn) OVER w > 0 AND vn IS NOT NULL THEN round(greatest(0, least(1, vn / max(vn) OVER w)), 6) WHEN vn IS NOT NULL THEN 0 END AS unit,
  CASE WHEN max(-vn) OVER w > 0 AND vn IS NOT NULL THEN 1.0::DOUBLE WHEN vn IS NOT NULL THEN 0.0::DOUBLE END AS unit_neg
FROM ev WINDOW w AS (PARTITION BY user_id)""")
def _(spark, d):
    t = ev(spark, d).withColumn("neg", -F.col("vn"))
    t = windows.match_max_norm(t, ["user_id"], {"unit": "vn", "unit_neg": "neg"})
    return t.select("event_id", r6(F.col("unit")).alias("unit"), "unit_neg")


@query("p23_slope_score", f"""
WITH {EV}, t AS (SELECT user_id, period, regr_slope(value, k::DOUBLE) AS b, regr_intercept(value, k::DOUBLE) AS a FROM ev GROUP BY ALL)
SELECT user_id, period, round(b * (200.0 / 42.0), 6) AS roll_b_star, round(degrees(atan(b * (200.0 / 42.0))), 6) AS roll_theta_deg,
  round((atan(b * (200.0 / 42.0)) + pi() / 2) / pi(), 6) AS roll_A, round(a + b * 30, 6) AS roll_H FROM t""")
def _(spark, d):
    k = F.col("k").cast("double")
    t = ev(spark, d).groupBy("user_id", "period").agg(F.regr_slope("value", k).alias("b"), F.regr_intercept("value", k).alias("a"))
    s = S.slope_score(F.col("b"), F.col("a"), F.lit(200.0), F.lit(42.0), F.lit(30.0))
    return t.select("user_id", "period", *[r6(c).alias(n) for n, c in s.items()])


@query("p24_composite", f"""
WITH {EV}, t AS (SELECT event_id, CASE WHEN k % 5 <> 0 THEN k / 100.0 END AS p, CASE WHEN k % 3 = 0 THEN 0 ELSE k / 700.0 END AS w, CASE WHEN k % 4 <> 0 THEN value / 500 END AS q FROM ev)
SELECT event_id, round(CASE WHEN w > 0 THEN (1 - w) * p + w * q ELSE p END, 6) AS c FROM t""")
def _(spark, d):
    k = F.col("k")
    c = S.composite(F.when(k % 5 != 0, k / 100.0), F.when(k % 3 == 0, 0.0).otherwise(k / 700.0), F.when(k % 4 != 0, F.col("value") / 500))
    return ev(spark, d).select("event_id", r6(c).alias("c"))


@query("p25_curve_reshape", f"""
WITH {EV} SELECT 'ols_line_angle' AS section, event_id, 'distance_m' AS y_metric, period, round(clock, 6) AS minute, k / 99.0 AS value, NULL::DOUBLE AS z FROM ev
UNION ALL SELECT 'ols_line_angle', event_id, 'peak_speed', period, round(clock, 6), k / 99.0, NULL FROM ev
UNION ALL SELECT 'speed_roll10', event_id, NULL, NULL, round(clock, 6), k / 99.0, value FROM ev""")
def _(spark, d):
    e = ev(spark, d).withColumns({"roll_A": F.col("k") / 99.0, "phi_roll10": F.col("k") / 99.0, "roll10_z": F.col("value"), "minute": r6(F.col("clock"))})
    parts = [fits.line_angle_curve(e, y, keys=["event_id"]) for y in ("distance_m", "peak_speed")]
    speed = fits.relative_speed_curve(e, keys=["event_id"])
    out = parts[0].unionByName(parts[1]).withColumnRenamed("roll_A", "value")
    speed = speed.withColumnsRenamed({"phi_roll10": "value", "roll10_z": "z"})
    return out.unionByName(speed, allowMissingColumns=True)
