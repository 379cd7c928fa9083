"""Readers over JSON and CSV rows that Spark derives from the driver tables."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import curves as C, dims as D, match_events as ME, tracking as T
from .base import EV, ev, query, rounded, table
from .joins import EM, em
from .scalar import POS_SQL, POSITIONS

def code_of():
    return F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), F.col("k") % 12 + 1)


@query("s01_tracking_scan", f"""
WITH {EV} SELECT user_id::VARCHAR AS match_id, event_id AS frame_num, period, round(CASE WHEN k % 2 = 0 THEN m ELSE m * 60 END, 4) AS t FROM ev WHERE event_type <> 'error' AND k % 5 <> 4""")
def _(spark, d):
    k = F.col("k")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("_tracking.jsonl", ".jsonl.bz2", "_tracking.json", ".JSONL", "_roster.txt")]), k % 5 + 1)
    path = F.concat(F.lit("/data/2022/"), F.col("user_id").cast("string"), suffix)
    frame = F.to_json(F.struct(F.col("event_id").alias("frameNum"), "period", F.when(k % 2 == 0, F.col("m") * 1000).alias("videoTimeMs"), F.when(k % 2 == 1, F.col("m") * 60).alias("video_time_s")))
    lines = ev(spark, d).select(T.match_id_of(path).alias("match_id"), F.when(F.col("event_type") == "error", "  ").otherwise(frame).alias("value"))
    out = T.video_time(T.parse_tracking(lines)).where(F.col("match_id").isNotNull())
    return out.select("match_id", F.col("frameNum").alias("frame_num"), "period", F.round("video_time_s", 4).alias("t"))


def vendor_events(spark, d):
    """One vendor event per row of `events`, through JSON text."""
    k, e = F.col("k"), ev(spark, d)
    kind = F.when(F.col("event_type") == "error", "OUT").when(F.col("event_type") == "signup", "END").otherwise("OTB")
    poss = F.when(F.col("event_type") == "view", "PA").when(F.col("event_type") == "purchase", "SH")
    ball = F.struct((F.col("value") / 10).alias("x"), (k / 4.0).alias("y"))

    def body(ball):
        return F.to_json(F.struct(
            F.col("event_id").alias("gameEventId"),
            F.when(k % 9 == 0, "junk").otherwise(F.col("value").cast("string")).alias("eventTime"),
            F.col("value").cast("string").alias("startTime"), (F.col("value") + 1).cast("string").alias("endTime"), (k % 7).cast("string").alias("sequence"),
            F.struct(
                kind.alias("gameEventType"), F.col("period").cast("string").alias("period"), (k % 11).cast("string").alias("playerId"), (k % 2).cast("string").alias("teamId"),
                (k % 2 == 0).alias("homeTeam"), F.when(k % 10 != 0, F.col("clock_s")).alias("startGameClock"), F.substring(F.lit("OFPCKGT"), k % 7 + 1, 1).alias("setpieceType"),
            ).alias("gameEvents"),
            F.struct(
                poss.alias("possessionEventType"), F.when(k % 3 != 0, "C").otherwise("D").alias("passOutcomeType"), (k % 11).cast("string").alias("passerPlayerId"),
                F.when(k % 4 != 0, (k % 13).cast("string")).alias("receiverPlayerId"), F.when(k % 5 != 0, (k % 7).cast("string")).alias("targetPlayerId"),
                (k % 11).cast("string").alias("shooterPlayerId"), F.concat(F.lit("Player "), (k % 11).cast("string")).alias("shooterPlayerName"), F.substring(F.lit("SVODFIH"), k % 7 + 1, 1).alias("shotType"),
                F.when(k % 2 == 0, "HE").otherwise("L").alias("bodyType"), F.when(k % 6 == 0, "P").alias("pressureType"), F.substring(F.lit("GSBCOFL"), k % 7 + 1, 1).alias("shotOutcomeType"), F.lit(120.0).alias("gameClock"),
            ).alias("possessionEvents"),
            F.struct(F.when(k % 2 == 0, "L").otherwise("R").alias("teamAttackingDirection")).alias("stadiumMetadata"),
            F.when(k % 8 < 6, ball).alias("ball"),
            F.when(k % 8 != 7, F.array(F.struct((k % 11).cast("long").alias("playerId"), (F.col("value") / 20).alias("x"), (k / 5.0).alias("y"), F.lit("CM").alias("positionGroupType")))).alias("homePlayers"),
            F.array(F.struct(F.lit(99).cast("long").alias("playerId"), F.lit(50.0).alias("x"), F.lit(1.0).alias("y"), F.lit("gk").alias("positionGroupType"))).alias("awayPlayers"),
        ))

    # the ball is a list in half of the events, one object in the others
    text = F.when(k % 16 < 8, body(F.array(ball))).otherwise(body(ball))
    return ME.parse_events(e.select(F.col("user_id").cast("string").alias("match_id"), text.alias("value")))


@query("s02_event_scan", f"""
WITH {EV} SELECT user_id::VARCHAR AS match_id, event_id AS "gameEventId", CASE WHEN k % 9 <> 0 THEN value END AS "eventTime", value AS "startTime", round(value + 1, 6) AS "endTime", NULL::DOUBLE AS duration, (k % 7)::DOUBLE AS sequence, period,
 (k % 11)::DOUBLE AS player_id, (k % 2)::DOUBLE AS team_id, CASE event_type WHEN 'error' THEN 'OUT' WHEN 'signup' THEN 'END' ELSE 'OTB' END AS event_kind, CASE event_type WHEN 'view' THEN 'PA' WHEN 'purchase' THEN 'SH' END AS poss_type FROM ev""")
def _(spark, d):
    out = ME.flat_events(vendor_events(spark, d))
    out = out.select("match_id", "gameEventId", "eventTime", "startTime", "endTime", "duration", "sequence", "period", "player_id", "team_id", "event_kind", "poss_type")
    return rounded(out, "endTime")


CUST_POS = POS_SQL.replace("k % 12", "c_custkey % 12")


def roster(spark, d):
    c = table(spark, d, "customer")
    code = F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), (F.col("c_custkey") % 12 + 1).cast("int"))
    i = F.col("c_custkey")
    rec = F.struct(
        F.struct(i.cast("string").alias("id"), F.when(i % 3 != 0, F.col("c_name")).alias("nickname"), F.concat(F.lit("name "), i.cast("string")).alias("name")).alias("player"),
        F.struct((i % 2).cast("string").alias("id"), F.lit("t").alias("name")).alias("team"), code.alias("positionGroupType"), (i % 30).cast("string").alias("shirtNumber"),
    )
    text = F.when(i % 2 == 0, F.to_json(F.struct(F.array(rec).alias("players")))).otherwise(F.to_json(rec))
    rows = c.select(F.col("c_nationkey").cast("string").alias("match_id"), F.from_json(text, D.schemas.ROSTER).alias("r")).select("match_id", "r.*")
    return D.roster_rows(rows)


def metadata(spark, d):
    n = table(spark, d, "nation")
    body = F.to_json(F.struct(F.struct((F.col("n_nationkey") % 2).cast("string").alias("id")).alias("homeTeam")))
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return D.parse_metadata(n.select(F.col("n_nationkey").cast("string").alias("match_id"), text.alias("value")))


ROSTER = f"""ros AS (SELECT c_nationkey::VARCHAR AS match_id, c_custkey AS player_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'name ' || c_custkey END AS nickname, c_custkey % 2 AS team_id, (c_custkey % 30)::VARCHAR AS shirt, {CUST_POS} AS position,
 CASE WHEN c_custkey % 2 = n_nationkey % 2 THEN 'home' ELSE 'away' END AS side FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {CUST_POS} <> 'GK')"""


@query("s03_roster", f"WITH {ROSTER} SELECT * FROM ros")
def _(spark, d):
    return D.outfield_roster(roster(spark, d), metadata(spark, d))


@query("s04_metadata", "SELECT n_nationkey::VARCHAR AS match_id, (n_nationkey % 2)::VARCHAR AS home_team_id FROM nation")
def _(spark, d):
    return metadata(spark, d)


@query("s05_match_catalogue", """
SELECT o_orderkey::VARCHAR AS match_id, '/t/' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '.json' ELSE '_tracking.jsonl' END AS tracking, '/r/' || o_orderkey || '_roster.json' AS roster, '/m/' || o_orderkey || '.json' AS metadata
FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND (o_orderkey % 4 <> 0 OR o_totalprice >= 4096)""")
def _(spark, d):
    o, i = table(spark, d, "orders"), F.col("o_orderkey")
    key = i.cast("string")
    t = o.select(F.concat(F.lit("/t/"), key, F.when(i % 4 == 0, ".json").otherwise("_tracking.jsonl")).alias("path"), F.col("o_totalprice").alias("length"))
    t = t.unionByName(t)
    r = o.where(i % 3 != 0).select(F.concat(F.lit("/r/"), key, F.lit("_roster.json")).alias("path"))
    m = o.where(i % 5 != 0).select(F.concat(F.lit("/m/"), key, F.lit(".json")).alias("path"))
    return D.match_catalogue(t, r, m)


# frames of at most 20 points, through JSON text; sides by label parity, smoothed arrays in three of four frames
def frames(spark, d):
    e, v = em(spark, d), F.col("vec_id")
    jersey = (v % 20).cast("string").alias("jerseyNum")

    def pts(team, dx, keep):
        p = F.struct(jersey, F.when(v % 29 != 0, F.col("x") + dx).alias("x"), F.col("y").alias("y"), F.lit("VISIBLE").alias("visibility"), (F.col("speed") + dx).alias("speed"))
        return F.array_sort(F.collect_list(F.when((F.col("team") == team) & keep, p)))

    fr = F.col("frame")
    ball = F.struct(F.col("x"), F.col("y"), F.lit("VISIBLE").alias("visibility"))
    g = e.groupBy("frame").agg(
        pts(0, 0.0, F.lit(True)).alias("homePlayers"), pts(1, 0.0, F.lit(True)).alias("awayPlayers"),
        pts(0, 1.0, fr % 4 != 0).alias("homePlayersSmoothed"), pts(1, 1.0, fr % 4 != 0).alias("awayPlayersSmoothed"),
        F.collect_list(F.when((v % 20 == 3) & (fr % 3 != 0), ball)).alias("balls"), F.min(F.when((v % 20 == 5) & (fr % 5 != 0), ball)).alias("ballsSmoothed"),
    )
    text = F.to_json(F.struct(fr.alias("frameNum"), F.lit(1).alias("period"), (fr * 100.0).alias("videoTimeMs"), "homePlayers", "awayPlayers", "homePlayersSmoothed", "awayPlayersSmoothed", "balls", "ballsSmoothed"))
    return T.parse_tracking(g.select((fr % 3).cast("string").alias("match_id"), text.alias("value")))


def squad(spark, d):
    e, v = em(spark, d), F.col("vec_id")
    s = e.where(v % 20 != 7).select((F.col("frame") % 3).cast("string").alias("match_id"), F.when(F.col("team") == 0, "home").otherwise("away").alias("side"), (v % 20).cast("string").alias("shirt"), (F.col("team") * 100 + v % 20).alias("player_id"), F.col("team").alias("team_id"))
    return s.distinct()


@query("s06_player_explode", f"""
WITH {EM} SELECT (frame % 3)::VARCHAR AS match_id, frame AS frame_num, team * 100 + vec_id % 20 AS player_id, team AS team_id, round(x + CASE WHEN frame % 4 <> 0 THEN 1 ELSE 0 END, 5) AS x, round(y, 5) AS y, round(frame / 10.0, 3) AS t FROM em WHERE vec_id % 29 <> 0 AND vec_id % 20 <> 7""")
def _(spark, d):
    out = T.explode_players(frames(spark, d), squad(spark, d))
    out = out.select("match_id", F.col("frameNum").alias("frame_num"), "player_id", "team_id", "x", "y", F.round("video_time_s", 3).alias("t"))
    return rounded(out, "x", "y", digits=5)


@query("s07_ball_point", f"""
WITH {EM}, b AS (SELECT frame, max(CASE WHEN vec_id % 20 = 3 AND frame % 3 <> 0 THEN x END) AS rx, max(CASE WHEN vec_id % 20 = 3 AND frame % 3 <> 0 THEN y END) AS ry, max(CASE WHEN vec_id % 20 = 5 AND frame % 5 <> 0 THEN x END) AS sx, max(CASE WHEN vec_id % 20 = 5 AND frame % 5 <> 0 THEN y END) AS sy FROM em GROUP BY ALL)
SELECT frame AS frame_num, round(coalesce(rx, sx), 5) AS x, round(coalesce(ry, sy), 5) AS y, CASE WHEN coalesce(rx, sx) IS NOT NULL THEN 'VISIBLE' END AS visibility FROM b""")
def _(spark, d):
    b = frames(spark, d).select(F.col("frameNum").alias("frame_num"), T.ball_point().alias("b"))
    return rounded(b.select("frame_num", "b.x", "b.y", "b.visibility"), "x", "y", digits=5)


@query("s08_game_event_index", f"""
WITH {EV}, g AS (SELECT user_id, k % 10 AS ge, min(event_id) AS f0, max(event_id) AS f1, arg_min(k, event_id) AS k0, arg_min(event_type, event_id) AS ty FROM ev WHERE k % 10 <> 9 GROUP BY ALL)
SELECT user_id::VARCHAR AS match_id, ge::BIGINT AS "gameEventId", ty AS game_event_type, CASE WHEN ge < 3 THEN k0 ELSE f0 END::BIGINT AS frame0, CASE WHEN ge < 2 THEN k0 + 100 ELSE f1 END::BIGINT AS frame1, (k0 % 2)::VARCHAR AS home_ball, k0::DOUBLE AS sequence_tracking, (k0 % 2)::BIGINT AS team_id_tracking, (k0 % 11)::BIGINT AS player_id_tracking FROM g""")
def _(spark, d):
    k = F.col("k")
    ge = F.struct(
        F.col("event_type").alias("game_event_type"), (k % 2).cast("string").alias("home_ball"), k.cast("double").alias("sequence"), (k % 2).cast("long").alias("team_id"), (k % 11).cast("long").alias("player_id"),
        F.when(k % 10 < 3, k.cast("long")).alias("start_frame"), F.when(k % 10 < 2, k.cast("long") + 100).alias("end_frame"),
    )
    text = F.to_json(F.struct(F.col("event_id").alias("frameNum"), F.when(k % 10 != 9, k % 10).alias("game_event_id"), ge.alias("game_event")))
    fr = T.parse_tracking(ev(spark, d).select(F.col("user_id").cast("string").alias("match_id"), text.alias("value")))
    return T.game_event_index(fr)


PASSES = """ps AS (SELECT user_id, event_id, period, CASE WHEN k % 10 <> 0 THEN clock_s / 60 END AS cm, k % 3 <> 0 AS ok, k % 11 AS passer, coalesce(CASE WHEN k % 4 <> 0 THEN k % 13 END, CASE WHEN k % 5 <> 0 THEN k % 7 END) AS other FROM ev WHERE event_type = 'view'),
 pe AS (SELECT user_id, event_id, period, cm, ok, passer AS player_id FROM ps UNION ALL SELECT user_id, event_id, period, cm, ok, other FROM ps WHERE other IS NOT NULL AND other <> passer)"""


@query("s09_pass_rows", f'WITH {EV}, {PASSES} SELECT user_id::VARCHAR AS match_id, event_id AS "gameEventId", period, round(cm, 5) AS game_clock_min, ok AS success, player_id::BIGINT AS player_id FROM pe')
def _(spark, d):
    return rounded(ME.passes(vendor_events(spark, d)), "game_clock_min", digits=5)


SHOTS = """sh AS (SELECT *, CASE WHEN k % 8 < 6 THEN value / 10 WHEN k % 8 = 6 THEN value / 20 END AS lx, CASE WHEN k % 8 < 6 THEN k / 4.0::DOUBLE WHEN k % 8 = 6 THEN k / 5.0::DOUBLE END AS ly, CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END AS sg FROM ev WHERE event_type = 'purchase')"""


@query("s10_shot_rows", f"""
WITH {EV}, {SHOTS} SELECT event_id AS "gameEventId", (k % 11)::BIGINT AS shooter_id, period, round(CASE WHEN k % 10 <> 0 THEN clock_s / 60 ELSE 2 END, 5) AS game_clock_min, round_even(CASE WHEN k % 10 <> 0 THEN clock_s / 60 ELSE 2 END, 0)::INT AS minute, round((sg * lx + 52.5) * 120 / 105, 5) AS x, round((sg * ly + 34) * 80 / 68, 5) AS y,
 CASE WHEN k % 2 = 0 THEN 'Head' ELSE 'Left Foot' END AS shot_body_part, CASE k % 7 WHEN 1 THEN 'Free Kick' WHEN 2 THEN 'Penalty' WHEN 3 THEN 'Corner' ELSE 'Open Play' END AS shot_type, CASE k % 7 WHEN 1 THEN 'Volley' WHEN 2 THEN 'Overhead Kick' WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'Diving Header' ELSE 'Normal' END ELSE 'Normal' END AS shot_technique,
 (k % 6 = 0)::INT AS under_pressure, (k % 7 IN (1, 3, 4))::INT AS first_time, CASE WHEN k % 8 <> 7 THEN 2 ELSE 1 END AS n_players, lx IS NOT NULL AS placed FROM sh""")
def _(spark, d):
    s = ME.shots(vendor_events(spark, d))
    out = s.select("gameEventId", "shooter_id", "period", "game_clock_min", "minute", "x", "y", "shot_body_part", "shot_type", "shot_technique", "under_pressure", "first_time", F.size("players").alias("n_players"), "placed")
    return rounded(out, "game_clock_min", "x", "y", digits=5)


@query("s10_skipped_shots", f"WITH {EV}, {SHOTS} SELECT user_id::VARCHAR AS match_id, count(*) AS n_shots, count(*) FILTER (WHERE lx IS NULL) AS n_skipped FROM sh GROUP BY ALL")
def _(spark, d):
    return ME.skipped_shots(ME.shots(vendor_events(spark, d)))


@query("s11_vendor_speed", f"""
WITH {EM} SELECT (frame % 3)::VARCHAR AS match_id, frame AS frame_num, team * 100 + vec_id % 20 AS player_id, round(y, 5) AS y, round(speed, 5) AS speed_vendor FROM em WHERE vec_id % 20 <> 7 AND vec_id % 29 <> 0""")
def _(spark, d):
    f, s = frames(spark, d), squad(spark, d)
    out = T.attach_vendor_speed(T.explode_players(f, s), T.vendor_speed(f, s))
    return rounded(out.select("match_id", F.col("frameNum").alias("frame_num"), "player_id", "y", "speed_vendor"), "y", "speed_vendor", digits=5)


def curve_rows(spark, d, file):
    e = ev(spark, d).withColumn("case", F.col("user_id").cast("string"))
    v = F.when(F.col("k") % 17 != 0, F.col("value").cast("string")).otherwise("")
    if file.startswith("02"):
        return e.select("case", "period", F.col("clock").alias("minute"), F.when(F.col("k") % 2 == 0, "distance_m").otherwise("peak_speed").alias("y_metric"), (F.col("k") / 99.0).cast("string").alias("roll_A"))
    if file.startswith("03"):
        return e.where(F.col("user_id") % 3 != 0).select("case", "period", F.col("clock").alias("minute"), F.when(F.col("k") % 2 == 0, "teammates").otherwise("opponents").alias("reference"), ((F.col("value") - 50) * 10).alias("C"))
    if file.startswith("04"):
        return e.select("case", F.col("clock").alias("minute"), v.alias("phi_roll10"))
    return e.select("case", "period", F.col("clock").alias("minute"), (F.col("value") / 500).alias("worst_vulnerability_5min_norm"))


@query("s12_long_curves", f"""
WITH {EV} SELECT user_id::VARCHAR AS "case", period, round(clock, 4) AS minute, 'ols_distance' AS series, round(greatest(0, least(1, (degrees(k / 99.0 * pi() - pi() / 2) + 42.5) / 85)), 6) AS value FROM ev WHERE k % 2 = 0
UNION ALL SELECT user_id::VARCHAR, period, round(clock, 4), CASE WHEN k % 2 = 0 THEN 'tm_cum' ELSE 'op_cum' END, round(greatest(0, least(1, ((value - 50) * 10 + 350) / 700)), 6) FROM ev WHERE user_id % 3 <> 0
UNION ALL SELECT user_id::VARCHAR, CASE WHEN clock <= 45 THEN 1 ELSE 2 END, round(clock, 4), 'speed_phi', value FROM ev WHERE k % 17 <> 0
UNION ALL SELECT user_id::VARCHAR, period, round(clock, 4), 'standing', round(1 - value / 500, 6) FROM ev""")
def _(spark, d):
    return rounded(rounded(long_curves(spark, d), "value"), "minute", digits=4)


def long_curves(spark, d):
    out = None
    for file in C.FILES:
        if file[:2] in ("02", "03", "04", "06"):
            c = C.long_curve(curve_rows(spark, d, file), file)
            out = c if out is None else out.unionByName(c)
    return out


@query("s12_missing_series", """
SELECT DISTINCT user_id::VARCHAR AS "case", s AS series FROM events, (VALUES ('tight_w3'), ('pass_C')) t(s) UNION ALL SELECT DISTINCT user_id::VARCHAR, s FROM events, (VALUES ('tm_cum'), ('op_cum')) t(s) WHERE user_id % 3 = 0""")
def _(spark, d):
    return C.missing_series(long_curves(spark, d))


@query("s12_curve_files", f"""
WITH {EV}, c AS (SELECT *, user_id % 4 AS cs FROM ev)
SELECT 'case_' || cs AS "case", period, round(clock, 4) AS minute, 'tight_w3' AS series, round(value / 500, 6) AS value FROM c WHERE cs <> 3
UNION ALL SELECT 'case_' || cs, period, round(clock, 4), 'standing', round(1 - value / 700, 6) FROM c WHERE cs <> 1""")
def _(spark, d):
    """Curve files whose headers differ by case, written to the shared folder and read back by name."""
    root = f"{shared_folder(spark)}/curves-{uuid.uuid4().hex}"
    e = ev(spark, d).withColumn("cs", F.col("user_id") % 4)
    period, minute, m = "period", F.col("clock").alias("minute"), F.col("value").alias("m")
    m3, standing = (F.col("value") / 500).alias("m_w3"), (F.col("value") / 700).alias("worst_vulnerability_5min_norm")
    # as described, turned round, with further columns before, without the series' column
    tight = [[period, minute, m, m3], [m3, m, minute, period], [F.lit("x").alias("section"), m, period, minute, m3], [period, minute, m]]
    for cs, columns in enumerate(tight):
        files = {"01f_pc_synergy_m_80_1450_timewin.csv": columns} | ({"06_standing_position.csv": [standing, minute, period]} if cs != 1 else {})
        for file, cols in files.items():
            e.where(F.col("cs") == cs).select(*cols).write.option("header", True).csv(f"{root}/case_{cs}/source/{file}")
    return rounded(rounded(C.read_curves(spark, root).drop("source_row"), "value"), "minute", digits=4)


@query("s13_partitioned_sink", f"WITH {EV} SELECT period, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL")
def _(spark, d):
    """Written to and read back from the shared folder; only its own new folder is used."""
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    C.write_table(ev(spark, d).select("event_id", "period", "event_type", "value"), path, by=["period"])
    back = spark.read.parquet(path).groupBy("period", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(back, "total", digits=4)


@query("s14_entity_resolve", f"""
WITH {ROSTER}, nd AS (SELECT DISTINCT c_nationkey::VARCHAR AS match_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'ER#' || lpad((c_custkey // 10)::VARCHAR, 8, '0') END AS needle FROM customer),
 h AS (SELECT nd.match_id, nd.needle, ros.player_id, ros.nickname, row_number() OVER (PARTITION BY nd.match_id, nd.needle ORDER BY ros.player_id::VARCHAR <> nd.needle, ros.player_id) AS rn FROM nd JOIN ros ON nd.match_id = ros.match_id AND (ros.player_id::VARCHAR = nd.needle OR contains(lower(nickname), lower(nd.needle))))
SELECT match_id, needle, player_id, nickname FROM h WHERE rn = 1""")
def _(spark, d):
    c, i = table(spark, d, "customer"), F.col("c_custkey")
    needle = F.when(i % 2 == 0, i.cast("string")).otherwise(F.concat(F.lit("Ér#"), F.lpad(F.floor(i / 10).cast("string"), 8, "0")))
    needles = c.select(F.col("c_nationkey").cast("string").alias("match_id"), needle.alias("needle")).distinct()
    out = D.resolve_players(needles, D.outfield_roster(roster(spark, d), metadata(spark, d)))
    return out.withColumn("needle", F.replace("needle", F.lit("Ér#"), F.lit("ER#")))


@query("s15_profile_slice", f"""
WITH {EV} SELECT {POS_SQL} AS "group", floor(clock)::INT + 1 AS minute, round(avg(value), 8) AS mean, count(*) AS n FROM ev WHERE {POS_SQL} = 'CM' GROUP BY ALL""")
def _(spark, d):
    p = ev(spark, d).select(F.lit("detailed").alias("level"), code_of().alias("group"), (F.floor("clock") + 1).cast("int").alias("minute"), F.lit("speed").alias("metric"), "value")
    p = p.groupBy("level", "group", "minute", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return rounded(D.profile_slice(p, "detailed", "CM", "speed").select("group", "minute", "mean", "n"), "mean", digits=8)
