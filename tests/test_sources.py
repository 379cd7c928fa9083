"""Readers and sinks on small files, with the shapes the vendor files come in."""

import bz2
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystride.operators import nearest as N
from keystride.plans import jobs
from keystride.operators import mix as M
from keystride.sources import curves as C, dims as D, match_events as ME, tracking as T
from keystride.streaming import tracking as ST


def point(j, x, y, **kw):
    return {"jerseyNum": j, "x": x, "y": y, "visibility": "VISIBLE", **kw}


FRAMES = [
    {"frameNum": 1, "period": 1, "videoTimeMs": 1000.0, "periodGameClockTime": 0.0, "homePlayers": [point("7", 0.0, 0.0, speed=3.5), point("1", 9.0, 9.0)],
     "awayPlayers": [point("7", 5.0, 0.0)], "homePlayersSmoothed": [point("7", 1.0, 0.0), point("1", 9.0, 9.0)], "awayPlayersSmoothed": [],
     "balls": [{"x": 2.0, "y": 0.0, "visibility": "VISIBLE"}], "game_event_id": 5, "game_event": {"game_event_type": "OTB", "home_ball": True, "sequence": 2, "team_id": 10, "player_id": 70}},
    {"frameNum": 2, "period": 1, "video_time_s": 1.5, "periodGameClockTime": 0.5, "homePlayers": [point("7", 0.0, None)], "awayPlayers": [point("7", 5.0, 0.0)],
     "balls": [], "ballsSmoothed": {"x": 4.0, "y": 0.0, "visibility": "ESTIMATED"}, "game_event_id": 5, "game_event": {"game_event_type": "OTB", "end_frame": 9}},
    {"frameNum": 3, "period": 1, "videoTime": 20000, "periodGameClockTime": 1.0},
]
ROSTER = [
    {"player": {"id": "70", "nickname": "Luka Modrić"}, "team": {"id": "10"}, "positionGroupType": "CM", "shirtNumber": "7"},
    {"player": {"id": "71", "nickname": None, "name": "Keeper"}, "team": {"id": "10"}, "positionGroupType": "GK", "shirtNumber": "1"},
    {"player": {"id": "80", "nickname": "João Ünal"}, "team": {"id": "20"}, "positionGroupType": "LB", "shirtNumber": "7"},
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("vendor")
    for d in ("tracking", "roster", "meta", "events"):
        (r / d).mkdir()
    text = "\n".join([json.dumps(FRAMES[0]), "", json.dumps(FRAMES[1]), "   ", json.dumps(FRAMES[2])])
    (r / "tracking" / "100_tracking.jsonl").write_text(text)
    (r / "tracking" / "200.jsonl.bz2").write_bytes(bz2.compress(text.encode()))
    (r / "tracking" / "300.json").write_text("{}")
    (r / "roster" / "100_roster.json").write_text(json.dumps(ROSTER))
    (r / "roster" / "200.json").write_text(json.dumps({"players": ROSTER}))
    (r / "roster" / "300.json").write_text(json.dumps({"roster": ROSTER}))
    (r / "meta" / "100_metadata.json").write_text(json.dumps({"homeTeam": {"id": "10"}}))
    (r / "meta" / "200.json").write_text(json.dumps([{"homeTeam": {"id": "20"}}]))
    return r


@pytest.fixture(scope="module")
def squad(spark, root):
    return D.outfield_roster(D.read_roster(spark, f"{root}/roster"), D.read_metadata(spark, f"{root}/meta"))


def test_tracking_scan(spark, root):
    f = T.video_time(T.read_tracking(spark, f"{root}/tracking")).orderBy("match_id", "frameNum").collect()
    assert [(r.match_id, r.frameNum, r.video_time_s) for r in f] == [(m, n, t) for m in ("100", "200") for n, t in ((1, 1.0), (2, 1.5), (3, 20.0))]


def test_roster_sides(squad):
    got = {(r.match_id, r.player_id): (r.side, r.nickname, r.position, r.shirt) for r in squad.collect()}
    assert got == {
        ("100", 70): ("home", "Luka Modrić", "CM", "7"), ("100", 80): ("away", "João Ünal", "LB", "7"),
        ("200", 70): ("away", "Luka Modrić", "CM", "7"), ("200", 80): ("home", "João Ünal", "LB", "7"),
    }


def test_player_rows(spark, root, squad):
    rows = T.explode_players(T.read_tracking(spark, f"{root}/tracking").where("match_id = '100'"), squad).collect()
    got = sorted((r.frameNum, r.player_id, r.side, r.x, r.ball_x) for r in rows)
    assert got == [(1, 70, "home", 1.0, 2.0), (1, 80, "away", 5.0, 2.0), (2, 80, "away", 5.0, 4.0)]
    v = T.vendor_speed(T.read_tracking(spark, f"{root}/tracking").where("match_id = '100' AND frameNum = 1"), squad)
    assert {r.player_id: r.speed_vendor for r in v.collect()} == {70: 3.5, 80: None}


def test_event_index_and_geometry(spark, root, squad):
    f = T.read_tracking(spark, f"{root}/tracking").where("match_id = '100'")
    ix = T.game_event_index(f).first()
    assert (ix.gameEventId, ix.frame0, ix.frame1, ix.home_ball, ix.team_id_tracking) == (5, 1, 2, "true", 10)
    geo = N.team_distances(T.frame_geometry(f), F.lit(False), squad).orderBy("frameNum").collect()
    assert (geo[0].d_focal, geo[0].d_opp, geo[0].nearest_side, geo[0].nearest_player_id) == (3.0, 1.0, "OPP", 70)
    assert (geo[1].d_focal, geo[1].d_opp, geo[1].nearest_player_id) == (1.0, None, 80)
    assert geo[2].d_min is None and geo[2].nearest_side is None


def test_catalogue(spark, root):
    got = D.match_catalogue(*[D.list_files(spark, f"{root}/{d}") for d in ("tracking", "roster", "meta")]).orderBy("match_id").collect()
    assert [(r.match_id, r.tracking.rsplit("/", 1)[1]) for r in got] == [("100", "100_tracking.jsonl"), ("200", "200.jsonl.bz2")]


def test_resolve(spark, squad):
    needles = spark.createDataFrame([("100", "modric"), ("100", "JOAO"), ("100", "80"), ("100", "keeper")], "match_id string, needle string")
    assert {r.needle: r.player_id for r in D.resolve_players(needles, squad).collect()} == {"modric": 70, "JOAO": 80, "80": 80}
    assert spark.range(1).select(D.fold(F.lit("Čaĳkø Straße")).alias("f")).first().f == "caijk strae"


EVENTS = [
    {"gameEventId": 1, "eventTime": "x", "startTime": 3.5, "gameEvents": {"gameEventType": "OTB", "period": 1, "playerId": 70, "teamId": 10, "homeTeam": True, "startGameClock": 90.0, "setpieceType": "O"},
     "possessionEvents": {"possessionEventType": "PA", "passOutcomeType": "C", "passerPlayerId": 70, "targetPlayerId": 80}},
    {"gameEventId": 2, "gameEvents": {"period": 2, "playerId": 70, "teamId": 10, "homeTeam": True, "startGameClock": 150.0},
     "possessionEvents": {"possessionEventType": "SH", "shooterPlayerId": 70, "shotType": "D", "bodyType": "HE", "pressureType": "P", "shotOutcomeType": "G"},
     "stadiumMetadata": {"teamAttackingDirection": "L"}, "homePlayers": [{"playerId": 70, "x": -40.0, "y": 4.0, "positionGroupType": "CF"}],
     "awayPlayers": [{"playerId": 81, "x": -52.0, "y": 0.0, "positionGroupType": "GK"}, {"playerId": 82, "x": -46.0, "y": 2.0, "positionGroupType": "LB"}, {"playerId": 83, "x": None, "y": 0.0}]},
    {"gameEventId": 3, "gameEvents": {"teamId": 10}, "possessionEvents": {"possessionEventType": "SH", "shooterPlayerId": 70, "gameClock": 30.0}},
]


def test_vendor_events(spark, root):
    (root / "events" / "100_events.json").write_text(json.dumps(EVENTS))
    ev = ME.read_events(spark, f"{root}/events")
    flat = ME.flat_events(ev).where("gameEventId = 1").first()
    assert (flat.match_id, flat.eventTime, flat.startTime, flat.period, flat.player_id, flat.event_kind) == ("100", None, 3.5, 1, 70.0, "OTB")
    ps = ME.passes(ev).orderBy("player_id").collect()
    assert [(r.player_id, r.period, r.game_clock_min, r.success) for r in ps] == [(70, 1, 1.5, True), (80, 1, 1.5, True)]
    rows = ME.shots(ev)
    s = {r.gameEventId: r for r in rows.collect()}
    assert s[2].x == pytest.approx(92.5 * 120 / 105) and s[2].y == pytest.approx(30 * 80 / 68) and s[2].minute == 2
    assert (s[2].shot_technique, s[2].under_pressure, s[2].first_time, s[2].outcome_label, len(s[2].players)) == ("Diving Header", 1, 1, "Goal", 3)
    assert not s[3].placed and ME.skipped_shots(rows).first().n_skipped == 1
    f = jobs.shot_table(ev).collect()
    assert len(f) == 1 and f[0].shot_body_part == "Other" and f[0].defenders_in_path == 1
    assert f[0].gk_goal_line_distance == pytest.approx(120 - 104.5 * 120 / 105)
    scored = rows.where("placed").select("match_id", "shooter_id", "period", "game_clock_min").withColumn("xG", F.lit(0.4))
    assert {(r.player_id, r.n) for r in jobs.vendor_pass_quality(ev, scored).where("window_start_min = 0").collect()} == {(70, 1), (80, 1)}


def test_curves_missing_and_sinks(spark, tmp_path):
    a = tmp_path / "in" / "case_x" / "source"
    a.mkdir(parents=True)
    (a / "04_speed_roll10_phi.csv").write_text("section,minute,phi_roll10\ns,1,0.25\ns,50,0.5\ns,bad,0.5\ns,60,\n")
    (a / "01f_pc_synergy_m_80_1450_timewin.csv").write_text("section,period,minute,m\ns,1,1,0.5\n")
    cur = C.read_curves(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, cur.drop("source_row").collect())) == [("case_x", 1, 1.0, "speed_phi", 0.25), ("case_x", 2, 50.0, "speed_phi", 0.5)]
    assert C.missing_series(cur).count() == 6
    out = jobs.mix_cases(cur).orderBy("period", "minute").collect()
    assert [(r.period, r.minute, r.kinematic, r.cognitive, r.both) for r in out] == [(1, 1.0, 0.25, None, 0.25), (2, 50.0, 0.5, None, 0.5)]
    for fmt in ("csv", "parquet"):
        C.write_table(cur, str(tmp_path / fmt), by=["case"], fmt=fmt)
        assert (tmp_path / fmt / "case=case_x").is_dir()
    with pytest.raises(FileNotFoundError):
        C.read_curves(spark, str(tmp_path / "csv"))


def test_curves_are_found_by_name(spark, tmp_path):
    """Columns permuted, missing and added from case to case; equal minutes in the order of their file."""
    for case, text in {
        "a": "section,period,minute,m,m_w1,m_w3\ns,1,1,0.1,0.2,0.3\ns,1,3,0.1,0.2,0.5\ns,1,3,0.1,0.2,0.4\ns,1,5,0.1,0.2,0.9\n",
        "b b": "\ufeffm_w3,m,minute,period\n0.3,0.1,1,1\n", "c": "m,minute\n1,2\n", "d": 'note,m_w3,minute,m_w3\r\n"x, y",0.6,50,9\r\n', "e": "",
    }.items():
        f = tmp_path / case / "source"
        f.mkdir(parents=True)
        (f / "01f_pc_synergy_m_80_1450_timewin.csv").write_text(text)
        (f / "other.csv").write_text("m_w3,minute\n7,7\n")
    cur = C.read_curves(spark, str(tmp_path))
    got = sorted((r.case, r.period, r.minute, r.series, r.value) for r in cur.collect())
    assert got == [("a", 1, 1.0, "tight_w3", 0.3), ("a", 1, 3.0, "tight_w3", 0.4), ("a", 1, 3.0, "tight_w3", 0.5), ("a", 1, 5.0, "tight_w3", 0.9), ("b b", 1, 1.0, "tight_w3", 0.3), ("d", 2, 50.0, "tight_w3", 0.6)]
    grid = {r.minute: r.value for r in M.interpolate(cur.where("case = 'a'"), ["case"]).collect()}
    want = dict(zip(range(1, 6), np.interp(range(1, 6), [1, 3, 3, 5], [0.3, 0.5, 0.4, 0.9])))
    assert grid == pytest.approx(want)


def test_curve_paths_are_not_matched_per_row(spark, tmp_path, capsys):
    """Lines are neither sorted nor searched by pattern to find a file's header and case; a later line is no header."""
    name = "01f_pc_synergy_m_80_1450_timewin.csv"
    for path, text in {
        f"a%20+b/source/{name}/part-0.csv": '"minu"te,m_w3\n1,0.3\nminute,m_w3\n', f"c/{name}/part-1.csv": "minute,m_w3\n2,0.4\n",
        f"d/{name}": "minute,m_w3\n3,0.5\n", f"e/source/{name}": "clock,m_w3\nminute,m_w3\n4,0.6\n", "f/source/minute.csv": "minute,m_w3\n5,0.7\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    cur = C.read_curves(spark, str(tmp_path)).drop("source_row")
    assert sorted((r.case, r.minute, r.value) for r in cur.collect()) == [("a%20+b", 1.0, 0.3), ("c", 2.0, 0.4), ("d", 3.0, 0.5)]
    C.headers(spark, str(tmp_path)).explain("simple")
    lines = capsys.readouterr().out.split("HashAggregate")[-1]
    assert "min(row" in lines and "FileScan text" in lines and "regexp" not in lines
    cur.explain("simple")
    assert "regexp" not in capsys.readouterr().out


@pytest.mark.parametrize("ball, x", [([{"x": 10.0, "y": 4.0}], 10.0), ({"x": 10.0, "y": "4"}, 10.0), ([], -40.0), ({"x": None, "y": 1}, -40.0), (None, -40.0), ([{"x": 1}], -40.0)])
def test_ball_shapes(spark, root, ball, x):
    e = EVENTS[1] | {"ball": ball}
    (root / "shapes").mkdir(exist_ok=True)
    (root / "shapes" / "300_events.json").write_text(json.dumps([e, EVENTS[1] | {"ball": [{"x": 0, "y": 0}], "gameEventId": 9}]))
    got = {r.gameEventId: r.x for r in ME.shots(ME.read_events(spark, f"{root}/shapes")).collect()}
    assert got == {2: pytest.approx((52.5 - x) * 120 / 105), 9: pytest.approx(60.0)}


def test_stream_players(spark, root, squad, tmp_path):
    out, ck = str(tmp_path / "rows"), str(tmp_path / "ck")
    for _ in range(2):  # the second run finds nothing new
        ST.append_available(ST.stream_players(spark, f"{root}/tracking/*.jsonl*", squad), out, ck)
    assert spark.read.parquet(out).count() == 6


def test_events_are_parsed_once(spark, capsys):
    from keystride.sources import match_events as ME

    lines = spark.createDataFrame([("m", '{"gameEventId": 1, "possessionEvents": {"possessionEventType": "SH"}}'), ("m", "junk"), ("n", None)], "match_id string, value string")
    ME.shots(ME.parse_events(lines)).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("from_json(StructField(") == 1
    assert [(r.match_id, r.gameEventId) for r in ME.parse_events(lines).orderBy("match_id", F.col("gameEventId").desc()).collect()] == [("m", 1), ("m", None), ("n", None)]
