"""Whole jobs over all matches and players at once, built from the operators.

A *track* has ``match_id, player_id, period, frameNum, video_time_s, periodGameClockTime, x, y`` (and
``team_id`` where teams matter). A half of one player is bounded in real matches: ``whole`` says so, and then ordered
passes are windows per half; else rows are dealt to range partitions.

A panel is written once, by match, and keeps the number of its rows' range partition. Tables made of it are lazy,
and each reads the columns it needs.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A, events as E, fits, joins as J, kinematics as K, mix as M, nearest as N, possession as P, shots as X, windows as W
from ..operators.ordered import Line, range_around, settle, short_keys
from ..session import stage, written
from ..sources import match_events

class Tables(dict):
    """Tables by name, given as functions and made of them once, when they are asked for."""

    def __getitem__(self, name: str):
        made = super().__getitem__(name)
        if callable(made) and not isinstance(made, DataFrame):
            self[name] = made = made()
        return made


PLAYER = ("match_id", "player_id")
HALF = (*PLAYER, "period")
HALF_STARTS = {1: 0.0, 2: 45.0}
#: Digits at which the report ranks means and puts values into cells, so that the order of a sum decides no tie and no border.
REPORT_DIGITS = 9


def half_line(whole: bool = False) -> Line:
    return Line(HALF, "video_time_s", ("frameNum",), whole)


def player_line(whole: bool = False) -> Line:
    return Line(PLAYER, "video_time_s", ("frameNum",), whole)


def kinematic_panel(track: DataFrame, whole: bool = False, **kw) -> DataFrame:
    """Track with velocities, accelerations, jerks and step distances per half."""
    track, line = settle(track, half_line(whole))
    d = K.stride_kinematics(track, line, **kw)
    d = K.step_distance(d, line)
    # every later table reads the panel: one folder per match, a few files each
    return written(d.hint("rebalance", "match_id"), "match_id").select(d.columns)


def player_minutes(panel: DataFrame, whole: bool = False) -> DataFrame:
    """Long regulation minutes of every player and metric."""
    return W.regulation_minutes(panel, player_line(whole), "periodGameClockTime")


def relative_speed(panel: DataFrame, positions: DataFrame, profiles: DataFrame, metrics=("speed",), whole: bool = False) -> DataFrame:
    """Scores of every player-minute against the detailed profile of the player's position."""
    minutes = player_minutes(panel, whole).where(F.col("metric").isin(*metrics)).join(positions, list(PLAYER))
    ref = profiles.where((F.col("level") == "detailed") & F.col("metric").isin(*metrics)).withColumnRenamed("group", "position")
    return fits.relative_scores(minutes, ref, [*PLAYER, "position", "metric"], ["position", "metric"])


def relative_speed_tables(scores: DataFrame) -> dict[str, DataFrame]:
    """End-of-half values and batch summary of :func:`relative_speed`."""
    by = [*PLAYER, "metric"]
    return {"half_ends": fits.half_ends(scores, by), "summary": fits.batch_summary(scores, by)}


def sprints(panel: DataFrame, whole: bool = False, speed: str = "speed", **kw) -> DataFrame:
    """Merged high-intensity events with recovery restarted per half."""
    line = half_line(whole)
    d = panel.withColumn("clock_min", S.clock_minutes(F.col("periodGameClockTime")))
    d = K.time_derivative(d, line, "a_tan_use", "j_tan")
    return E.sprint_table(d, line, speed, PLAYER, clock="clock_min", step="step_dist", acc="a_tan_use", jerk="j_tan", **kw)


def sprint_recovery(table: DataFrame, *, rows: int = 6, min_rows: int = 4, min_range: float = 20.0, whole: bool = False, scales: Mapping[str, float] = fits.SCALE_Y, s_x: float = fits.SCALE_X) -> DataFrame:
    """Angle curves of output over recovery for each metric, from a sprint table."""
    out = None
    for y, s_y in scales.items():
        line = Line(HALF, "start_time_s", ("end_time_s",), whole)
        d = fits.rolling_line(table, line, "recovery_before_s", y, table_keys=PLAYER, rows=rows, min_rows=min_rows, min_range=min_range, s_x=s_x, s_y=s_y, x_ref=s_x)
        c = fits.line_angle_curve(d, y, PLAYER, "start_clock_min")
        out = c if out is None else out.unionByName(c)
    return out


def sprint_settings(table: DataFrame, whole: bool = False, settings=fits.SETTINGS, scales: Mapping[str, float] = fits.SCALE_Y, s_x: float = fits.SCALE_X) -> DataFrame:
    """How the choice of window, fewest rows and range changes the angle scores of a sprint table, per player and metric."""
    line = Line(HALF, "start_time_s", ("end_time_s",), whole)
    table = table if whole else stage(table)
    by_player = Line(PLAYER, "start_time_s", ("end_time_s",), whole)
    return fits.setting_table(table, line, by_player, "recovery_before_s", scales, s_x, settings)


def local_work_rate(panel: DataFrame, k: int = 2, whole: bool = False, bin_s: float = 60.0, coverage: float = 0.75, floor_m: float = 50.0, labels: str | None = None) -> dict[str, DataFrame]:
    """Minutes of every player against the nearest ``k`` of both sides, and what follows from them.

    ``minutes`` has residuals, phase, nine-minute medians, distances to date with their shares (null below ``floor_m``) and, with a
    ``labels`` column in the panel, the possession class of each minute. ``lead`` holds the lead curves, ``phase_delta`` late less early medians,
    ``clips`` how often the lead leaves its range. A half has an hour of minutes at most, so its windows are whole.
    """
    frame = ["match_id", "period", "frameNum"]
    near = N.k_nearest(panel, frame, "player_id", "team_id", k)
    clock = panel.select(*frame, "player_id", "periodGameClockTime")
    near = near.join(clock, [*frame, "player_id"])
    minutes = N.nearest_minutes(near, N.fps_of(panel, player_line(whole)), [*HALF], "periodGameClockTime", coverage, bin_s)
    line = Line(HALF, "t_centre_min", (), True)
    minutes = minutes.withColumn("phase", S.match_phase(F.col("period"), F.col("t_centre_min")))
    if labels:
        points = panel.select(*HALF, S.clock_minutes(F.col("periodGameClockTime")).alias("_clock"), labels)
        centres = minutes.select(*HALF, "t_centre_min")
        minutes = minutes.join(W.majority_label(centres, points, HALF, "t_centre_min", "_clock", labels, bin_s / 60.0), [*HALF, "t_centre_min"], "left")
    # a frame of nine minutes holds nine rows
    minutes = range_around(minutes, line, {f"{c}_med9": (f"percentile(`{c}`, 0.5D)", 4.5, 4.5) for c in ("d_resid_tm", "d_resid_op")})
    sums = {"D_player": F.col("d_player"), "D_tm": F.col("d_tm"), "D_op": F.col("d_op")}
    minutes = W.period_to_date(minutes, line, sums)
    minutes = minutes.withColumns({f"share_{r}": S.distance_share(F.col("D_player"), F.col(f"D_{r}"), floor_m) for r in ("tm", "op")})
    lead = W.signed_lead(minutes, line, {"d_resid_tm": "teammates", "d_resid_op": "opponents"})
    return {
        "minutes": minutes, "lead": lead, "phase_delta": A.phase_delta(minutes, HALF, "phase", ["d_resid_tm", "d_resid_op"]),
        "clips": A.clip_report(lead, [*HALF, "reference"], "C", S.LEAD_WIDE_HALF_RANGE_M),
    }


def half_start() -> Column:
    """Clock minute at which a half begins; later periods by the usual match clock."""
    p = F.col("period")
    return F.when(p == 1, 0.0).when(p == 2, 45.0).when(p == 3, 90.0).otherwise(105.0)


def pass_quality(passes: DataFrame, shots: DataFrame, periods=(1, 2)) -> DataFrame:
    """Hopping pass success of every player-half, lifted by nearby shots.

    ``passes``: ``(match_id, player_id, period, game_clock_min, success)``; ``shots``: ``(match_id,
    player_id, period, game_clock_min, xG)``.
    """
    p = passes.where(F.col("period").isin(*periods))
    curve = W.hop_success(p, HALF, "game_clock_min", "success", half_start())
    d = W.kernel_modifier(curve, shots, HALF, "t_min", "game_clock_min", "xG")
    return d.withColumn("C", S.composite(F.col("P"), F.col("w"), F.col("Q")))


def pass_totals(passes: DataFrame, periods=(1, 2)) -> DataFrame:
    """Passes, successful ones and their percentage of every player-half."""
    return A.half_totals(passes.where(F.col("period").isin(*periods)), HALF, "success")


def vendor_pass_quality(events: DataFrame, scored: DataFrame) -> DataFrame:
    """:func:`pass_quality` straight from vendor events and a table of scored shots."""
    s = scored.withColumnRenamed("shooter_id", "player_id")
    return pass_quality(match_events.passes(events), s)


def shot_table(events: DataFrame) -> DataFrame:
    """Model features of every placed shot."""
    return X.shot_features(match_events.shots(events).where("placed"))


def synergy_curve(df: DataFrame, keys=PLAYER, whole: bool = False) -> DataFrame:
    """Capped synergy (kept where already computed) with its centred means."""
    line = Line((*keys, "period"), "minute", (), whole)
    cols = df.columns
    if "minute" not in cols:
        df = df.withColumn("minute", S.clock_minutes(F.col("game_clock_s")))
    if "m_80_1450" in cols:
        d = df.withColumn("m", F.col("m_80_1450"))
        return W.centred_mean(d, line, "m", {"m_w1": 1.0, "m_w3": 3.0, "m_w5": 5.0, "m_w10": 10.0})
    return W.synergy_windows(df, line, "individual_synergy", "team_synergy")


def standing_curve(df: DataFrame) -> DataFrame:
    return fits.standing_curve(df)


def possession(otb: DataFrame, dead: DataFrame, frames: DataFrame, match=("match_id",), *, radius: float | Column, focal_player: Column, time: str = "video_time_s", ident: str = "gameEventId", frame: str = "frameNum", whole: bool = False) -> DataFrame:
    """Event-based (``_a``) and geometry-based (``_b``) possession labels of every frame.

    ``otb`` has ``t0, t1, label, how, sequence, player_otb, is_instant``; ``frames`` the geometry columns
    of :func:`nearest.team_distances`.
    """
    spans = P.possession_spans(otb, dead, match, ident, whole=whole)
    spans = stage(spans)
    return _both_labels(frames, otb, spans, match, radius, focal_player, time, frame, whole)


def _both_labels(frames: DataFrame, otb: DataFrame, spans: DataFrame, match, radius, focal_player: Column, time: str, frame: str, whole: bool) -> DataFrame:
    whole = whole or (short_keys(frames, match) and short_keys(otb, match))
    a = P.label_frames(frames, otb, spans, match, time=time, whole=whole)
    a = a.withColumnsRenamed({"team_possession": "team_a", "possession_context": "context_a", "player_otb": "player_a"})
    a = a.withColumns({"event_dead": F.col("team_a") == S.DEAD, "fallback": F.col("team_a")})
    a = a if whole else stage(a)
    b = P.carry_possession(P.zone_states(a, radius), Line(tuple(match), time, (frame,), whole), focal_player=focal_player)
    return b.withColumnsRenamed({"team_possession": "team_b", "possession_context": "context_b", "player_otb": "player_b"})


def profiles(panel: DataFrame, positions: DataFrame, whole: bool = False) -> DataFrame:
    """Reference profiles of all matches; players with fewer than ten frames are left out."""
    sizes = panel.groupBy(*PLAYER).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 10).drop("_n")
    minutes = player_minutes(panel, whole).join(sizes, list(PLAYER), "left_semi").join(positions, list(PLAYER))
    return A.reference_profiles(minutes, "position")


def mix_cases(curves: DataFrame, whole: bool = True) -> DataFrame:
    return M.mix(curves, ["case"], whole=whole)


def possession_from_events(
    events: DataFrame, frames: DataFrame, roster: DataFrame, index: DataFrame | None = None, match=("match_id",), *, focal_home: Column, focal_team: Column, focal_player: Column,
    time: str = "video_time_s", frame: str = "frameNum", sync: float = 0.15, bounds: bool = True, whole: bool = False, epsilon: float = P.INSTANT_S,
) -> Tables:
    """Possession of every frame, from event rows and frames with both sides' players and the ball: the tables of all its steps.

    ``events``: flat rows as :func:`match_events.flat_events` gives them, with ``gameEventId``. ``frames``: nested arrays ``home``,
    ``away`` of ``(jerseyNum, x, y)`` with ``ball_x, ball_y``. ``roster``: ``side, shirt, player_id, team_id``. ``index`` is
    the tracking's own event index. The zone radius is what the measured actor distances give, over all matches.
    """
    m = list(match)
    on_ball = events.where(F.col("event_kind") == "OTB")
    otb = P.on_ball_intervals(on_ball, m, "gameEventId", "_order", epsilon)
    if index is not None:
        otb = J.enrich_intervals(otb, index, m, "gameEventId")
    label = F.when(F.col("team_id") == focal_team, S.FOCAL).when(F.col("team_id").isNotNull(), S.OPP)
    mine = F.col("player_id") == focal_player
    who = F.when(mine, S.FOCAL).when(F.col("team_id") == focal_team, S.TEAMMATE).when(F.col("team_id").isNotNull(), S.OPPONENT).otherwise(S.NOBODY)
    otb = stage(otb.withColumns({"label": label, "how": F.when(label.isNotNull(), "team_id").otherwise("none"), "player_otb": F.coalesce(who, F.lit(S.NOBODY))}))
    dead = P.dead_markers(events, m)

    geo = frames.select("*", N.nearest_to_ball(F.col("home"), F.col("ball_x"), F.col("ball_y")).alias("_h"), N.nearest_to_ball(F.col("away"), F.col("ball_x"), F.col("ball_y")).alias("_a"))
    geo = geo.withColumns({"d_home": F.col("_h.d"), "jersey_home": F.col("_h.jersey"), "d_away": F.col("_a.d"), "jersey_away": F.col("_a.jersey")})
    distances = N.team_distances(geo.drop("_h", "_a"), focal_home, roster, m)

    # the actor's own distance to the ball around each on-ball event
    def players(side: str) -> Column:
        return F.transform(side, lambda p: F.struct(F.lit(side).alias("side"), p["jerseyNum"].cast("string").alias("shirt"), p["x"].alias("x"), p["y"].alias("y")))

    flag = [c for c in ("ball_visible",) if c in frames.columns]
    placed = frames.select(*m, time, "ball_x", "ball_y", *flag, F.explode(F.concat(players("home"), players("away"))).alias("_p"))
    ids = roster.select(*m, "side", F.col("shirt").cast("string").alias("shirt"), "player_id")
    actors = placed.select(*m, F.col(time).alias("_ft"), "_p.*", "ball_x", "ball_y", *flag).join(ids, [*m, "side", "shirt"])
    seen = F.col("ball_visible") if flag else F.lit(True)
    actors = actors.select(*m, "player_id", "_ft", F.hypot(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y")).alias("_dist"), seen.alias("_seen"))
    touches = otb.where(F.col("player_id").isNotNull()).select(*m, "player_id", "gameEventId", F.col("t0").alias("_t"))
    passes = events.where((F.col("poss_type") == "PA") & (F.col("pass_outcome") == "C"))
    passes = passes.select(*m, "gameEventId", F.coalesce("eventTime", "startTime").alias("_pt"), "receiver_id").where(F.col("_pt").isNotNull())
    limits = frames.groupBy(*m).agg(F.min(time).alias("t_min"), F.max(time).alias("t_max")) if bounds else None
    out = Tables()

    def radius() -> Column:
        return F.coalesce(out["radius"].select("rpz").scalar(), F.lit(P.DEFAULT_RADIUS))

    def recovered() -> DataFrame:
        instants = otb.where(F.col("is_instant")).select(*m, "gameEventId", F.col("t0").alias("_t"), F.col("player_id").alias("_actor"))
        own = F.when(F.col("player_id_focal_nearest") == F.col("_actor"), F.col("d_focal")).when(F.col("player_id_opp_nearest") == F.col("_actor"), F.col("d_opp"))
        near = out["geometry"].select(*m, time, "d_focal", "d_opp", "player_id_focal_nearest", "player_id_opp_nearest")
        return J.instant_recovery(instants, near, m, "gameEventId", "_t", time, own, radius())

    def phases() -> DataFrame:
        keys = [*m, *[c for c in ("period",) if c in frames.columns]]
        return E.phase_durations(out["classes"], Line(tuple(keys), time, (frame,), whole), "poss_class")

    out |= {
        "intervals": lambda: otb,
        "geometry": lambda: stage(distances),
        "actor_distances": lambda: J.actor_ball_distance(touches, actors, [*m, "player_id"], "gameEventId", "_t", "_ft", distance="_dist", visible="_seen", sync=sync),
        "radius": lambda: stage(A.radius_calibration(out["actor_distances"], [], "dist_m")),
        "spans": lambda: stage(P.possession_spans(otb.where(F.col("label").isNotNull()), dead, match, "gameEventId", limits=limits, whole=whole)),
        "labels": lambda: _both_labels(out["geometry"], otb, out["spans"], match, radius(), focal_player, time, frame, whole),
        "classes": lambda: out["labels"].withColumn("poss_class", S.collapse_team(F.col("team_b"))),
        "recovered": recovered,
        "handoff": lambda: J.pass_handoffs(passes, otb, m, "gameEventId", "_pt", "receiver_id", "t0", "player_id"),
        "phases": phases,
    }
    return out


def possession_windows(classes: DataFrame, keys, minute: str, label: str = "poss_class", **kw) -> dict[str, DataFrame]:
    """Shares of the possession classes in sliding windows, and how they depend on the windows' length."""
    sweep = {k: v for k, v in kw.items() if k in ("min_frames",)}
    return {"proportions": W.label_proportions(classes, keys, minute, label, **kw), "sweep": W.window_length_sweep(classes, keys, minute, label, **sweep)}


def player_report(
    panel: DataFrame, *, whole: bool = False, min_frames: int = W.MIN_FRAMES, win: float = W.WINDOW_MIN, step: float = W.STEP_MIN, labels: str | None = None,
    fingerprint_s: float = 60.0, heat_s: tuple[float, float] = (180.0, 120.0), zoom: str = "full", near: Mapping[str, object] | None = None,
) -> Tables:
    """The report's tables for every player-half; a table is planned when it is asked for, and nothing runs before that.

    Peaks, distance, one-second bins, heat counts, speed profile and fingerprint; with teams, peers, presence and, with ``near`` (arguments of
    :func:`local_work_rate`), the tables against the nearest players; with a ``labels`` column of possession classes, phases, their
    statistics, class shares and window averages by class.
    """
    d = panel.withColumn("clock_min", S.clock_minutes(F.col("periodGameClockTime")))
    kw = {"win": win, "step": step, "min_frames": min_frames}
    match = ["match_id", "period"]
    out = Tables()

    def heat() -> DataFrame:
        tops, bins = W.heat_scale(zoom)
        exact = out["seconds"].withColumns({c: S.at_digits(F.col(c), REPORT_DIGITS) for c in ("periodGameClockTime", *tops)})
        parts = [
            W.sliding_histogram(exact, HALF, "periodGameClockTime", metric, top, bins, *heat_s).withColumn("metric", F.lit(metric)) for metric, top in tops.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def labelled() -> DataFrame:
        centres = out["peaks"].join(out["distance"], [*HALF, "t_centre"])
        return W.majority_label(centres, d.select(*HALF, "clock_min", labels), HALF, "t_centre", "clock_min", labels, win)

    out |= {
        "peaks": lambda: W.rolling_peaks(d, HALF, "clock_min", ["speed", "acc_use", "jerk_use"], **kw),
        "distance": lambda: W.rolling_distance(d, HALF, "clock_min", **kw),
        "seconds": lambda: W.second_bins(d, HALF, "periodGameClockTime"),
        "heat": heat,
        "speed_profile": lambda: A.speed_profile(d, HALF, "speed", "a_tan_use"),
        "fingerprint": lambda: W.fingerprint(d, half_line(whole), fingerprint_s, clock="periodGameClockTime"),
    }
    if "team_id" in panel.columns:
        out |= {
            "peers": lambda: W.peer_percentiles(d, match, "player_id", "team_id", "clock_min", digits=REPORT_DIGITS, **kw),
            "presence": lambda: W.presence_diagnostics(out["peers"], match),
            "presence_by_player": lambda: W.presence_by_player(out["peers"], d, match, "player_id"),
        }
        if near is not None:
            against = Tables(all=lambda: local_work_rate(panel, whole=whole, labels=labels, **near))
            out |= {f"near_{n}": (lambda n=n: against["all"][n]) for n in ("minutes", "lead", "phase_delta", "clips")}
    if labels:
        out |= {
            "phases": lambda: E.phase_durations(d, half_line(whole), labels),
            "phase_stats": lambda: A.segment_stats(out["phases"], labels, "duration_s"),
            "labelled_windows": labelled,
            "class_averages": lambda: W.class_averages(out["labelled_windows"], HALF, "poss_class", "max_speed"),
            "class_shares": lambda: W.class_averages(d, HALF, labels, "speed"),
        }
    return out
