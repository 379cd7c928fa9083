"""On-ball intervals, possession spans and frame-wise possession states, for all matches at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import stage
from .joins import as_of_label
from .ordered import Line, deal, dealt, neighbour, prefix, short_keys

INSTANT_S = 1.0 / 29.97
DEFAULT_RADIUS = 1.5


def _cut(df: DataFrame, whole: bool) -> DataFrame:
    """Sliced passes read their input twice; a stored stage keeps a chain of them linear."""
    return df if whole else stage(df)


def on_ball_intervals(events: DataFrame, match: Sequence[str], event: str, order: str, epsilon: float = INSTANT_S) -> DataFrame:
    """One interval per on-ball event id: outer times, first ids, the types in order of appearance.

    Input rows: ``startTime, endTime, duration, player_id, team_id, sequence, period, poss_type``.
    """
    g = [*match, event]
    first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ("player_id", "team_id", "sequence", "period")}
    # types are made distinct before they are gathered
    types = events.where(F.col("poss_type").isNotNull()).groupBy(*g, "poss_type").agg(F.min(order).alias("_o"))
    types = types.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("_o", "poss_type"))).alias("_ty"))
    types = types.select(*g, F.array_join(F.transform("_ty", lambda t: t["poss_type"]), ",").alias("poss_types"))
    d = events.groupBy(*g).agg(
        F.min("startTime").alias("t0"), F.max("endTime").alias("t1"), F.max("duration").alias("duration"), *first.values(),
        F.count(F.lit(1)).alias("n_rows"),
    )
    span = F.col("t1") - F.col("t0")
    d = d.withColumn("duration", F.coalesce("duration", span))
    instant = (F.coalesce("duration", F.lit(0.0)) <= 0) | (F.coalesce(span, F.lit(0.0)) <= 0)
    d = d.withColumn("is_instant", instant).withColumn("t1", F.when(F.col("is_instant"), F.col("t0") + epsilon).otherwise(F.col("t1")))
    d = d.where(F.col("t0").isNotNull() & F.col("t1").isNotNull()).join(types, g, "left")
    return d.withColumn("poss_types", F.coalesce("poss_types", F.lit("")))


def dead_markers(events: DataFrame, match: Sequence[str], kind: str = "event_kind") -> DataFrame:
    """Out-of-play and end rows at their event time, else their start time."""
    t = F.coalesce("eventTime", "startTime")
    d = events.where(F.col(kind).isin("OUT", "END")).withColumn("t_dead", t)
    return d.where(F.col("t_dead").isNotNull()).select(*match, "t_dead")


def possession_spans(
    otb: DataFrame, dead: DataFrame, match: Sequence[str], ident: str, *, whole: bool = False,
    limits: DataFrame | None = None, respect_sequence: bool = True,
) -> DataFrame:
    """Team possession as half-open spans from on-ball intervals and dead markers.

    ``otb`` has ``t0, t1, label, how, sequence``; ``limits`` optional ``(match, t_min, t_max)``. A span
    breaks at a marker (dead until the next interval), at a team change, and at a sequence change of
    the same team (it then ends with its last interval and leaves a gap). No walk: breaks are flags,
    spans are running sums of flags.
    """
    m = tuple(match)
    whole = whole or (short_keys(otb, m) and short_keys(dead, m))
    line = Line(m, "t0", (ident,), whole)
    # markers next to each interval; an interval sorts before a marker of the same instant
    marks = dead.select(*m, F.col("t_dead").alias("t0")).distinct()
    by_time = Line(m, "t0", (), whole)
    marks = neighbour(marks, by_time, {"_next": F.col("t0")}, following=True)
    marks = marks.withColumns({"_kind": F.lit(1), "_mark": F.struct(F.col("t0").alias("t"), F.col("_next").alias("n"))})
    both = otb.select(*m, ident, "t0", "t1", "label", "how", "sequence", F.lit(0).alias("_kind"))
    both = both.unionByName(marks.select(*m, "t0", "_kind", "_mark"), allowMissingColumns=True)
    pair = Line(m, "t0", ("_kind", ident), whole)
    both = deal(both, pair)
    both = prefix(both, pair, {"_last": ("last", F.col("_mark.t"))})
    both = prefix(both, pair, {"_coming": ("last", F.col("_mark"))}, reverse=True)
    d = deal(both.where(F.col("_kind") == 0).drop("_kind", "_mark"), line)

    d = neighbour(d, line, {"_p": F.struct("t0", "label")})
    changed = F.col("_p").isNull() | (F.col("_p.label") != F.col("label"))
    d = d.withColumn("_hard", (changed | F.coalesce(F.col("_last") > F.col("_p.t0"), F.lit(False))))

    def sequence_breaks(d: DataFrame, hard: str, out: str) -> DataFrame:
        if not respect_sequence:
            return d.withColumn(out, F.lit(False))
        d = prefix(d, line, {"_h": ("sum", F.col(hard).cast("int"))})
        d = prefix(d, line.by("_h"), {"_seq": ("last", F.col("sequence"))}, inclusive=False)
        return d.withColumn(out, F.coalesce(F.col("sequence") != F.col("_seq"), F.lit(False))).drop("_h", "_seq")

    # a marker exactly on the previous start counts unless that interval opened its span
    d = sequence_breaks(d, "_hard", "_soft0")
    d = _cut(neighbour(d, line, {"_opened": F.col("_hard") | F.col("_soft0")}), whole)
    on_start = F.coalesce((F.col("_last") == F.col("_p.t0")) & ~F.col("_opened"), F.lit(False))
    d = d.withColumn("_hard2", F.col("_hard") | on_start)
    d = sequence_breaks(d, "_hard2", "_soft")
    d = d.withColumn("_start", F.col("_hard2") | F.col("_soft"))
    d = _cut(prefix(d, line, {"_span": ("sum", F.col("_start").cast("int"))}), whole)

    after = F.when(F.col("_start") & (F.col("_coming.t") == F.col("t0")), F.col("_coming.n")).otherwise(F.col("_coming.t"))
    d = d.withColumn("_stop", after)
    order = F.struct("t0", ident)
    spans = d.groupBy(*m, "_span").agg(
        F.min("t0").alias("t0"), F.min_by("label", order).alias("label"), F.min_by("how", order).alias("how"),
        F.max_by("t1", order).alias("_t1"), F.max_by("_stop", order).alias("_stop"),
    )
    spans = neighbour(spans, Line(m, "t0", ("_span",), whole), {"_n": F.struct("t0", "label")}, following=True)
    ends = d.groupBy(*m).agg(F.max("t1").alias("_tend"), F.min("t0").alias("_tfirst"))
    if limits is not None:
        ends = ends.join(limits, list(m), "left").withColumn("_tend", F.coalesce("t_max", "_tend"))
    else:
        ends = ends.withColumn("t_min", F.lit(None).cast("double"))
    spans = spans.join(ends.select(*m, "_tend"), list(m))
    upto = F.coalesce(F.col("_n.t0"), F.col("_tend"))
    died = F.coalesce(F.col("_stop") < upto, F.lit(False))
    live_end = (
        F.when(died, F.col("_stop"))
        .when(F.col("_n").isNull() | (F.col("_n.label") != F.col("label")), upto)
        .otherwise(F.least(F.col("_t1"), F.col("_n.t0")))
    )
    live = F.struct(F.col("t0").alias("t0"), live_end.alias("t1"), F.col("label").alias("label"), F.concat(F.lit("otb_start:"), "how").alias("reason"))
    gone = F.struct(F.col("_stop").alias("t0"), upto.alias("t1"), F.lit(S.DEAD).alias("label"), F.lit("after_out_or_end").alias("reason"))
    rows = spans.select(*m, F.inline(F.when(died, F.array(live, gone)).otherwise(F.array(live))))
    first_mark = dead.groupBy(*m).agg(F.min("t_dead").alias("_fm"))
    lead = ends.join(first_mark, list(m)).where((F.col("t_min") < F.col("_tfirst")) & (F.col("_fm") <= F.col("_tfirst")))
    lead = lead.select(*m, F.col("t_min").alias("t0"), F.col("_tfirst").alias("t1"), F.lit(S.DEAD).alias("label"), F.lit("pre_first_otb").alias("reason"))
    # touching spans of one label become one
    out = Line(m, "t0", ("t1",), whole)
    rows = deal(rows.unionByName(lead).where(F.col("t1") > F.col("t0")), out)
    rows = neighbour(rows, out, {"_q": F.struct("t1", "label")})
    touch = (F.col("_q.label") == F.col("label")) & (F.abs(F.col("t0") - F.col("_q.t1")) < 1e-6)
    rows = prefix(rows.withColumn("_new", F.when(touch, 0).otherwise(1)), out, {"_id": ("sum", F.col("_new"))})
    rows = rows.groupBy(*m, "_id").agg(F.min("t0").alias("_a"), F.max("t1").alias("t1"), F.first("label").alias("team_possession"), F.min_by("reason", "t0").alias("reason"))
    return rows.select(*m, F.col("_a").alias("t0"), "t1", "team_possession", "reason")


def zone_states(geo: DataFrame, r_pz: float | Column, r_dz: float | Column | None = None) -> DataFrame:
    """CONTROL / DUEL / FREE per frame from both sides' ball distances, with the side in control."""
    r_pz = F.lit(r_pz) if isinstance(r_pz, (int, float)) else r_pz
    r_dz = r_pz if r_dz is None else (F.lit(r_dz) if isinstance(r_dz, (int, float)) else r_dz)
    ball = F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()

    def near(c: str, r: Column) -> Column:
        return ball & F.coalesce(F.col(c) < r, F.lit(False))

    focal, opp = near("d_focal", r_pz), near("d_opp", r_pz)
    d = geo.withColumn("ball_state", F.when(near("d_focal", r_dz) & near("d_opp", r_dz), S.DUEL).when(focal | opp, "CONTROL").otherwise("FREE"))
    side = F.when(focal & (~opp | (F.col("d_focal") <= F.col("d_opp"))), S.FOCAL).otherwise(S.OPP)
    d = d.withColumn("control_team", F.when(F.col("ball_state") == "CONTROL", side))
    who = F.when(F.col("control_team") == S.FOCAL, F.col("player_id_focal_nearest")).when(F.col("control_team") == S.OPP, F.col("player_id_opp_nearest"))
    return d.withColumn("control_player_id", who)


@dealt
def carry_possession(states: DataFrame, line: Line, *, dead: str = "event_dead", fallback: str | None = "fallback", focal_player: Column | None = None) -> DataFrame:
    """Team possession carried over free and contested frames, then player and context layers.

    Control sets the team and dead frames reset it. After a reset, the first usable fallback label
    sticks until the next control or dead frame. Dead frames show as DEAD in ``ball_state``.
    """
    hard = F.when(F.col(dead), S.DEAD).when(F.col("control_team").isNotNull(), F.col("control_team"))
    d = states.withColumn("_s", hard)
    d = d.withColumn("ball_state", F.when(F.col(dead), S.DEAD).otherwise(F.col("ball_state")))
    d = prefix(d, line, {"_seg": ("count", F.col("_s")), "_held": ("last", F.col("_s"))})
    d = _cut(d, line.whole)
    fb = F.col(fallback) if fallback else F.lit(None).cast("string")
    usable = F.when(F.col("_s").isNull() & fb.isin(S.FOCAL, S.OPP), fb)
    d = prefix(d, line.by("_seg"), {"_stuck": ("first", usable)})
    team = (
        F.when(F.col("_s").isNotNull(), F.col("_s"))
        .when(F.col("_held").isin(S.FOCAL, S.OPP), F.col("_held"))
        .when(F.col("_stuck").isNotNull(), F.col("_stuck"))
        .when(fb == S.DEAD, S.DEAD)
        .otherwise(S.UNRESOLVED)
    )
    d = d.withColumn("team_possession", team).drop("_s", "_seg", "_held", "_stuck")
    mine = F.coalesce(F.col("control_player_id") == focal_player, F.lit(False)) if focal_player is not None else F.lit(False)
    held = (F.col("ball_state") == "CONTROL") & F.col("control_player_id").isNotNull()
    player = (
        F.when(F.col("ball_state") == S.DUEL, S.DUEL)
        .when(held & (F.col("control_team") == S.FOCAL), F.when(mine, S.FOCAL).otherwise(S.TEAMMATE))
        .when(held, S.OPPONENT)
        .otherwise(S.NOBODY)
    )
    d = d.withColumn("player_otb", player)
    ctx = S.possession_context(F.when(F.col("player_otb") == S.DUEL, S.NOBODY).otherwise(F.col("player_otb")), F.col("team_possession"))
    return d.withColumn("possession_context", ctx)


def label_frames(frames: DataFrame, otb: DataFrame, spans: DataFrame, match: Sequence[str], *, time: str, frame: str | None = None, whole: bool = False) -> DataFrame:
    """On-ball player, instant flag, team span and context for every frame.

    ``otb`` carries ``player_otb`` and ``is_instant``. With ``frame`` the intervals hold on frame
    numbers (ends included), otherwise on ``[t0, t1)``.
    """
    values = {"player_otb": S.NOBODY, "is_instant": False}
    whole = whole or (short_keys(frames, match) and short_keys(otb, match))
    if frame:
        d = as_of_label(frames, otb, match, frame, "frame0", "frame1", values, whole=whole, closed=True)
    else:
        d = as_of_label(frames, otb, match, time, "t0", "t1", values, whole=whole)
    d = as_of_label(_cut(d, whole), spans, match, time, "t0", "t1", {"team_possession": S.UNRESOLVED}, whole=whole)
    return d.withColumn("possession_context", S.possession_context(F.col("player_otb"), F.col("team_possession")))
