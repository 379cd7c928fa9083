"""As-of labels, band-join choices and key attachments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import band_join
from .ordered import Line, prefix, run_starts, settle


def as_of_label(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    values: Mapping[str, object],
    *,
    whole: bool = False,
    closed: bool = False,
) -> DataFrame:
    """Label each point with the latest interval that began at or before it and has not ended.

    ``values`` maps interval columns to the default where none holds. ``closed`` includes the end.
    One pass over the union of both sides replaces a non-equi join, whatever the interval lengths.
    """
    keys = list(keys)
    iv = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *keys,
        F.col(start).cast("double").alias("_t"),
        F.lit(0).alias("_kind"),
        F.col(end).cast("double").alias("_end"),
        F.struct(F.col(end).cast("double").alias("_e"), *values).alias("_iv"),
    )
    pts = points.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    both = pts.unionByName(iv, allowMissingColumns=True)
    line = Line(tuple(keys), "_t", ("_kind", "_end"), whole)
    d = prefix(both, line, {"_hit": ("last", F.col("_iv"))}).where(F.col("_kind") == 1)
    inside = F.col("_t") <= F.col("_hit._e") if closed else F.col("_t") < F.col("_hit._e")
    labels = [F.coalesce(F.when(inside, F.col(f"_hit.{v}")), F.lit(default)).alias(v) for v, default in values.items()]
    return d.select("_row.*", *labels)


def nearest_in_time(points: DataFrame, frames: DataFrame, keys: Sequence[str], time: str, frame_time: str, cols: Sequence[str], *, whole: bool = False) -> DataFrame:
    """Attach the frame nearest in time to each point (the earlier one on a tie)."""
    keys = list(keys)
    pts = points.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.struct("*").alias("_row"))
    fr = frames.select(*keys, F.col(frame_time).alias("_t"), F.lit(1).alias("_kind"), F.struct(F.col(frame_time).alias("_ft"), *cols).alias("_fr"))
    line = Line(tuple(keys), "_t", ("_kind",), whole)
    d, line = settle(pts.unionByName(fr, allowMissingColumns=True), line)
    d = prefix(d, line, {"_before": ("last", F.col("_fr"))})
    d = prefix(d, line, {"_after": ("last", F.col("_fr"))}, reverse=True).where(F.col("_kind") == 0)
    later = F.col("_before").isNull() | (F.col("_after._ft") - F.col("_t") < F.col("_t") - F.col("_before._ft"))
    pick = F.when(F.col("_after").isNotNull() & later, F.col("_after")).otherwise(F.col("_before"))
    return d.withColumn("_pick", pick).select("_row.*", *[F.col(f"_pick.{c}").alias(c) for c in cols])


def attach_once(left: DataFrame, right: DataFrame, on: Sequence[str], cols: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Left join on keys after reducing the right side to its first row per key."""
    on = list(on)
    first = F.min_by(F.struct(*cols), F.struct(*order)) if order else F.first(F.struct(*cols))
    one = right.groupBy(*on).agg(first.alias("_one"))
    return left.join(one, on, "left").select(*left.columns, *[F.col(f"_one.{c}").alias(c) for c in cols])


def enrich_intervals(otb: DataFrame, index: DataFrame, match: Sequence[str], event: str) -> DataFrame:
    """Frame span, home-ball flag and sequence of the tracking index onto on-ball intervals."""
    d = attach_once(
        otb.drop("frame0", "frame1", "home_ball"), index, [*match, event],
        ["frame0", "frame1", "home_ball", "sequence_tracking"], order=["frame0"],
    )
    return d.withColumn("sequence", F.coalesce("sequence", "sequence_tracking")).drop("sequence_tracking")


def actor_ball_distance(events: DataFrame, frames: DataFrame, keys: Sequence[str], event: str, time: str, frame_time: str, *, distance: str, visible: str, sync: float = 0.15) -> DataFrame:
    """Best frame within ``sync`` of each event: visible first, then nearest to the ball, then in time.

    ``frames`` has one row per (key, frame) with the actor's ``distance`` to the ball.
    """
    fr = frames.where(F.col(distance).isNotNull()).select(*keys, F.col(frame_time).alias("_ft"), F.col(distance).alias("_d"), F.col(visible).alias("_v"))
    pairs = band_join(events, fr, keys, time, "_ft", sync, sync)
    dt = F.col("_ft") - F.col(time)
    best = F.min(F.struct((~F.col("_v")).alias("h"), F.col("_d").alias("d"), F.abs(dt).alias("a"), F.col("_ft").alias("t"), dt.alias("dt")))
    d = pairs.groupBy(*keys, event).agg(best.alias("b"))
    return d.select(*keys, event, F.col("b.t").alias("t_frame"), F.col("b.d").alias("dist_m"), F.col("b.dt").alias("dt_s"), (~F.col("b.h")).alias("ball_visible"))


def pass_handoffs(passes: DataFrame, otb: DataFrame, keys: Sequence[str], pass_id: str, time: str, receiver: str, otb_time: str, otb_player: str, gap: float = 5.0) -> DataFrame:
    """Next on-ball interval after each complete pass: the receiver's if any, else the first.

    Passes without a receiver are left out.
    """
    passes = passes.where(F.col(receiver).isNotNull())
    nxt = otb.select(*keys, F.col(otb_time).alias("_t0"), F.col(otb_player).alias("_p"))
    # a tie on the start keeps the lower player id
    rank = F.min(
        F.when(F.col("_t0").isNotNull(), F.struct((~F.coalesce(F.col("_p") == F.col(receiver), F.lit(False))).alias("other"), F.col("_t0").alias("t0"), F.col("_p").alias("p")))
    )
    pairs = band_join(passes, nxt, keys, time, "_t0", 1e-6, gap, how="left")
    d = pairs.groupBy(*passes.columns).agg(rank.alias("b"))
    return d.select(
        *passes.columns,
        F.col("b.p").alias("next_player"),
        (F.col("b.t0") - F.col(time)).alias("gap_s"),
        F.coalesce(~F.col("b.other"), F.lit(False)).alias("receiver_match"),
    )


def instant_recovery(instants: DataFrame, frames: DataFrame, keys: Sequence[str], event: str, time: str, frame_time: str, distance: Column, radius: float, search: float = 0.5) -> DataFrame:
    """Contiguous frames inside the radius around an instant event, the run nearest to the event.

    ``distance`` is the actor's ball distance as an expression over the paired row (null when the
    actor is not the nearest player of a side). A window holds the frames of one second at most.
    """
    fr = frames.withColumnRenamed(frame_time, "_ft").drop(*[c for c in instants.columns if c not in keys and c != frame_time])
    d = band_join(instants, fr, keys, time, "_ft", search, search).withColumn("_d", distance)
    inside = F.coalesce(F.col("_d") < radius, F.lit(False))
    line = Line((*keys, event), "_ft", whole=True)
    d = run_starts(d.withColumn("_in", inside), line, F.col("_in"), "_run")
    runs = d.groupBy(*keys, event, F.col(time).alias("t_event"), "_run", "_in").agg(
        F.min("_ft").alias("t0"), F.max("_ft").alias("t1"), F.count(F.lit(1)).alias("n"),
        F.min("_d").alias("dmin"), F.min(F.abs(F.col("_ft") - F.col(time))).alias("near"),
    )
    best = F.min(F.when(F.col("_in"), F.struct("near", "t0", "t1", "n", "dmin"))).alias("b")
    out = runs.groupBy(*keys, event, "t_event").agg(best, F.min("dmin").alias("_any"))
    hit = F.col("b").isNotNull()
    return out.select(
        *keys, event, "t_event", hit.alias("recovered"), F.col("b.t0").alias("t0"), F.col("b.t1").alias("t1"),
        F.coalesce(F.col("b.n"), F.lit(0)).alias("n_frames"),
        F.when(hit, F.col("b.dmin")).otherwise(F.col("_any")).alias("min_dist"),
    )


def nearest_is_actor(events: DataFrame, frames: DataFrame, keys: Sequence[str], time: str, frame_time: str, actor: str, nearest: str, *, whole: bool = False) -> DataFrame:
    """Share of events whose actor is the nearest player in the frame closest in time."""
    d = nearest_in_time(events.where(F.col(actor).isNotNull()), frames, keys, time, frame_time, [nearest], whole=whole)
    return d.agg(F.count(F.lit(1)).alias("n_events"), F.avg(F.coalesce(F.col(nearest) == F.col(actor), F.lit(False)).cast("double")).alias("p_nearest_is_actor"))


def complete_panel(kin: DataFrame, xy: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Kinematics with coordinates, both reduced to the first row per (frame, period, player)."""
    one = kin.groupBy(*on).agg(F.min_by(F.struct(*[c for c in kin.columns if c not in on]), F.struct(*order)).alias("_k")).select(*on, "_k.*")
    return attach_once(one, xy, on, ["x", "y"], order=order)
