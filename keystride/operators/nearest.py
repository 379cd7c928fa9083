"""Nearest neighbours inside one frame. A frame holds one roster, so its array is short."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinematics import sample_interval
from .ordered import Line


def k_nearest(df: DataFrame, frame: Sequence[str], player: str, team: str, k: int = 2, x: str = "x", y: str = "y", speed: str = "speed", step: str = "step_dist") -> DataFrame:
    """Mean speed and step of the ``k`` nearest of both sides, for every player of every frame.

    Rows need all measures; a player with fewer than ``k`` on either side is left out. Players are
    gathered once per frame and compared inside the array, so no pair is ever shuffled.
    """
    ok = F.lit(True)
    for c in (x, y, speed, step):
        ok = ok & F.col(c).isNotNull()
    me = F.struct(*[F.col(c).alias(n) for c, n in ((player, "id"), (team, "team"), (x, "x"), (y, "y"), (speed, "v"), (step, "s"))])
    f = df.where(ok).groupBy(*frame).agg(F.collect_list(me).alias("_all"))
    d = f.select(*frame, "_all", F.explode("_all").alias("_me"))

    def side(same: bool) -> Column:
        def other(p):
            mine = p["team"] == F.col("_me.team")
            return (p["id"] != F.col("_me.id")) & (mine if same else ~mine)

        def measured(p):
            dist = F.hypot(p["x"] - F.col("_me.x"), p["y"] - F.col("_me.y"))
            return F.struct(dist.alias("d"), p["id"].alias("id"), p["v"].alias("v"), p["s"].alias("s"))

        return F.slice(F.array_sort(F.transform(F.filter("_all", other), measured)), 1, k)

    def mean(arr: str, field: str) -> Column:
        return F.aggregate(F.col(arr), F.lit(0.0), lambda a, p: a + p[field]) / k

    d = d.withColumns({"_tm": side(True), "_op": side(False)}).where((F.size("_tm") == k) & (F.size("_op") == k))
    return d.select(
        *frame,
        F.col("_me.id").alias(player),
        F.col("_me.team").alias(team),
        F.col("_me.v").alias("s_player"),
        F.col("_me.s").alias("d_player"),
        mean("_tm", "v").alias("s_tm"), mean("_op", "v").alias("s_op"),
        mean("_tm", "s").alias("d_tm"), mean("_op", "s").alias("d_op"),
        F.get("_tm", 0)["d"].alias("dist_tm"), F.get("_op", 0)["d"].alias("dist_op"),
    )


def nearest_minutes(near: DataFrame, clock: DataFrame, keys: Sequence[str], clock_s: str, coverage: float = 0.75, bin_s: float = 60.0) -> DataFrame:
    """One-minute bins of :func:`k_nearest` rows (with ``clock_s``) that reach their coverage.

    ``clock`` gives ``(player keys, fps)``, see :func:`fps_of`.
    """
    keys = list(keys)
    on = [c for c in keys if c in clock.columns]
    d = near.join(clock, on).withColumn("minute_bin", F.floor(F.col(clock_s) / bin_s).cast("double"))
    d = d.where(F.col("minute_bin").isNotNull())
    d = d.groupBy(*keys, "minute_bin", "fps").agg(
        *[F.avg(c).alias(c) for c in ("s_player", "s_tm", "s_op")],
        *[F.sum(c).alias(c) for c in ("d_player", "d_tm", "d_op")],
        F.count(F.lit(1)).alias("n_frames"),
    )
    d = d.where(F.col("n_frames") >= F.ceil(coverage * bin_s * F.col("fps")))
    return d.withColumns(
        {
            "t_centre_min": (F.col("minute_bin") + 0.5) * (bin_s / 60.0),
            "s_resid_tm": F.col("s_player") - F.col("s_tm"),
            "s_resid_op": F.col("s_player") - F.col("s_op"),
            "d_resid_tm": F.col("d_player") - F.col("d_tm"),
            "d_resid_op": F.col("d_player") - F.col("d_op"),
            "coverage": F.col("n_frames") / (F.col("fps") * bin_s),
        }
    ).drop("fps")


def fps_of(df: DataFrame, line: Line) -> DataFrame:
    return sample_interval(df, line).select(*line.keys, "fps")


def nearest_to_ball(players: Column, ball_x: Column, ball_y: Column) -> Column:
    """Struct ``(d, jersey)`` of the player nearest to the ball, straight from the nested array."""
    placed = F.filter(players, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    ranked = F.transform(
        placed,
        lambda p, i: F.struct(F.hypot(p["x"] - ball_x, p["y"] - ball_y).alias("d"), i.alias("i"), p["jerseyNum"].alias("jersey")),
    )
    best = F.array_min(ranked)
    return F.when(ball_x.isNotNull() & ball_y.isNotNull(), F.struct(best["d"].alias("d"), best["jersey"].alias("jersey")))


def team_distances(geo: DataFrame, focal_is_home: Column, roster: DataFrame | None = None, match: Sequence[str] = ("match_id",)) -> DataFrame:
    """Home/away distances turned into focal/opponent ones, with player ids from the roster."""
    def side(a: str, b: str) -> Column:
        return F.when(focal_is_home, F.col(a)).otherwise(F.col(b))

    d = geo.withColumns(
        {
            "d_focal": side("d_home", "d_away"), "jersey_focal": side("jersey_home", "jersey_away"),
            "d_opp": side("d_away", "d_home"), "jersey_opp": side("jersey_away", "jersey_home"),
            "_fs": F.when(focal_is_home, "home").otherwise("away"), "_os": F.when(focal_is_home, "away").otherwise("home"),
        }
    )
    if roster is not None:
        for tag, s in (("focal", "_fs"), ("opp", "_os")):
            ids = roster.select(
                *match, F.col("side").alias(s), F.col("shirt").cast("string").alias(f"jersey_{tag}"), F.col("player_id").alias(f"player_id_{tag}_nearest")
            )
            d = d.join(ids, [*match, s, f"jersey_{tag}"], "left")
    d = d.drop("_fs", "_os").withColumn("d_min", F.least("d_focal", "d_opp"))
    focal = F.col("d_opp").isNull() | (F.col("d_focal") <= F.col("d_opp"))
    d = d.withColumn("nearest_side", F.when(F.col("d_min").isNotNull(), F.when(focal & F.col("d_focal").isNotNull(), "FOCAL").otherwise("OPP")))
    if roster is not None:
        who = F.when(F.col("nearest_side") == "FOCAL", F.col("player_id_focal_nearest")).otherwise(F.col("player_id_opp_nearest"))
        d = d.withColumn("nearest_player_id", who)
    return d
