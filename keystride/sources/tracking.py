"""Tracking frames: scan, ball point, player rows and the game-event index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import schemas

MATCH_NAME = r"([^/]*?)(?:_tracking)?\.jsonl?(?:\.bz2)?$"


def match_id_of(path: Column) -> Column:
    """Match id from a tracking file name, null for other files."""
    hit = F.regexp_extract(path, "(?i)" + MATCH_NAME, 1)
    return F.when(hit != "", hit)


def read_tracking(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines frames of many matches (plain or bz2); blank lines are skipped by the reader."""
    reader = spark.readStream if stream else spark.read
    d = reader.schema(schemas.TRACKING).json(path)
    return d.withColumn("match_id", match_id_of(F.col("_metadata.file_path"))).where(F.col("frameNum").isNotNull())


def parse_tracking(lines: DataFrame, text: str = "value") -> DataFrame:
    """Frames from a column of JSON text (blank lines dropped), other columns kept."""
    d = lines.where(F.trim(text) != "").withColumn("_f", F.from_json(text, schemas.TRACKING)).drop(text)
    return d.select(*[c for c in d.columns if c != "_f"], "_f.*").where(F.col("frameNum").isNotNull())


def video_time(d: DataFrame) -> DataFrame:
    return d.withColumn("video_time_s", S.video_seconds(F.col("videoTimeMs"), F.col("video_time_s"), F.col("videoTime")))


def ball_point(prefer_raw: bool = True) -> Column:
    """Struct of the first raw ball, else the smoothed one."""
    raw = F.when(F.size("balls") > 0, F.coalesce(F.get("balls", 0), F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("string").alias("visibility"))))
    return F.coalesce(raw, F.col("ballsSmoothed")) if prefer_raw else F.col("ballsSmoothed")


def side_players(side: str, smoothed: bool = True) -> Column:
    """One side's array: smoothed when it has players, else raw."""
    raw = F.col(f"{side}Players")
    return F.coalesce(F.when(F.size(f"{side}PlayersSmoothed") > 0, F.col(f"{side}PlayersSmoothed")), raw) if smoothed else raw


def explode_players(frames: DataFrame, roster: DataFrame, smoothed: bool = True) -> DataFrame:
    """One row per placed outfield player and frame, named through the roster of its match.

    Frames explode in place; the roster (tens of rows per match) is joined on (match, side, shirt).
    """
    both = F.array(*[F.struct(F.lit(s).alias("side"), side_players(s, smoothed).alias("players")) for s in ("home", "away")])
    d = video_time(frames).withColumn("_ball", ball_point())
    base = ["match_id", "frameNum", "period", "video_time_s", "periodGameClockTime"]
    d = d.select(*base, F.col("_ball.x").alias("ball_x"), F.col("_ball.y").alias("ball_y"), F.inline(both))
    d = d.select(*base, "ball_x", "ball_y", "side", F.explode("players").alias("p"))
    d = d.where(F.col("p.x").isNotNull() & F.col("p.y").isNotNull())
    d = d.select(*base, "ball_x", "ball_y", "side", F.col("p.jerseyNum").alias("shirt"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.visibility").alias("visibility"))
    keep = roster.select("match_id", "side", "shirt", "player_id", "team_id")
    return d.join(keep, ["match_id", "side", "shirt"])


def vendor_speed(frames: DataFrame, roster: DataFrame) -> DataFrame:
    """Vendor speed of raw player points per (match, frame, period, player)."""
    both = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}Players").alias("players")) for s in ("home", "away")])
    d = frames.select("match_id", "frameNum", "period", F.inline(both))
    d = d.select("match_id", "frameNum", "period", "side", F.explode("players").alias("p"))
    d = d.select("match_id", "frameNum", "period", "side", F.col("p.jerseyNum").alias("shirt"), S.num(F.col("p.speed")).alias("speed_vendor"))
    return d.join(roster.select("match_id", "side", "shirt", "player_id"), ["match_id", "side", "shirt"]).drop("side", "shirt")


def attach_vendor_speed(track: DataFrame, speeds: DataFrame) -> DataFrame:
    return track.join(speeds, ["match_id", "frameNum", "period", "player_id"], "left")


def game_event_index(frames: DataFrame) -> DataFrame:
    """Frame span and first metadata per game event; explicit start/end frames win."""
    d = frames.where(F.col("game_event_id").isNotNull() & F.col("game_event").isNotNull() & F.col("frameNum").isNotNull())
    d = d.groupBy("match_id", F.col("game_event_id").alias("gameEventId")).agg(
        F.min("frameNum").alias("_f0"), F.max("frameNum").alias("_f1"), F.min_by("game_event", "frameNum").alias("e")
    )
    return d.select(
        "match_id", "gameEventId", F.col("e.game_event_type").alias("game_event_type"),
        F.coalesce("e.start_frame", "_f0").alias("frame0"), F.coalesce("e.end_frame", "_f1").alias("frame1"),
        F.col("e.home_ball").alias("home_ball"), F.col("e.sequence").alias("sequence_tracking"),
        F.col("e.team_id").alias("team_id_tracking"), F.col("e.player_id").alias("player_id_tracking"),
    )


def frame_geometry(frames: DataFrame) -> DataFrame:
    """Ball point and nearest player of each side per frame, computed inside the row."""
    from ..operators.nearest import nearest_to_ball

    d = video_time(frames).withColumn("_ball", ball_point())
    bx, by = F.col("_ball.x"), F.col("_ball.y")
    d = d.withColumns({f"_{s}": nearest_to_ball(side_players(s), bx, by) for s in ("home", "away")})
    return d.select(
        "match_id", "frameNum", "period", "video_time_s", bx.alias("ball_x"), by.alias("ball_y"), F.col("_ball.visibility").alias("ball_visibility"),
        *[F.col(f"_{s}.{a}").alias(f"{b}_{s}") for s in ("home", "away") for a, b in (("d", "d"), ("jersey", "jersey"))],
    )
