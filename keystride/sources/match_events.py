"""Event files: scan, passes, shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, scalar as S
from . import schemas


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON-array event files, one row per event with the match id of the file name."""
    d = spark.read.schema(schemas.EVENTS).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:_events)?\.json(?:\.bz2)?$", 1)
    return d.withColumn("match_id", name)


def parse_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Events from a column with one JSON object per row, other columns kept.

    The object is a generated row: as an expression Spark would parse the text once for a filter and again for the columns.
    """
    keep = [c for c in lines.columns if c != text]
    return lines.select(*keep, F.explode(F.array(F.from_json(text, schemas.EVENTS))).alias("_e")).select(*keep, "_e.*")


def flat_events(events: DataFrame) -> DataFrame:
    """Numbers as doubles and the nested ids as columns, beside the nested structs."""
    out = {c: S.num(F.col(c)) for c in ("eventTime", "startTime", "endTime", "duration", "sequence")}
    g = F.col("gameEvents")
    out |= {
        "event_kind": g["gameEventType"], "period": S.num(g["period"]).cast("int"), "player_id": S.num(g["playerId"]), "team_id": S.num(g["teamId"]),
        "poss_type": F.col("possessionEvents.possessionEventType"),
    }
    return events.withColumns(out)


def _id(c: Column) -> Column:
    return F.floor(S.num(c)).cast("long")


def passes(events: DataFrame) -> DataFrame:
    """Every pass for its passer and for its receiver (else target), with clock minute and success."""
    p = F.col("possessionEvents")
    other = F.coalesce(_id(p["receiverPlayerId"]), _id(p["targetPlayerId"]))
    d = events.where(p["possessionEventType"] == "PA")
    who = F.filter(F.array_distinct(F.array(_id(p["passerPlayerId"]), other)), lambda x: x.isNotNull())
    return d.select(
        "match_id", "gameEventId", S.num(F.col("gameEvents.period")).cast("int").alias("period"), (F.col("gameEvents.startGameClock") / 60.0).alias("game_clock_min"),
        (F.coalesce(p["passOutcomeType"], F.lit("")) == "C").alias("success"), F.explode(who).alias("player_id"),
    )


def _freeze_frame(direction: Column) -> Column:
    """Both sides' placed players on the attack grid."""
    def placed(side: str) -> Column:
        mate = F.col("gameEvents.homeTeam").eqNullSafe(F.lit(True)) == F.lit(side == "home")

        def point(p):
            g = S.to_attack_grid(p["x"], p["y"], direction)
            pos = F.when(F.upper(p["positionGroupType"]) == "GK", "Goalkeeper").otherwise(F.coalesce(p["positionGroupType"], F.lit("")))
            return F.struct(g["x"].alias("x"), g["y"].alias("y"), mate.alias("teammate"), pos.alias("position"))

        ok = F.filter(F.coalesce(F.col(f"{side}Players"), F.array()), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        return F.transform(ok, point)

    return F.concat(placed("home"), placed("away"))


def shots(events: DataFrame) -> DataFrame:
    """Shots on the attack grid with their freeze frame; ``placed`` is false without any location."""
    p, g = F.col("possessionEvents"), F.col("gameEvents")
    direction = F.coalesce(F.col("stadiumMetadata.teamAttackingDirection"), F.lit("R"))
    everyone = F.concat(F.coalesce("homePlayers", F.array()), F.coalesce("awayPlayers", F.array()))
    # the later of two placed entries of the shooter counts
    mine = F.filter(everyone, lambda q: (q["playerId"].cast("string") == p["shooterPlayerId"]) & q["x"].isNotNull() & q["y"].isNotNull())
    # `ball` is read as text, since a file may hold one object, a list of them, or both forms in turn
    ball = F.get(F.from_json("ball", schemas.EVENT_BALL), 0)
    ball = F.struct(S.num(ball["x"]).alias("x"), S.num(ball["y"]).alias("y"))
    ball = F.when(ball["x"].isNotNull() & ball["y"].isNotNull(), ball)
    d = events.where(p["possessionEventType"] == "SH")
    d = d.withColumn("_mine", mine).withColumn("_who", F.get("_mine", F.size("_mine") - 1))
    d = d.withColumn("_at", F.coalesce(ball, F.struct(F.col("_who.x").alias("x"), F.col("_who.y").alias("y"))))
    grid = S.to_attack_grid(F.col("_at.x"), F.col("_at.y"), direction)
    clock = F.coalesce(g["startGameClock"], p["gameClock"])
    return d.select(
        "match_id", "gameEventId", _id(p["shooterPlayerId"]).alias("shooter_id"), p["shooterPlayerName"].alias("shooter"), S.num(g["teamId"]).alias("team_id"),
        F.coalesce(S.num(g["period"]).cast("int"), F.lit(1)).alias("period"),
        (clock / 60.0).alias("game_clock_min"), F.coalesce(F.bround(clock / 60.0).cast("int"), F.lit(45)).alias("minute"),
        grid["x"].alias("x"), grid["y"].alias("y"), _freeze_frame(direction).alias("players"),
        codes.body_part(p["bodyType"]).alias("shot_body_part"), codes.set_piece(g["setpieceType"]).alias("shot_type"),
        codes.technique(p["shotType"], p["bodyType"]).alias("shot_technique"),
        codes.game_period(F.coalesce(S.num(g["period"]), F.lit(1.0))).alias("game_period"),
        F.lit(0).alias("shot_one_on_one"), (F.coalesce(p["pressureType"], F.lit("")) == "P").cast("int").alias("under_pressure"),
        F.coalesce(p["shotType"].isin(*codes.FIRST_TIME_SHOTS), F.lit(False)).cast("int").alias("first_time"),
        p["shotOutcomeType"].alias("outcome"), codes.outcome(p["shotOutcomeType"]).alias("outcome_label"),
        (F.col("_at.x").isNotNull() & F.col("_at.y").isNotNull()).alias("placed"),
    )


def skipped_shots(shot_rows: DataFrame) -> DataFrame:
    """How many shots of each match have no location and are left out of the features."""
    return shot_rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_shots"), F.count_if(~F.col("placed")).alias("n_skipped"))
