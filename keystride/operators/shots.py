"""Shot features from freeze frames: geometry, defenders, keeper, model encoding and scoring."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes

# Fixed values
GOAL_X, GOAL_Y = 120.0, 40.0
PATH_CONE, BLOCK_CONE, BLOCK_SHARE = 0.3, 0.2, 0.8
NO_DEFENDER, NO_KEEPER = 20.0, (15.0, 0.0, 5.0)
DEFAULT_KEEPER = (95.0, 42.0)
NUMERIC = (
    "x", "y", "distance", "angle", "shot_one_on_one", "under_pressure", "first_time", "minute", "defenders_in_path",
    "min_defender_distance", "soft_blocking", "goal_blocking_percentage", "gk_distance", "gk_angle", "gk_goal_line_distance",
)
CATEGORIES = {
    "shot_body_part": ("body_part", codes.MODEL_BODY),
    "shot_type": ("shot_type", codes.MODEL_SHOT),
    "shot_technique": ("technique", codes.MODEL_TECHNIQUE),
    "game_period": ("game_period", codes.MODEL_PERIOD),
}


def goal_distance(x: Column, y: Column) -> Column:
    return F.hypot(x - GOAL_X, y - GOAL_Y)


def goal_angle(x: Column, y: Column) -> Column:
    return F.abs(F.atan2(y - GOAL_Y, GOAL_X - x))


def _off_line(p: Column, x: Column, y: Column) -> Column:
    """Angle between the lines from the shot to the goal and to a player."""
    return F.abs(F.atan2(GOAL_Y - y, GOAL_X - x) - F.atan2(p["y"] - y, p["x"] - x))


def _outfield_opponents(players: Column) -> Column:
    return F.filter(players, lambda p: ~p["teammate"] & (p["position"] != "Goalkeeper"))


def defender_features(players: Column, x: Column, y: Column) -> dict[str, Column]:
    """Opponents in the cone to goal, the nearest one, and how much they block."""
    foes = _outfield_opponents(players)
    in_path = F.size(F.filter(foes, lambda p: (p["x"] > x) & (_off_line(p, x, y) < PATH_CONE)))
    nearest = F.array_min(F.transform(foes, lambda p: F.hypot(p["x"] - x, p["y"] - y)))
    ahead = F.filter(foes, lambda p: (p["x"] > x) & (_off_line(p, x, y) < BLOCK_CONE))
    soft = F.least(F.lit(1.0), F.aggregate(ahead, F.lit(0.0), lambda a, p: a + 1.0 / (1.0 + F.hypot(p["x"] - x, p["y"] - y))))
    # a frame without anybody within 100 yards counts like one without defenders
    known = F.when(nearest < 100.0, nearest).otherwise(NO_DEFENDER)
    return {"defenders_in_path": in_path, "min_defender_distance": known, "soft_blocking": soft, "goal_blocking_percentage": BLOCK_SHARE * soft}


def keeper_features(players: Column, x: Column, y: Column) -> dict[str, Column]:
    """Distance, angle off the goal line of sight and depth of the first opposing keeper."""
    k = F.get(F.filter(players, lambda p: ~p["teammate"] & (p["position"] == "Goalkeeper")), 0)
    dist, angle, depth = NO_KEEPER
    return {
        "gk_distance": F.coalesce(F.hypot(k["x"] - x, k["y"] - y), F.lit(dist)),
        "gk_angle": F.coalesce(_off_line(k, x, y), F.lit(angle)),
        "gk_goal_line_distance": F.coalesce(GOAL_X - k["x"], F.lit(depth)),
    }


def default_keeper() -> Column:
    x, y = DEFAULT_KEEPER
    return F.array(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(False).alias("teammate"), F.lit("Goalkeeper").alias("position")))


def with_keeper(players: Column) -> Column:
    """The freeze frame, or the default keeper alone where it is empty."""
    return F.when(F.size(players) > 0, players).otherwise(default_keeper())


def shot_features(shots: DataFrame) -> DataFrame:
    """The 19 model features for shots ``(x, y, players, body, set_piece, technique, period, minute, flags)``.

    ``players`` is one freeze frame: ``array<struct<x, y, teammate, position>>``; an empty one gets the
    default keeper.
    """
    d = shots.withColumn("_pl", with_keeper(F.col("players")))
    x, y, pl = F.col("x"), F.col("y"), F.col("_pl")
    d = d.withColumns(
        {
            "distance": goal_distance(x, y),
            "angle": goal_angle(x, y),
            "shot_body_part": codes.model_category(F.col("shot_body_part"), codes.BODY_ALIAS, codes.MODEL_BODY, "Right Foot"),
            "shot_type": codes.model_category(F.col("shot_type"), codes.SHOT_ALIAS, codes.MODEL_SHOT, "Open Play"),
            "shot_technique": codes.model_category(F.col("shot_technique"), codes.TECHNIQUE_ALIAS, codes.MODEL_TECHNIQUE, "Normal"),
            "game_period": codes.model_category(F.col("game_period"), codes.PERIOD_ALIAS, codes.MODEL_PERIOD, "First Half"),
            "minute": F.coalesce(F.col("minute").cast("int"), F.lit(45)),
            **defender_features(pl, x, y),
            **keeper_features(pl, x, y),
        }
    )
    return d.drop("players", "_pl")


def one_hot(features: DataFrame) -> DataFrame:
    """Fixed 0/1 columns for the four categoricals (their labels' spaces become underscores)."""
    out = {}
    for col, (prefix, allowed) in CATEGORIES.items():
        for label in allowed:
            out[f"{prefix}_{label.replace(' ', '_')}"] = F.when(F.col(col) == label, 1.0).otherwise(0.0)
    return features.withColumns(out).drop(*CATEGORIES)


def encoded_columns() -> list[str]:
    return [*NUMERIC, *[f"{p}_{a.replace(' ', '_')}" for p, allowed in CATEGORIES.values() for a in allowed]]


def fit_shot_model(labelled: DataFrame, label: str, *, trees: int = 20, depth: int = 3, seed: int = 7):
    """Gradient-boosted trees for the goal probability, fitted on the encoded shots that have a label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    gather = VectorAssembler(inputCols=encoded_columns(), outputCol="_features")
    boost = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[gather, boost]).fit(labelled)


def score_shots(encoded: DataFrame, model) -> DataFrame:
    """`xG` of every encoded shot under a fitted model."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(encoded).withColumn("xG", vector_to_array("probability")[1])
    return scored.drop("_features", "rawPrediction", "probability", "prediction")


def score_with_weights(encoded: DataFrame, weights: Mapping[str, float], intercept: float) -> DataFrame:
    """`xG` of every encoded shot from the weights of a logistic model."""
    total = F.lit(float(intercept))
    for name, w in weights.items():
        total = total + F.lit(float(w)) * F.col(name)
    return encoded.withColumn("xG", 1.0 / (1.0 + F.exp(-total)))
