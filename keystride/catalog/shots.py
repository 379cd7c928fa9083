"""Shot scenes from `embeddings`: twenty vectors make one freeze frame, the first is the shot."""

from pyspark.sql import functions as F

from ..operators import shots as X
from .base import query, rounded, table

SCENE = """pts AS (SELECT vec_id // 20 AS scene, vec_id, label, embedding[1]::DOUBLE * 60 + 95 AS x, embedding[2]::DOUBLE * 60 + 40 AS y, label % 3 = 0 AS teammate, CASE WHEN label = 7 THEN 'Goalkeeper' ELSE 'CB' END AS position FROM embeddings),
 shot AS (SELECT * FROM pts WHERE vec_id % 20 = 0), pl AS (SELECT s.scene, p.vec_id, s.x AS sx, s.y AS sy, p.x, p.y, p.teammate, p.position, abs(atan2(40 - s.y, 120 - s.x) - atan2(p.y - s.y, p.x - s.x)) AS off, sqrt(power(p.x - s.x, 2) + power(p.y - s.y, 2)) AS dd FROM shot s JOIN pts p ON s.scene = p.scene AND p.vec_id % 20 <> 0 AND s.label <> 5),
 df AS (SELECT scene, count(*) FILTER (WHERE x > sx AND off < 0.3) AS defenders_in_path, min(dd) AS md, least(1, coalesce(sum(CASE WHEN x > sx AND off < 0.2 THEN 1 / (1 + dd) END), 0)) AS soft FROM pl WHERE NOT teammate AND position <> 'Goalkeeper' GROUP BY ALL),
 gk AS (SELECT scene, arg_min(dd, vec_id) AS gd, arg_min(off, vec_id) AS ga, arg_min(120 - x, vec_id) AS gl FROM pl WHERE NOT teammate AND position = 'Goalkeeper' GROUP BY ALL),
 ft AS (SELECT s.scene, s.label, s.x, s.y, coalesce(defenders_in_path, 0) AS defenders_in_path, CASE WHEN md < 100 THEN md ELSE 20 END AS min_defender_distance, coalesce(soft, 0) AS soft_blocking,
   CASE WHEN s.label = 5 THEN sqrt(power(95 - s.x, 2) + power(42 - s.y, 2)) ELSE coalesce(gd, 15) END AS gk_distance, CASE WHEN s.label = 5 THEN abs(atan2(40 - s.y, 120 - s.x) - atan2(42 - s.y, 95 - s.x)) ELSE coalesce(ga, 0) END AS gk_angle, CASE WHEN s.label = 5 THEN 25 ELSE coalesce(gl, 5) END AS gk_goal_line_distance
   FROM shot s LEFT JOIN df ON s.scene = df.scene LEFT JOIN gk ON s.scene = gk.scene)"""


def scenes(spark, d):
    v = F.col("vec_id")

    def at(i):
        return F.get("embedding", i).cast("double") * 60

    p = table(spark, d, "embeddings").select(F.floor(v / 20).alias("scene"), "vec_id", "label", (at(0) + 95).alias("x"), (at(1) + 40).alias("y"))
    pos = F.when(F.col("label") == 7, "Goalkeeper").otherwise("CB")
    row = F.struct("vec_id", "x", "y", (F.col("label") % 3 == 0).alias("teammate"), pos.alias("position"))
    first = v % 20 == 0
    # one scene has at most 20 vectors
    s = p.groupBy("scene").agg(
        F.max(F.when(first, F.col("x"))).alias("x"), F.max(F.when(first, F.col("y"))).alias("y"), F.max(F.when(first, F.col("label"))).alias("label"),
        F.array_sort(F.collect_list(F.when(~first, row))).alias("_rows"),
    )
    players = F.transform("_rows", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["teammate"].alias("teammate"), r["position"].alias("position")))
    return s.withColumn("players", F.when(F.col("label") == 5, F.slice(players, 1, 0)).otherwise(players)).drop("_rows")


@query("x01_goal_geometry", f"WITH {SCENE} SELECT vec_id, round(sqrt(power(x - 120, 2) + power(y - 40, 2)), 6) AS distance, round(abs(atan2(y - 40, 120 - x)), 6) AS angle FROM pts")
def _(spark, d):
    def at(i):
        return F.get("embedding", i).cast("double") * 60

    x, y = at(0) + 95, at(1) + 40
    out = table(spark, d, "embeddings").select("vec_id", X.goal_distance(x, y).alias("distance"), X.goal_angle(x, y).alias("angle"))
    return rounded(out, "distance", "angle")


@query("x02_defender_features", f"WITH {SCENE} SELECT scene, CASE WHEN label = 5 THEN 0 ELSE defenders_in_path END::INT AS defenders_in_path, round(min_defender_distance, 6) AS min_defender_distance, round(soft_blocking, 6) AS soft_blocking, round(soft_blocking * 0.8, 6) AS goal_blocking_percentage FROM ft")
def _(spark, d):
    f = X.defender_features(F.col("players"), F.col("x"), F.col("y"))
    out = scenes(spark, d).select("scene", *[c.alias(n) for n, c in f.items()])
    return rounded(out, "min_defender_distance", "soft_blocking", "goal_blocking_percentage")


@query("x03_keeper_features", f"WITH {SCENE} SELECT scene, round(gk_distance, 6) AS gk_distance, round(gk_angle, 6) AS gk_angle, round(gk_goal_line_distance, 6) AS gk_goal_line_distance FROM ft")
def _(spark, d):
    s = scenes(spark, d)
    f = X.keeper_features(X.with_keeper(F.col("players")), F.col("x"), F.col("y"))
    out = s.select("scene", *[c.alias(n) for n, c in f.items()])
    return rounded(out, "gk_distance", "gk_angle", "gk_goal_line_distance")


CATS = """CASE label % 4 WHEN 0 THEN 'Left Foot' WHEN 1 THEN 'Other' ELSE 'Right Foot' END AS shot_body_part, CASE label % 3 WHEN 0 THEN 'Free Kick' WHEN 1 THEN 'Open Play' ELSE 'Penalty' END AS shot_type,
 CASE label % 4 WHEN 0 THEN 'Volley' WHEN 1 THEN 'Normal' ELSE 'Normal' END AS shot_technique, CASE label % 4 WHEN 0 THEN 'First Half' WHEN 1 THEN 'Second Half' WHEN 2 THEN 'Second Half Beginning' ELSE 'First Half' END AS game_period"""


def features(spark, d):
    lab = F.col("label")

    def pick(n, *vals):
        return F.element_at(F.array(*[F.lit(v) for v in vals]), lab % n + 1)

    s = scenes(spark, d).withColumns(
        {
            "shot_body_part": pick(4, "Left Foot", "Head", "Right Foot", "??"), "shot_type": pick(3, "Corner", "Kick Off", "Penalty"),
            "shot_technique": pick(4, "Volley", "Backheel", "Normal", "??"), "game_period": pick(4, "First Half", "Extra Time 2", "Extra Time 1", "??"),
            "shot_one_on_one": F.lit(0), "under_pressure": (lab % 2).cast("int"), "first_time": (lab % 3 == 0).cast("int"),
            "minute": F.when(lab % 5 != 0, lab * 9).cast("int"),
        }
    )
    return X.shot_features(s)


NUMS = ["x", "y", "distance", "angle", "min_defender_distance", "soft_blocking", "goal_blocking_percentage", "gk_distance", "gk_angle", "gk_goal_line_distance"]
FEATURES = f"""{SCENE}, fx AS (SELECT scene, label, x, y, sqrt(power(x - 120, 2) + power(y - 40, 2)) AS distance, abs(atan2(y - 40, 120 - x)) AS angle, {CATS}, 0 AS shot_one_on_one, (label % 2)::INT AS under_pressure, (label % 3 = 0)::INT AS first_time,
  CASE WHEN label % 5 <> 0 THEN label * 9 ELSE 45 END::INT AS minute, CASE WHEN label = 5 THEN 0 ELSE defenders_in_path END::INT AS defenders_in_path, min_defender_distance, soft_blocking, soft_blocking * 0.8::DOUBLE AS goal_blocking_percentage, gk_distance, gk_angle, gk_goal_line_distance::DOUBLE AS gk_goal_line_distance FROM ft)"""


@query("x04_shot_features", f"WITH {FEATURES} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in NUMS)}) FROM fx")
def _(spark, d):
    return rounded(features(spark, d), *NUMS)


def _one_hot_sql():
    out = []
    for col, (p, allowed) in X.CATEGORIES.items():
        out += [f"CASE WHEN {col} = '{a}' THEN 1.0 ELSE 0.0 END::DOUBLE AS {p}_{a.replace(' ', '_')}" for a in allowed]
    return ", ".join(out)


@query("x05_one_hot", f"WITH {FEATURES} SELECT scene, minute, {_one_hot_sql()} FROM fx")
def _(spark, d):
    hot = X.one_hot(features(spark, d))
    return hot.select("scene", "minute", *[c for c in X.encoded_columns() if c not in X.NUMERIC])


@query("x06_shot_scores")
def _(spark, d):
    """All scenes, by trees fitted on those whose number is a labelled document (model output: rows only)."""
    hot = X.one_hot(features(spark, d))
    goal = table(spark, d, "labels").select(F.col("doc_id").alias("scene"), F.col("quality").cast("double").alias("goal"))
    out = X.score_shots(hot, X.fit_shot_model(hot.join(goal, "scene"), "goal", trees=5))
    return out.select("scene", F.round("xG", 4).alias("xG"))


WEIGHTS = {"distance": -0.09, "angle": 1.3, "defenders_in_path": -0.35, "gk_distance": 0.02, "under_pressure": -0.4, "body_part_Other": -0.8, "minute": 0.002}


@query("x06_shot_scores_given", f"""
WITH {FEATURES}, hot AS (SELECT *, {_one_hot_sql()} FROM fx) SELECT scene, round(1 / (1 + exp(-(0.5::DOUBLE + {' + '.join(f'{w}::DOUBLE * {c}' for c, w in WEIGHTS.items())}))), 7) AS "xG" FROM hot""")
def _(spark, d):
    """All scenes, by the weights of a model trained elsewhere."""
    return rounded(X.score_with_weights(X.one_hot(features(spark, d)), WEIGHTS, 0.5).select("scene", "xG"), "xG", digits=7)
