"""Curves onto a unit grid, and their null-aware weighted blend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Line, neighbour

# Fixed values
SERIES_WEIGHTS = {
    "tight_w3": 1.0, "pass_C": 1.0, "standing": 1.5, "ols_distance": 1.0, "tm_cum": 1.0, "op_cum": 1.0, "speed_phi": 1.0,
}
GROUPS = {
    "cognitive": ("tight_w3", "pass_C", "standing"),
    "kinematic": ("ols_distance", "tm_cum", "op_cum", "speed_phi"),
}
GROUP_WEIGHTS = {"cognitive": 1.0, "kinematic": 1.0}


def unit_grid(curves: DataFrame, case: Sequence[str]) -> DataFrame:
    """Whole minutes per (case, period) covering all series."""
    ends = curves.groupBy(*case, "period").agg(F.floor(F.min("minute")).alias("_lo"), F.ceil(F.max("minute")).alias("_hi"))
    whole = ends.select(*case, "period", F.explode(F.sequence("_lo", "_hi")).alias("minute"))
    return whole.withColumn("minute", F.col("minute").cast("double"))


def _knots(curves: DataFrame, case: Sequence[str], whole: bool) -> DataFrame:
    """Knots with their follower ``_t1``/``_v1``; equal knots (same minute) are reduced to one first.

    A stretch that ends at equal knots runs to the first of them in their source, the one that begins there
    starts from the last, which also holds at the minute itself. ``source_row`` gives their order; without it the largest value counts.
    """
    keys = [*case, "period", "series"]
    ordered = "source_row" in curves.columns
    first, last = (F.min_by("value", "source_row"), F.max_by("value", "source_row")) if ordered else (F.max("value"), F.max("value"))
    knots = curves.groupBy(*keys, "minute").agg(last.alias("value"), first.alias("_first"))
    line = Line(tuple(keys), "minute", (), whole)
    return neighbour(knots, line, {"_t1": F.col("minute"), "_v1": F.col("_first")}, following=True).drop("_first")


def _own_minutes() -> Column:
    """Grid minutes of a knot: from itself up to, not including, its follower."""
    first = F.ceil("minute")
    last = F.when(F.col("_t1").isNull(), F.floor("minute")).otherwise(F.ceil("_t1") - 1)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _value_at(g: Column) -> Column:
    t0, v0, t1, v1 = F.col("minute"), F.col("value"), F.col("_t1"), F.col("_v1")
    return F.when((g == t0) | t1.isNull(), v0).otherwise(v0 + (v1 - v0) / (t1 - t0) * (g - t0))


def interpolate(curves: DataFrame, case: Sequence[str], whole: bool = True) -> DataFrame:
    """Linear interpolation at whole minutes inside each series' range, long.

    A knot knows its follower, so the stretch between them yields its own grid minutes: no join of
    grid and knots.
    """
    d = _knots(curves, case, whole).withColumn("_g", F.explode(_own_minutes()))
    g = F.col("_g").cast("double")
    return d.select(*case, "period", "series", g.alias("_m"), _value_at(g).alias("value")).withColumnRenamed("_m", "minute")


def wide_grid(curves: DataFrame, case: Sequence[str], series: Sequence[str], whole: bool = True) -> DataFrame:
    """One row per grid minute with a column per series, null where a series has no value."""
    if not whole:
        rows = interpolate(curves, case, whole).unionByName(unit_grid(curves, case), allowMissingColumns=True)
    else:
        # a small case stays in one task: its first knot also yields the empty grid, so the curves are read once
        whole = Window.partitionBy(*case, "period")
        d = _knots(curves.repartition(*case, "period"), case, None).withColumns(
            {"_lo": F.floor(F.min("minute").over(whole)), "_hi": F.ceil(F.max("minute").over(whole)),
             "_r": F.row_number().over(whole.orderBy("minute", "series"))}
        )
        mine = F.transform(_own_minutes(), lambda g: F.struct(g.alias("g"), F.lit(True).alias("own")))
        grid = F.transform(F.sequence("_lo", "_hi"), lambda g: F.struct(g.alias("g"), F.lit(False).alias("own")))
        d = d.withColumn("_x", F.explode(F.when(F.col("_r") == 1, F.concat(mine, grid)).otherwise(mine)))
        g = F.col("_x.g").cast("double")
        own = F.col("_x.own")
        rows = d.select(*case, "period", F.when(own, F.col("series")).alias("series"), g.alias("_m"), F.when(own, _value_at(g)).alias("value"))
        rows = rows.withColumnRenamed("_m", "minute")
    return rows.groupBy(*case, "period", "minute").agg(*[F.max(F.when(F.col("series") == s, F.col("value"))).alias(s) for s in series])


def weighted_mean(values: Mapping[str, float]) -> Column:
    """Mean of the present columns under positive weights, null if none is present."""
    used = {c: w for c, w in values.items() if w > 0}
    if not used:
        return F.lit(None).cast("double")
    zero = F.lit(0.0)
    total = sum((F.coalesce(F.col(c) * w, zero) for c, w in used.items()), zero)
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in used.items()), zero)
    return F.when(weight > 0, total / weight)


def mix(
    curves: DataFrame, case: Sequence[str], *, weights: Mapping[str, float] = SERIES_WEIGHTS,
    groups: Mapping[str, Sequence[str]] = GROUPS, group_weights: Mapping[str, float] = GROUP_WEIGHTS, whole: bool = True,
) -> DataFrame:
    """Group scores and their blend on the unit grid, for all cases in one job.

    ``curves`` is long: ``(case, period, minute, series, value)`` without nulls.
    """
    d = wide_grid(curves, case, list(weights), whole)
    d = d.withColumns({g: weighted_mean({s: weights.get(s, 0.0) for s in names}) for g, names in groups.items()})
    return d.withColumn("both", weighted_mean(group_weights))
