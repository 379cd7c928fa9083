"""Registry and the views that carry the operators over the driver tables.

``events`` is read as one match per user: 30 days map onto a 90-minute clock (8 real minutes per
clock second), the first 15 days are period 1. ``value`` and ``k`` play position and speed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import Line

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"two queries named {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r8(c: Column) -> Column:
    """For means: two-decimal values over 32 or 64 rows would sit on a rounding tie at six digits."""
    return F.round(c, 8)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    m = us / F.lit(60000000.0)
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
        m.alias("m"),
        (m / 480.0).alias("clock"),
        (m / 8.0).alias("clock_s"),
        F.when(m < 21600, 1).otherwise(2).alias("period"),
        F.when(k % 17 != 0, F.col("value")).alias("vn"),
    )


EV = """ev AS (
  SELECT event_id, user_id, event_type, value, k, m, m / 480.0::DOUBLE AS clock, m / 8.0::DOUBLE AS clock_s,
         CASE WHEN m < 21600 THEN 1 ELSE 2 END AS period,
         CASE WHEN k % 17 <> 0 THEN value END AS vn
  FROM (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               (epoch_us(ts) - 1704067200000000)::DOUBLE / 60000000.0::DOUBLE AS m
        FROM events))"""

# one user in one period
HALF = Line(("user_id", "period"), "clock", ("event_id",))
HALF_S = Line(("user_id", "period"), "clock_s", ("event_id",))
USER = Line(("user_id",), "clock", ("event_id",))


def chosen(spark: SparkSession, line: Line) -> Line:
    """Any user may hold any share of the rows, so no line of the catalogue is bounded."""
    return line


def half(spark: SparkSession, sf_dir: str) -> Line:
    return chosen(spark, HALF)


def half_s(spark: SparkSession, sf_dir: str) -> Line:
    return chosen(spark, HALF_S)


def user(spark: SparkSession, sf_dir: str) -> Line:
    return chosen(spark, USER)


W_HALF = "(PARTITION BY user_id, period ORDER BY clock, event_id)"
