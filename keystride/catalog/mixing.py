"""Grid, interpolation and blending over three series per region.

Orders per day (count and revenue) and event values, one region per case, one year per period, time in
weeks. Orders exist in every year; events are spread over the years by user, so some cells are missing.
"""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import mix as M
from .base import query, rounded, table

WEIGHTS = {"orders_n": 1.0, "revenue": 1.5, "event_value": 1.0}
GROUPS = {"demand": ("orders_n", "revenue"), "activity": ("event_value",)}
GROUP_WEIGHTS = {"demand": 1.0, "activity": 1.0}


def curves(spark, d):
    """Long curves ``(region, period, minute, series, value)``; region and nation are fixed small tables."""
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    o = o.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    day = F.dayofyear("o_orderdate")
    daily = o.groupBy("region", F.year("o_orderdate").alias("period"), (day / 7.0).alias("minute")).agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("rev")
    )
    daily = daily.select(
        "region", "period", "minute",
        F.inline(
            F.array(
                F.struct(F.lit("orders_n").alias("series"), F.least(F.col("n") / 40.0, F.lit(1.0)).alias("value")),
                F.struct(F.lit("revenue").alias("series"), S.clip_unit(F.col("rev") / 97003 - 20.0, 40.0).alias("value")),
            )
        ),
    )
    e = table(spark, d, "events")
    minute = (F.dayofyear("ts") - 1) * 12 / 7.0 + F.hour("ts") / 24.0
    e = e.groupBy((F.col("user_id") % 5).cast("int").alias("region"), (F.lit(1995) + F.col("user_id") % 9).cast("int").alias("period"), minute.alias("minute"))
    e = e.agg((F.avg("value") / 500.0).alias("value")).withColumn("series", F.lit("event_value"))
    return daily.unionByName(e)


CURVES = """dly AS (SELECT n_regionkey AS region, year(o_orderdate)::INT AS period, dayofyear(o_orderdate) / 7.0::DOUBLE AS minute, count(*) AS n, sum(o_totalprice) AS rev FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 cv AS (SELECT region, period, minute, 'orders_n' AS series, least(n / 40.0::DOUBLE, 1) AS value FROM dly UNION ALL SELECT region, period, minute, 'revenue', greatest(0, least(1, (rev / 97003 - 20 + 40) / 80)) FROM dly
  UNION ALL SELECT (user_id % 5)::INT, (1995 + user_id % 9)::INT, (dayofyear(ts) - 1) * 12 / 7.0::DOUBLE + hour(ts) / 24.0::DOUBLE AS minute, 'event_value', avg(value) / 500 FROM events GROUP BY ALL),
 gr AS (SELECT region, period, generate_series AS minute FROM (SELECT region, period, floor(min(minute))::INT AS lo, ceil(max(minute))::INT AS hi FROM cv GROUP BY ALL), generate_series(lo, hi)),
 kn AS (SELECT *, lead(minute) OVER (PARTITION BY region, period, series ORDER BY minute) AS t1, lead(value) OVER (PARTITION BY region, period, series ORDER BY minute) AS v1 FROM cv),
 ip AS (SELECT g.region, g.period, g.minute::DOUBLE AS minute, k.series, CASE WHEN g.minute = k.minute THEN k.value ELSE k.value + (k.v1 - k.value) * (g.minute - k.minute) / (k.t1 - k.minute) END AS value
   FROM gr g JOIN kn k ON g.region = k.region AND g.period = k.period AND k.minute <= g.minute AND (g.minute < k.t1 OR g.minute = k.minute))"""


@query("m01_unit_grid", f"WITH {CURVES} SELECT region, period, minute::DOUBLE AS minute FROM gr")
def _(spark, d):
    return M.unit_grid(curves(spark, d), ["region"])


@query("m02_interpolate", f"WITH {CURVES} SELECT region, period, series, minute, round(value, 8) AS value FROM ip")
def _(spark, d):
    return rounded(M.interpolate(curves(spark, d), ["region"]), "value", digits=8)


@query("m02_equal_knots", """
WITH e AS (SELECT user_id, event_id, floor(epoch(ts) / 86400)::BIGINT % 90 AS day, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
 kn AS (SELECT user_id, day / 2.0::DOUBLE AS minute, arg_max(value, event_id) AS va, arg_min(value, event_id) AS vf FROM e GROUP BY ALL),
 nx AS (SELECT *, lead(minute) OVER w AS t1, lead(vf) OVER w AS v1 FROM kn WINDOW w AS (PARTITION BY user_id ORDER BY minute)),
 g AS (SELECT nx.*, g AS m FROM nx, generate_series(0, 45) s(g) WHERE g >= minute AND (g < t1 OR g = minute))
SELECT user_id::VARCHAR AS "case", m::DOUBLE AS minute, round(CASE WHEN m = minute THEN va ELSE va + (v1 - va) / (t1 - minute) * (m - minute) END, 6) AS value FROM g""")
def _(spark, d):
    """Several values a day: a stretch ends at the first and begins at the last of equal knots."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) % 90
    c = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("case"), F.lit(1).alias("period"), (day / 2.0).alias("minute"), F.lit("s").alias("series"), "value", F.col("event_id").alias("source_row")
    )
    return rounded(M.interpolate(c, ["case"]).select("case", "minute", "value"), "value")


@query("m03_weighted_mean", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value / 500 END AS a, CASE WHEN event_id % 4 <> 0 THEN value / 700 END AS b, CASE WHEN event_id % 5 <> 0 THEN 0.25 END AS c FROM events)
SELECT event_id, round((coalesce(a, 0) + 1.5 * coalesce(b, 0) + 0.5 * coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + 1.5 * (b IS NOT NULL)::INT + 0.5 * (c IS NOT NULL)::INT, 0), 8) AS score FROM t""")
def _(spark, d):
    i = F.col("event_id")
    t = table(spark, d, "events").select(
        "event_id", F.when(i % 3 != 0, F.col("value") / 500).alias("a"), F.when(i % 4 != 0, F.col("value") / 700).alias("b"), F.when(i % 5 != 0, 0.25).alias("c"), F.lit(9.0).alias("off")
    )
    return t.select("event_id", F.round(M.weighted_mean({"a": 1.0, "b": 1.5, "c": 0.5, "off": 0.0}), 8).alias("score"))


SCORES = f"""{CURVES}, wd AS (SELECT g.region, g.period, g.minute::DOUBLE AS minute, max(CASE WHEN series = 'orders_n' THEN value END) AS orders_n, max(CASE WHEN series = 'revenue' THEN value END) AS revenue, max(CASE WHEN series = 'event_value' THEN value END) AS event_value
  FROM gr g LEFT JOIN ip ON g.region = ip.region AND g.period = ip.period AND g.minute = ip.minute GROUP BY ALL),
 sc AS (SELECT *, (coalesce(orders_n, 0) + 1.5 * coalesce(revenue, 0)) / nullif((orders_n IS NOT NULL)::INT + 1.5 * (revenue IS NOT NULL)::INT, 0) AS demand, event_value AS activity FROM wd)"""


@query("m04_group_scores", f"WITH {SCORES} SELECT region, period, minute, round(demand, 8) AS demand, round(activity, 8) AS activity, round((coalesce(demand, 0) + coalesce(activity, 0)) / nullif((demand IS NOT NULL)::INT + (activity IS NOT NULL)::INT, 0), 8) AS \"both\" FROM sc")
def _(spark, d):
    out = mixed(spark, d).select("region", "period", "minute", "demand", "activity", "both")
    return rounded(out, "demand", "activity", "both", digits=8)


def mixed(spark, d):
    return M.mix(curves(spark, d), ["region"], weights=WEIGHTS, groups=GROUPS, group_weights=GROUP_WEIGHTS)


FULL = f"""WITH {SCORES} SELECT region, period, minute, round(orders_n, 8) AS orders_n, round(revenue, 8) AS revenue, round(event_value, 8) AS event_value, round(demand, 8) AS demand, round(activity, 8) AS activity,
 round((coalesce(demand, 0) + coalesce(activity, 0)) / nullif((demand IS NOT NULL)::INT + (activity IS NOT NULL)::INT, 0), 8) AS "both" FROM sc"""


def _full(spark, d):
    return rounded(mixed(spark, d), "orders_n", "revenue", "event_value", "demand", "activity", "both", digits=8)


@query("m05_mix_end_to_end", f"WITH base AS ({FULL}) SELECT region, period, count(*) AS grid_rows, count(demand) AS demand_finite, count(activity) AS activity_finite, round(avg(\"both\"), 7) AS mean_both FROM base GROUP BY ALL")
def _(spark, d):
    t = _full(spark, d).groupBy("region", "period").agg(
        F.count("*").alias("grid_rows"), F.count("demand").alias("demand_finite"), F.count("activity").alias("activity_finite"), F.avg("both").alias("mean_both")
    )
    return rounded(t, "mean_both", digits=7)


query("c09_mix", FULL)(_full)
