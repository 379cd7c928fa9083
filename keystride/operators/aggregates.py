"""Reference profiles, inventories, shares, calibrations and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from .quantiles import quantiles
from .windows import METRICS

# Fixed values
NICE_WIDTHS = (0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0, 90.0, 120.0, 180.0, 300.0)
DEFAULT_WIDTH = 5.0
SPEED_BIN, MIN_IN_BIN, MIN_SPEED = 0.2, 15, 0.2
CORE_M, CORE_ROWS, RADIUS_Q, RADIUS_MIN, RADIUS_MAX = 8.0, 30, 0.95, 1.0, 3.5


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """A constant key stands in for no keys, so per-group tables can be joined."""
    if keys:
        return df, list(keys), []
    return df.withColumn("_whole", F.lit(1)), ["_whole"], ["_whole"]


def reference_profiles(minutes: DataFrame, code: str, minute: str = "minute", metric: str = "metric", value: str = "value", n_minutes: int = 90, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Count, mean and sample sd per (level, group, minute, metric); empty cells are kept.

    Every row counts once for its detailed code and once for its coarse group, in one hash aggregate.
    """
    both = F.array(
        F.struct(F.lit("detailed").alias("level"), F.col(code).alias("group")),
        F.struct(F.lit("coarse").alias("level"), codes.coarse_position(F.col(code)).alias("group")),
    )
    d = minutes.where(F.col(value).isNotNull()).select(minute, metric, value, F.inline(both)).where(F.col("group").isNotNull())
    cells = d.groupBy("level", "group", minute, metric).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    grid = cells.select("level", "group").distinct().withColumn(metric, F.explode(F.array(*[F.lit(m) for m in metrics])))
    grid = grid.withColumn(minute, F.explode(F.sequence(F.lit(1), F.lit(n_minutes))))
    full = grid.join(cells, ["level", "group", minute, metric], "left")
    return full.withColumn("n", F.coalesce("n", F.lit(0)))


def unknown_codes(df: DataFrame, code: str) -> DataFrame:
    return df.where(F.col(code).isNotNull() & codes.coarse_position(F.col(code)).isNull()).select(code).distinct()


def roster_inventory(roster: DataFrame, code: str, match: str) -> DataFrame:
    d = roster.where(F.col(code).isNotNull() & (F.col(code) != "")).withColumn("code", F.upper(code))
    return d.groupBy("code", codes.coarse_position(F.col("code")).alias("coarse")).agg(
        F.count(F.lit(1)).alias("n_roster_rows"), F.countDistinct(match).alias("n_matches")
    )


def value_shares(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    """Rows and percentage per label, nulls as ``NA``."""
    d = df.groupBy(F.coalesce(label.cast("string"), F.lit("NA")).alias(name)).agg(F.count(F.lit(1)).alias("n_frames"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return d.select(name, "n_frames", (100.0 * F.col("n_frames") / total).alias("pct"))


def segment_stats(segments: DataFrame, label: str, duration: str = "duration") -> DataFrame:
    d = F.col(duration)
    out = segments.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_segments"), F.avg(d).alias("mean_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"), F.sum(d).alias("total_s")
    )
    return out.join(quantiles(segments, [label], d, {"median_s": 0.5}), label)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cross table with margins (``All``) and the agreement rate of each cell."""
    d = df.select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b))
    out = d.cube(a, b).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agree"),
        F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"),
    )
    return out.select(
        F.when(F.col("_ga") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("_gb") == 1, "All").otherwise(F.col(b)).alias(b), "n", "agree"
    )


def radius_calibration(df: DataFrame, keys: Sequence[str], dist: str, *, q: float = RADIUS_Q, bounded: bool = False) -> DataFrame:
    """Control radius from actor-ball distances: the core's quantile, clipped, with distance statistics."""
    df, keys, whole = _keyed(df, keys)
    d = df.where(F.col(dist).isNotNull()).withColumn("_core", F.when(F.col(dist) <= CORE_M, F.col(dist)))
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_measured"), F.count("_core").alias("n_core"), F.avg(dist).alias("mean"))
    stats = quantiles(d, keys, F.col(dist), {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "_all": q}, bounded=bounded)
    core = quantiles(d, keys, F.col("_core"), {"core_p95": 0.95, "_cq": q}, bounded=bounded)
    out = out.join(stats, keys).join(core, keys, "left")
    raw = F.when(F.col("n_core") >= CORE_ROWS, F.col("_cq")).otherwise(F.col("_all"))
    out = out.withColumn("rpz_raw", F.coalesce(raw, F.lit(1.5)))
    return out.withColumn("rpz", F.greatest(F.lit(RADIUS_MIN), F.least(F.lit(RADIUS_MAX), F.col("rpz_raw")))).drop("_all", "_cq", *whole)


def speed_profile(df: DataFrame, keys: Sequence[str], speed: str, acc: str, *, width: float = SPEED_BIN, min_n: int = MIN_IN_BIN, floor: float = MIN_SPEED, positive_only: bool = False) -> DataFrame:
    """Acceleration by right-closed speed bin: p90, p10, mean and median of bins with enough rows."""
    d = df.where(F.col(speed).isNotNull() & F.col(acc).isNotNull() & (F.col(speed) > floor))
    if positive_only:
        d = d.where(F.col(acc) > 0)
    d = d.withColumn("bin", F.ceil(F.col(speed) / width).cast("long"))
    g = [*keys, "bin"]
    out = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg(acc).alias("mean")).where(F.col("n") >= min_n)
    q = quantiles(d, g, F.col(acc), {"p90": 0.9, "p10": 0.1, "median": 0.5})
    return out.join(q, g).withColumn("centre", (F.col("bin") - 0.5) * width).drop("bin")


def nice_bin_width(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Freedman-Diaconis width of the positive values, snapped to a readable grid."""
    df, keys, whole = _keyed(df, keys)
    d = df.where(F.col(value) > 0)
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.stddev_pop(value).alias("_sd"))
    q = quantiles(d, keys, F.col(value), {"_q1": 0.25, "_q3": 0.75})
    out = s.join(q, keys)
    fd = 2.0 * (F.col("_q3") - F.col("_q1")) / F.cbrt(F.col("n"))
    span = F.col("_hi") - F.col("_lo")
    bins = F.when((fd > 0) & (span > 0), F.ceil(span / fd)).otherwise(1)
    raw = F.when(span > 0, span / bins).otherwise(F.lit(1.0))
    out = out.withColumn("raw_width", raw)
    nearest = F.array_min(F.transform(F.array(*[F.lit(w) for w in NICE_WIDTHS]), lambda w: F.struct(F.abs(w - F.col("raw_width")).alias("d"), w.alias("w"))))["w"]
    return out.select(*[k for k in keys if k not in whole], "n", F.when(F.col("n") >= 2, nearest).otherwise(DEFAULT_WIDTH).alias("width"))


def duration_histogram(segments: DataFrame, label: str, duration: str) -> DataFrame:
    """Counts per (label, bin) on one common nice width, with each label's median."""
    width = nice_bin_width(segments, [], duration).select("width").scalar()
    d = segments.withColumn("width", width).groupBy(label, F.floor(F.col(duration) / F.col("width")).cast("long").alias("bin"), "width").agg(F.count(F.lit(1)).alias("n"))
    return d.join(quantiles(segments, [label], F.col(duration), {"median_s": 0.5}), label)


def phase_delta(df: DataFrame, keys: Sequence[str], phase: str, cols: Sequence[str]) -> DataFrame:
    """Late minus early median of each column."""
    out = None
    for c in cols:
        q = quantiles(df, [*keys, phase], F.col(c), {"_m": 0.5})
        q = q.groupBy(*keys).agg(
            (F.max(F.when(F.col(phase) == "late", F.col("_m"))) - F.max(F.when(F.col(phase) == "early", F.col("_m")))).alias(f"delta_{c}")
        )
        out = q if out is None else out.join(q, list(keys), "full")
    return out


def clip_report(df: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(v > limit).alias("n_hi"), F.count_if(v < -limit).alias("n_lo"))


def half_totals(df: DataFrame, keys: Sequence[str], success: str) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.col(success))
    return df.groupBy(*keys).agg(n.alias("n"), ok.alias("n_ok"), (100.0 * ok / n).alias("overall_pct"))
