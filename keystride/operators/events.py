"""Event detection on a measured line: hysteresis, threshold runs, merging, segments, recovery gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .joins import as_of_label
from .ordered import Line, dealt, neighbour, prefix, rows_around, run_starts, settle
from .quantiles import quantiles

# Fixed values
K_HIGH, K_LOW = 2.25, -1.5
MERGE_GAP_S = 1.25
SPRINT_SPEED = 7.0
MIN_SAMPLES = 3
DEFAULT_STEP_S = 0.04


def _cut(df: DataFrame, line: Line) -> DataFrame:
    return df if line.whole else stage(df)


def speed_thresholds(df: DataFrame, keys: Sequence[str], v: str, k_high: float = 1.0, k_low: float = 1.0) -> DataFrame:
    """Entity thresholds ``mean + k_high*sd`` and ``max(0, mean - k_low*sd)``; null under 10 samples."""
    mu, sd = F.avg(v), F.stddev_pop(v)
    d = df.groupBy(*keys).agg(F.count(v).alias("n"), mu.alias("mu_v"), sd.alias("sigma_v"))
    enough = F.col("n") >= 10
    low = F.col("mu_v") - k_low * F.col("sigma_v")
    return d.select(
        *keys, "n",
        *[F.when(enough, c).alias(n) for n, c in (
            ("mu_v", F.col("mu_v")), ("sigma_v", F.col("sigma_v")),
            ("t_high", F.col("mu_v") + k_high * F.col("sigma_v")), ("t_low", F.greatest(F.lit(0.0), low)),
        )],
    )


def event_metrics(rows: DataFrame, by: Sequence[str], time: str, v: str, *, clock: str, step: str, acc: str, jerk: str) -> DataFrame:
    """One row of times, speeds, distance and acceleration/jerk statistics per event."""
    t = F.col(time)
    edge = {f"{n}_{w}": f(w2, time) for w, w2 in (("time_s", time), ("clock_min", clock)) for n, f in (("start", F.min_by), ("end", F.max_by))}
    peak = F.struct(F.col(v), -t)
    known = F.when(F.col(v).isNotNull(), peak)
    d = rows.groupBy(*by).agg(
        *[c.alias(n) for n, c in edge.items()],
        F.max_by(time, known).alias("peak_time_s"),
        F.max_by(clock, known).alias("peak_clock_min"),
        F.sum(v).alias("sum_speed"), F.avg(v).alias("mean_speed"), F.max(v).alias("peak_speed"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("distance_m"),
        F.max(acc).alias("max_acc"), F.min(acc).alias("min_acc"),
        F.avg(F.when(F.col(acc) > 0, F.col(acc))).alias("mean_acc"), F.avg(F.abs(acc)).alias("mean_abs_acc"),
        F.max(jerk).alias("max_jerk"), F.min(jerk).alias("min_jerk"),
        F.avg(jerk).alias("mean_jerk"), F.avg(F.abs(jerk)).alias("mean_abs_jerk"),
        F.count(v).alias("n_samples"),
    )
    return d.withColumn("duration_s", F.col("end_time_s") - F.col("start_time_s"))


@dealt
def hysteresis_rows(df: DataFrame, line: Line, v: str, low: str = "t_low", high: str = "t_high") -> DataFrame:
    """Rows of every event with its number ``_event``; thresholds are columns.

    An event opens where ``v`` rises through ``low`` and runs to the last row before it falls below,
    or to the end of the line if it is still at or above ``low`` there. It counts when ``high`` is
    reached after its first row. Nulls neither open nor close. Flags: rises and falls need both
    neighbours, the number of earlier falls groups the rows, the first rise of a group opens.
    """
    x, lo = F.col(v), F.col(low)

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumns({"_rise": (F.lag(x, 1).over(w) < lo) & (x >= lo), "_fall": (x >= lo) & (F.lead(x, 1).over(w) < lo)})

    d = df.where(F.col(high) > lo)
    d = _cut(rows_around(d, line, 1, 1, build), line)
    falls = F.when(F.col("_fall"), 1).otherwise(0)
    d = _cut(prefix(d, line, {"_event": ("count", F.when(falls == 1, 1))}, inclusive=False), line)
    group = line.by("_event")
    d = prefix(d, group, {"_open": ("count", F.when(F.col("_rise"), 1))}).where(F.col("_open") > 0)
    d = _cut(d, line)
    d = neighbour(d, group, {"_p": F.struct(x.alias("x"))})
    later = F.when(F.col("_p").isNotNull(), x)
    if line.whole:
        # the groups are already together, so their totals are windows on the same exchange
        whole = Window.partitionBy(*line.keys, "_event")
        ends = whole.orderBy(*line.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.withColumns({"_top": F.max(later).over(whole), "_last": F.last(x).over(ends), "_n": F.count(x).over(whole)})
        keep = (F.col("_top") >= F.col(high)) & (F.col("_last") >= lo) & (F.col("_n") >= MIN_SAMPLES)
        return d.where(keep).drop("_rise", "_fall", "_open", "_p", "_top", "_last", "_n")
    good = d.groupBy(*line.keys, "_event").agg(
        F.max(later).alias("_top"), F.max_by(x, F.struct(*line.order)).alias("_last"),
        F.max(high).alias("_hi"), F.max(low).alias("_lo"), F.count(x).alias("_n"),
    )
    good = good.where((F.col("_top") >= F.col("_hi")) & (F.col("_last") >= F.col("_lo")) & (F.col("_n") >= MIN_SAMPLES))
    return d.join(good.select(*line.keys, "_event"), [*line.keys, "_event"]).drop("_rise", "_fall", "_open", "_p")


def hysteresis_events(df: DataFrame, line: Line, v: str, **cols) -> DataFrame:
    """Events with their metrics; ``cols`` are ``clock, step, acc, jerk``."""
    rows = hysteresis_rows(df, line, v)
    return event_metrics(rows, [*line.keys, "_event", "t_low", "t_high"], line.time, v, **cols).drop("_event")


def threshold_events(df: DataFrame, line: Line, v: str, threshold: float = SPRINT_SPEED, min_samples: int = MIN_SAMPLES, **cols) -> DataFrame:
    """Runs of at least ``min_samples`` rows with ``v > threshold``."""
    above = F.coalesce(F.col(v) > threshold, F.lit(False))
    d = run_starts(df.withColumn("_above", above), line, F.col("_above")).where("_above")
    d = event_metrics(d, [*line.keys, "run"], line.time, v, **cols).where(F.col("n_samples") >= min_samples)
    return d.drop("run").withColumns({"t_low": F.lit(float(threshold)), "t_high": F.lit(float(threshold))})


def merge_clusters(events: DataFrame, line: Line, gap: float) -> DataFrame:
    """Outer times and number of atoms of events whose gap is in ``[0, gap)``."""
    ev = Line(line.keys, "start_time_s", ("end_time_s",), line.whole)
    events, ev = settle(events, ev)
    d = neighbour(events, ev, {"_pe": F.col("end_time_s")})
    between = F.col("start_time_s") - F.col("_pe")
    d = d.withColumn("_new", F.when((between >= 0) & (between < gap), 0).otherwise(1))
    d = prefix(d, ev, {"_cluster": ("sum", F.col("_new"))})
    return d.groupBy(*line.keys, "_cluster").agg(
        F.min("start_time_s").alias("_c0"), F.max("end_time_s").alias("_c1"), F.count(F.lit(1)).alias("n_atoms")
    )


def merge_close_events(events: DataFrame, samples: DataFrame, line: Line, v: str, gap: float = MERGE_GAP_S, **cols) -> DataFrame:
    """Merge close events and recompute the metrics over the whole stretch from its samples."""
    clusters = _cut(merge_clusters(events, line, gap), line)
    rows = as_of_label(
        samples, clusters, list(line.keys), line.time, "_c0", "_c1", {"_cluster": None, "n_atoms": None}, whole=line.whole, closed=True
    )
    rows = rows.where(F.col("_cluster").isNotNull())
    return event_metrics(rows, [*line.keys, "_cluster", "n_atoms"], line.time, v, **cols).drop("_cluster")


def recovery_gaps(events: DataFrame, keys: Sequence[str], whole: bool = False, out: str = "recovery_before_s") -> DataFrame:
    """Time since the previous event's end (null when negative); ``keys`` with the period restarts there."""
    line = Line(tuple(keys), "start_time_s", ("end_time_s",), whole)
    d = neighbour(events, line, {"_pe": F.col("end_time_s")})
    rest = F.col("start_time_s") - F.col("_pe")
    return d.withColumn(out, F.when(rest >= 0, rest)).drop("_pe")


def number_events(events: DataFrame, keys: Sequence[str], whole: bool = False) -> DataFrame:
    return prefix(events, Line(tuple(keys), "start_time_s", ("end_time_s",), whole), {"event_id": ("count", F.lit(1))})


@dealt
def sprint_table(df: DataFrame, line: Line, v: str, entity: Sequence[str], *, k_high: float = K_HIGH, k_low: float = K_LOW, gap: float = MERGE_GAP_S, **cols) -> DataFrame:
    """Thresholds per entity, hysteresis events, merging, and recovery restarted per period."""
    thr = speed_thresholds(df, entity, v, k_high, k_low).select(*entity, "t_low", "t_high")
    d = _cut(df, line)
    atoms = _cut(hysteresis_events(d.join(thr, list(entity)), line, v, **cols), line)
    merged = _cut(merge_close_events(atoms, d, line, v, gap, **cols), line)
    return recovery_gaps(merged, line.keys, line.whole)


@dealt
def label_segments(df: DataFrame, line: Line, label: str) -> DataFrame:
    """Contiguous stretches of one label with bounds, duration and row count."""
    d = run_starts(df, line, F.col(label), "segment")
    return d.groupBy(*line.keys, "segment", label).agg(
        F.min(line.time).alias("t0"), F.max(line.time).alias("t1"), F.count(F.lit(1)).alias("n_frames")
    ).withColumn("duration", F.col("t1") - F.col("t0"))


@dealt
def phase_durations(df: DataFrame, line: Line, label: str) -> DataFrame:
    """Segment lengths plus one median sample step, so they match the frames they cover."""
    d = neighbour(df, line, {"_t": F.col(line.time)})
    step = quantiles(d, list(line.keys), F.col(line.time) - F.col("_t"), {"_dt": 0.5}, bounded=line.whole)
    segs = label_segments(d.drop("_t"), line, label).join(step, list(line.keys), "left")
    dt = F.when(F.col("_dt") > 0, F.col("_dt")).otherwise(DEFAULT_STEP_S)
    length = F.greatest(F.col("t1") - F.col("t0") + dt, dt)
    return segs.select(*line.keys, label, "t0", "t1", length.alias("duration_s"), (length / 60.0).alias("duration_min"))
