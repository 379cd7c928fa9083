"""Strided differences, gap segments, moving averages and step distances along a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import stage
from .ordered import Line, dealt, neighbour, part_of, prefix, rows_around, settle
from .quantiles import quantiles

# Fixed values
STRIDE = 12
AVERAGE_ROWS = 16
GAP_FACTOR = 2.5
SPEED_CAP = 15.0
DEFAULT_FPS = 29.97
DEFAULT_HZ = 30.0


@dealt
def segments(df: DataFrame, line: Line, gap_factor: float = GAP_FACTOR) -> DataFrame:
    """Number the stretches between time gaps above ``gap_factor`` times the line's median step.

    Adds ``dt`` (step from the previous row of the same stretch) and ``segment`` (from 0).
    """
    d = neighbour(df, line, {"_t0": F.col(line.time)}).withColumn("dt", F.col(line.time) - F.col("_t0"))
    if line.whole:
        d = d.withColumn("_med", F.percentile("dt", F.lit(0.5)).over(Window.partitionBy(*line.keys)))
    else:
        d = stage(d)
        d = d.join(quantiles(d, list(line.keys), F.col("dt"), {"_med": 0.5}), list(line.keys), "left")
    gap = (F.col("_med") > 0) & (F.col("dt") > gap_factor * F.col("_med"))
    d = d.withColumn("_gap", F.when(gap, 1).otherwise(0))
    d = prefix(d, line, {"segment": ("sum", F.col("_gap"))})
    return d.withColumn("dt", F.when(F.col("_gap") == 0, F.col("dt"))).drop("_t0", "_med", "_gap")


def strided(x: Column, h: Column, s: int, w: WindowSpec) -> tuple[Column, Column, Column]:
    """First, second and third central difference over a stride of ``s`` rows of step ``h``."""
    hs = s * h
    p1, p2, n1, n2 = F.lag(x, s).over(w), F.lag(x, 2 * s).over(w), F.lead(x, s).over(w), F.lead(x, 2 * s).over(w)
    ok = hs > 0
    return (
        F.when(ok, (n1 - p1) / (2.0 * hs)),
        F.when(ok, (n1 - 2.0 * x + p1) / (hs * hs)),
        F.when(ok, (n2 - 2.0 * n1 + 2.0 * p1 - p2) / (2.0 * hs * hs * hs)),
    )


def moving_average(x: Column, rows: int, w: WindowSpec) -> Column:
    """Centred mean over exactly ``rows`` non-null rows; even widths reach one further back."""
    frame = w.rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    return F.when(F.count(x).over(frame) == rows, F.avg(x).over(frame))


@dealt
def stride_kinematics(
    df: DataFrame,
    line: Line,
    x: str = "x",
    y: str = "y",
    *,
    stride: int = STRIDE,
    average: int = AVERAGE_ROWS,
    cap: float | None = SPEED_CAP,
    chunk: int = 100_000,
) -> DataFrame:
    """Velocity, acceleration and jerk with their averaged forms, per gap segment of the line.

    Segments under ``2*stride + 1`` rows stay null. Over the cap, velocity and speed become null while
    the tangential acceleration is kept.
    """
    d = segments(df, line)
    keys = [*line.keys, "segment"]
    inner = line.by("segment")
    if line.whole:
        w = Window.partitionBy(*keys)
        d = d.withColumns({"_h": F.percentile("dt", F.lit(0.5)).over(w), "_n": F.count(F.lit(1)).over(w)})
    else:
        d = stage(d)
        sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        d = d.join(sizes.join(quantiles(d, keys, F.col("dt"), {"_h": 0.5}), keys, "left"), keys)
    h = F.when(F.col("_n") >= 2 * stride + 1, F.col("_h"))
    s = stride

    def build(part: DataFrame, w: WindowSpec) -> DataFrame:
        vx, ax, jx = strided(F.col(x), F.col("_hh"), s, w)
        vy, ay, jy = strided(F.col(y), F.col("_hh"), s, w)
        part = part.withColumn("_hh", h).withColumns({"vx": vx, "vy": vy, "ax": ax, "ay": ay, "jx": jx, "jy": jy})
        part = part.withColumns(
            {
                "speed": F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2),
                "acc": F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2),
                "jerk": F.sqrt(F.col("jx") ** 2 + F.col("jy") ** 2),
                "_axm": moving_average(F.col("ax"), average, w),
                "_aym": moving_average(F.col("ay"), average, w),
            }
        )
        part = part.withColumns(
            {
                "a_tan": strided(F.col("speed"), F.col("_hh"), s, w)[0],
                "_jxm": strided(F.col("_axm"), F.col("_hh"), s, w)[0],
                "_jym": strided(F.col("_aym"), F.col("_hh"), s, w)[0],
            }
        )
        return part.withColumn("a_tan_use", moving_average(F.col("a_tan"), average, w))

    reach = 2 * s + average
    d = rows_around(d, inner, reach, reach, build, chunk)
    d = d.withColumns(
        {
            "acc_use": F.sqrt(F.col("_axm") ** 2 + F.col("_aym") ** 2),
            "jerk_use": F.sqrt(F.col("_jxm") ** 2 + F.col("_jym") ** 2),
        }
    )
    if cap is not None:
        slow = ~(F.col("speed") > cap) | F.col("speed").isNull()
        d = d.withColumns({c: F.when(slow, F.col(c)) for c in ("vx", "vy", "speed")})
    return d.drop("_h", "_n", "_hh", "_axm", "_aym", "_jxm", "_jym")


@dealt
def step_distance(df: DataFrame, line: Line, x: str = "x", y: str = "y", out: str = "step_dist") -> DataFrame:
    """Distance from the previous row; null on the first row and where time does not advance."""
    d = neighbour(df, line, {"_x": F.col(x), "_y": F.col(y), "_t": F.col(line.time)})
    moved = F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))
    return d.withColumn(out, F.when(F.col(line.time) > F.col("_t"), moved)).drop("_x", "_y", "_t")


@dealt
def forward_rate(df: DataFrame, line: Line, change: str, out: str, *, min_rows: int, cap: float | None = None, y=()) -> DataFrame:
    """Change per time from the previous row; the first row takes the second row's value.

    ``change`` is ``"difference"`` of one column or ``"distance"`` over two. Lines under ``min_rows``
    rows (2 or 3) keep a null first row.
    """
    cols = [F.col(c) for c in y]
    t = F.col(line.time)

    def build(part: DataFrame, w: WindowSpec) -> DataFrame:
        def rate(near: int) -> Column:
            # near=1: previous row to this one; near=-1: this row to the next one
            def other(c):
                return F.lag(c, 1).over(w) if near == 1 else F.lead(c, 1).over(w)

            deltas = [near * (c - other(c)) for c in cols]
            size = deltas[0] if change == "difference" else F.hypot(*deltas)
            dt = near * (t - other(t))
            return F.when(dt > 0, size / dt)

        enough = F.lead(F.lit(1), min_rows - 1).over(w).isNotNull()
        first = F.lag(F.lit(1), 1).over(w).isNull()
        return part.withColumn(out, F.when(first, F.when(enough, rate(-1))).otherwise(rate(1)))

    d = rows_around(df, line, 1, 2, build)
    return d.withColumn(out, F.when(F.col(out) <= cap, F.col(out))) if cap is not None else d


def simple_speed(df: DataFrame, line: Line, x: str = "x", y: str = "y", out: str = "speed") -> DataFrame:
    return forward_rate(df, line, "distance", out, min_rows=2, cap=SPEED_CAP, y=(x, y))


def time_derivative(df: DataFrame, line: Line, y: str, out: str) -> DataFrame:
    return forward_rate(df, line, "difference", out, min_rows=3, y=(y,))


def sample_interval(df: DataFrame, line: Line) -> DataFrame:
    """Median positive time step per line (``median_dt``, null if unknown) and ``dt``/``fps``/``hz`` with defaults."""
    part = part_of(df, line)
    d, line = settle(df.where(F.col(line.time).isNotNull()).select(*line.keys, *line.order, *([part] if part else [])), line)
    d = neighbour(d, line, {"_t0": F.col(line.time)}).withColumn("_dt", F.col(line.time) - F.col("_t0"))
    keys = list(line.keys)
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    med = quantiles(d.where(F.col("_dt") > 0), keys, F.col("_dt"), {"_med": 0.5}, bounded=line.whole)
    m = F.col("_med")
    return sizes.join(med, keys, "left").select(
        *keys,
        "n",
        m.alias("median_dt"),
        F.coalesce(m, F.lit(1.0 / DEFAULT_FPS)).alias("dt"),
        F.coalesce(F.when(F.col("n") >= 3, 1.0 / m), F.lit(DEFAULT_FPS)).alias("fps"),
        F.coalesce(F.when(F.col("n") >= 3, 1.0 / m), F.lit(DEFAULT_HZ)).alias("hz"),
    )
