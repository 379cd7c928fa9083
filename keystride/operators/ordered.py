"""Window passes over ordered rows that stay exact, and spread out, when one key holds a large part of the data.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. That is right for groups with a
natural bound (one player in one half is about 1e5 frames), and wrong for open-ended keys. Every
ordered operator of this package therefore goes through the passes below, driven by a :class:`Line`:

* :func:`deal` - rows go to range partitions in row order (keys, time, tie), so a key with all rows
  fills all partitions, whatever its times are. They are written once with the number of their
  partition; every later pass over the same line reads that table.
* :func:`prefix` - running sum/count/min/max/first/last. Totals per key and partition are pre-aggregated
  map-side, accumulated over the (small) table of partitions and joined back as a carry-in.
* :func:`rows_around` - ROWS frames, ``lag``/``lead``. Rows get their exact position by :func:`prefix`,
  are cut into position chunks and the few rows near a border are copied.
* :func:`range_totals` - sums and counts over ``[t - before, t + after]``. Borders are looked up in one pass over
  rows and shifted borders, so the work does not depend on how many rows a frame holds.

A line with ``whole`` set is not dealt: all passes are single windows on its keys. So are those over a table whose
largest key one task may hold (:func:`short_keys`, which counts the rows of every key unless the whole table is small);
a table with a larger key is dealt. Both forms give the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import written

CHUNK_ROWS = 100_000
KEY_ROWS = 1_000_000
JOIN_BYTES = 10 << 20
_UNB = Window.unboundedPreceding


@dataclass(frozen=True)
class Line:
    """Rows of one entity (``keys``) along ``time``; ``tie`` makes the order total.

    ``whole`` says that every entity is small by nature, such as one half of one player, so that one task
    may hold it. Key columns must not be null.
    """

    keys: tuple[str, ...]
    time: str
    tie: tuple[str, ...] = ()
    whole: bool = False

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tie]

    def by(self, *more: str) -> Line:
        """The same line restarted for further key columns."""
        return replace(self, keys=(*self.keys, *more))

    def bounded(self) -> Line:
        return replace(self, whole=True)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def part_name(self, n_keys: int) -> str:
        """Name of the column with the partition number, of a deal by the first ``n_keys`` keys in this order."""
        return f"__part_{zlib.crc32(repr((self.keys[:n_keys], self.order)).encode()):08x}"


def part_of(df: DataFrame, line: Line) -> str | None:
    """The column that numbers the range partitions of ``df`` along ``line``, if it was dealt so.

    A deal by fewer keys serves as well: its partitions follow each other within any finer key.
    """
    names = set(df.columns)
    return next((n for n in map(line.part_name, range(len(line.keys), -1, -1)) if n in names), None)


def one_task(df: DataFrame) -> bool:
    """Whether the whole table is small enough for a single task, by the size that Spark plans with.

    The limit is what Spark would broadcast; ``spark.keystride.oneTaskBytes`` sets another one (0 deals every table). Where
    the size is not known the table counts as large.
    """
    conf = df.sparkSession.conf
    limit = int(conf.get("spark.keystride.oneTaskBytes", None) or JOIN_BYTES)
    if limit <= 0 or not hasattr(df, "_jdf"):
        return False
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def short_keys(df: DataFrame, keys: Sequence[str], held: int = 1) -> bool:
    """Whether one task may hold any key: the table is small (:func:`one_task`), or no key has more than ``KEY_ROWS`` rows.

    A row of which a task holds ``held`` values at once counts so many times. All rows are counted, in one aggregation of the
    key columns. ``spark.keystride.keyRows`` sets another number of rows;
    where the session sets ``oneTaskBytes``, that size alone decides, unless the number is set too.
    """
    if one_task(df):
        return True
    conf = df.sparkSession.conf
    bytes_, rows = (conf.get(f"spark.keystride.{c}", None) for c in ("oneTaskBytes", "keyRows"))
    most = int(rows) if rows else KEY_ROWS if bytes_ is None else 0
    if most <= 0:
        return False
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (top or 0) * held <= most


def settle(df: DataFrame, line: Line) -> tuple[DataFrame, Line]:
    """Rows and line as the passes take them: dealt already, bounded, or dealt now."""
    if line.whole or part_of(df, line):
        return df, line
    return (df, line.bounded()) if short_keys(df, line.keys) else (deal(df, line), line)


def deal(df: DataFrame, line: Line) -> DataFrame:
    """Rows dealt in row order to as many range partitions as shuffles have, written once, with their partition's number."""
    if line.whole or part_of(df, line):
        return df
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *line.keys, *line.order)
    return written(parts.withColumn(line.part_name(len(line.keys)), F.spark_partition_id()))


def dealt(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Deal the rows of ``op(df, line, ...)`` once for all its passes; the number goes if ``df`` did not have it."""

    @wraps(op)
    def run(df: DataFrame, line: Line, *args, **kw) -> DataFrame:
        d, line = settle(df, line)
        out = op(d, line, *args, **kw)
        return out if d is df else out.drop(part_of(d, line))

    return run


def _total(kind: str, value: Column, order: Column) -> Column:
    if kind in ("last", "first"):
        known = F.when(value.isNotNull(), order)
        return (F.max_by if kind == "last" else F.min_by)(value, known)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value)


def _over(kind: str, value: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    if kind == "first":
        return F.first(value, ignorenulls=True).over(w)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value).over(w)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    return {
        "sum": lambda: F.coalesce(carry + local, carry, local),
        "count": lambda: F.coalesce(carry, F.lit(0)) + local,
        "min": lambda: F.least(carry, local),
        "max": lambda: F.greatest(carry, local),
        "last": lambda: F.coalesce(local, carry),
        "first": lambda: F.coalesce(carry, local),
    }[kind]()


def prefix(
    df: DataFrame,
    line: Line,
    specs: Mapping[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Add running aggregates; nulls are skipped.

    ``specs`` maps an output name to ``(kind, column)``. ``inclusive=False`` leaves the current row
    out; ``reverse=True`` runs from the end (``last`` is then the nearest following value).
    """
    d0, line = settle(df, line)
    asc = [F.col(c).desc() if reverse else F.col(c).asc() for c in line.order]
    end = 0 if inclusive else -1
    if line.whole:
        w = Window.partitionBy(*line.keys).orderBy(*asc).rowsBetween(_UNB, end)
        return df.withColumns({n: _over(k, v, w) for n, (k, v) in specs.items()})

    d, part = d0, part_of(d0, line)
    flip = {"last": "first", "first": "last"} if reverse else {}
    order = F.struct(*[F.col(c) for c in line.order])
    names = list(specs)
    totals = d.groupBy(*line.keys, part).agg(
        *[_total(flip.get(specs[n][0], specs[n][0]), specs[n][1], order).alias(f"__c{i}") for i, n in enumerate(names)]
    )
    across = (
        Window.partitionBy(*line.keys)
        .orderBy(F.col(part).desc() if reverse else F.col(part).asc())
        .rowsBetween(_UNB, -1)
    )
    carries = totals.select(
        *line.keys,
        part,
        *[
            _over("sum" if specs[n][0] == "count" else specs[n][0], F.col(f"__c{i}"), across).alias(f"__c{i}")
            for i, n in enumerate(names)
        ],
    )
    local = Window.partitionBy(*line.keys, part).orderBy(*asc).rowsBetween(_UNB, end)
    d = d.withColumns({f"__l{i}": _over(specs[n][0], specs[n][1], local) for i, n in enumerate(names)})
    d = d.join(carries, [*line.keys, part], "left")
    d = d.withColumns({n: _combine(specs[n][0], F.col(f"__c{i}"), F.col(f"__l{i}")) for i, n in enumerate(names)})
    return d.drop(*[f"__{x}{i}" for i in range(len(names)) for x in "cl"], *([] if d0 is df else [part]))


@dealt
def neighbour(df: DataFrame, line: Line, names: Mapping[str, Column], *, following: bool = False) -> DataFrame:
    """``lag(1)`` (or ``lead(1)``) of several columns, nulls kept."""
    if line.whole:
        w = line.window()
        fn = F.lead if following else F.lag
        return df.withColumns({n: fn(c, 1).over(w) for n, c in names.items()})
    row = F.struct(*[c.alias(f"f{i}") for i, c in enumerate(names.values())])
    d = prefix(df, line, {"_near": ("last", row)}, inclusive=False, reverse=following)
    return d.withColumns({n: F.col("_near")[f"f{i}"] for i, n in enumerate(names)}).drop("_near")


@dealt
def rows_around(
    df: DataFrame,
    line: Line,
    before: int,
    after: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Run ``build(df, window)`` where every kept row sees ``before``/``after`` neighbours."""
    if line.whole:
        return build(df, line.window())
    d = prefix(df, line, {"__pos": ("count", F.lit(1))}).withColumn("__pos", F.col("__pos") - 1)
    lo = F.greatest(F.lit(0), F.floor((F.col("__pos") - after) / chunk)).cast("long")
    hi = F.floor((F.col("__pos") + before) / chunk).cast("long")
    d = d.withColumn("__chunk", F.explode(F.sequence(lo, hi)))
    d = build(d, Window.partitionBy(*line.keys, "__chunk").orderBy("__pos"))
    return d.where(F.col("__chunk") == F.floor(F.col("__pos") / chunk)).drop("__pos", "__chunk")


def range_totals(df: DataFrame, line: Line, values: Mapping[str, Column], frames: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Add ``{frame}_{value}``: the total of each value over ``[t - before, t + after]`` of each ``frames[frame] = (before, after)``.

    Nulls count as 0; rows without a time get nulls and are in no frame. Integer values give exact totals,
    doubles the difference of two running sums (see :func:`range_means`).

    On a ``whole`` line the running sums are windows with one open end, which Spark extends row by row: up to
    the upper border in rising order, from the lower border on in falling order; together they hold the frame twice
    and the rest once. Otherwise every row sends its borders into one pass over rows and borders and takes the sums from
    there. Neither depends on how many rows a frame holds.
    """
    t = F.col(line.time)
    if not line.whole and part_of(df, line) is None and short_keys(df, line.keys):
        line = line.bounded()
    known = {n: F.when(t.isNotNull(), F.coalesce(c, F.lit(0))) for n, c in values.items()}
    if line.whole:
        d = df.withColumns({f"__v_{n}": c for n, c in known.items()})
        group = ", ".join([*(f"`{k}`" for k in line.keys), f"`{line.time}` IS NULL"])

        def upto(n: str, reach: float, way: str) -> Column:
            border = f"{abs(float(reach))!r}D {'FOLLOWING' if reach >= 0 else 'PRECEDING'}"
            return F.expr(f"sum(`__v_{n}`) OVER (PARTITION BY {group} ORDER BY `{line.time}` {way} RANGE BETWEEN UNBOUNDED PRECEDING AND {border})")

        d = d.withColumns(
            {
                f"{f}_{n}": F.when(t.isNotNull(), upto(n, after, "ASC") + upto(n, before, "DESC") - F.expr(f"sum(`__v_{n}`) OVER (PARTITION BY {group})"))
                for f, (before, after) in frames.items() for n in known
            }
        )
        return d.drop(*[f"__v_{n}" for n in known])

    d = written(df.withColumn("__row", F.monotonically_increasing_id()))
    slots = list(frames)
    own = F.struct(t.alias("__t"), F.lit(1).alias("__kind"), F.lit(-1).alias("__slot"), *[c.alias(f"__v_{n}") for n, c in known.items()])
    none = [F.lit(None).alias(f"__v_{n}") for n in known]
    # a lower border comes before the rows of its time, an upper one after them
    borders = [
        F.struct(at.alias("__t"), F.lit(kind).alias("__kind"), F.lit(i).alias("__slot"), *none)
        for i, f in enumerate(slots) for kind, at in ((0, t - F.lit(float(frames[f][0]))), (2, t + F.lit(float(frames[f][1]))))
    ]
    points = d.where(t.isNotNull()).select(*line.keys, "__row", F.inline(F.array(own, *borders)))
    walk = Line(line.keys, "__t", ("__kind", "__row", "__slot"))
    points = prefix(points, walk, {f"__s_{n}": ("sum", F.col(f"__v_{n}")) for n in known}).where(F.col("__kind") != 1)
    signed = {n: F.when(F.col("__kind") == 2, 1).otherwise(-1) * F.coalesce(F.col(f"__s_{n}"), F.lit(0)) for n in known}
    totals = points.groupBy("__row").agg(*[F.sum(F.when(F.col("__slot") == i, signed[n])).alias(f"{f}_{n}") for i, f in enumerate(slots) for n in known])
    return d.join(totals, "__row", "left").drop("__row")


def range_means(df: DataFrame, line: Line, value: str, frames: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Add the mean of the values in each frame, null without any; NaN and infinite values count as missing.

    A value is summed as a multiple of 1/1024, which stays exact up to about 8e12, and a small rest, so that
    differences of long running sums keep the digits of a short one.
    """
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value).cast("double"))
    coarse = F.rint(v * 1024) / 1024
    d = range_totals(df, line, {"hi": coarse, "lo": v - coarse, "n": v.isNotNull().cast("long")}, frames)
    d = d.withColumns({f: F.when(F.col(f"{f}_n") > 0, (F.col(f"{f}_hi") + F.col(f"{f}_lo")) / F.col(f"{f}_n")) for f in frames})
    return d.drop(*[f"{f}_{n}" for f in frames for n in ("hi", "lo", "n")])


def range_around(df: DataFrame, line: Line, exprs: Mapping[str, tuple[str, float, float]]) -> DataFrame:
    """Add aggregates over ``[t-before, t+after]`` that are evaluated row by row; for sums use :func:`range_totals`.

    ``exprs`` maps an output name to ``(sql aggregate, before, after)``. A key is cut into slices a few frames
    long and rows near a border are copied into the next one, so a task holds a few frames.
    """
    before, after = (max(e[i] for e in exprs.values()) for i in (1, 2))
    t, width = F.col(line.time), 4.0 * (before + after) or 1.0
    lo, hi = F.floor((t - after) / width).cast("long"), F.floor((t + before) / width).cast("long")
    d = df.withColumn("__slice", F.explode_outer(F.sequence(lo, hi)))
    keys = ", ".join([*(f"`{k}`" for k in line.keys), "__slice"])

    def over(expr: str, back: float, ahead: float) -> Column:
        frame = f"RANGE BETWEEN {float(back)!r}D PRECEDING AND {float(ahead)!r}D FOLLOWING"
        return F.expr(f"{expr} OVER (PARTITION BY {keys} ORDER BY `{line.time}` {frame})")

    d = d.withColumns({n: F.when(t.isNotNull(), over(*e)) for n, e in exprs.items()})
    return d.where(F.col("__slice").eqNullSafe(F.floor(t / width).cast("long"))).drop("__slice")


@dealt
def run_starts(df: DataFrame, line: Line, label: Column, name: str = "run") -> DataFrame:
    """Number runs of equal ``label`` (null counts as a label) from 1 along the line."""
    d = neighbour(df, line, {"_prev": F.struct(label.alias("l"))})
    changed = F.when(F.col("_prev").isNull() | ~F.col("_prev.l").eqNullSafe(label), 1).otherwise(0)
    d = d.withColumn("_new", changed)
    return prefix(d, line, {name: ("sum", F.col("_new"))}).drop("_prev", "_new")
