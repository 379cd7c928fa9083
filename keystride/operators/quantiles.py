"""Exact interpolated quantiles, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 1024  # value buckets per factor e


def value_bucket(v: Column) -> Column:
    """A monotone integer bucket of a double: fine relative steps, both signs, any scale."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v) * F.lit(float(2**20))) * STEPS)).cast("long")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    *,
    bounded: bool = False,
) -> DataFrame:
    """One row per group with the linearly interpolated quantile of the non-null values.

    The work is a distributed selection: equal values are counted map-side, a histogram over value
    buckets tells which bucket holds each wanted rank, and only those buckets are sorted. A caller whose
    groups are small by nature says ``bounded=True`` for the built-in ``percentile``, whose state is the
    group's distinct values. Either way every group has a row, null where it has no value.
    """
    keys = list(keys)
    if bounded:
        return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])

    counts = (
        df.select(*keys, value.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    hist = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_nb"))
    w = Window.partitionBy(*keys)
    hist = hist.select(
        *keys,
        "_b",
        "_nb",
        F.coalesce(F.sum("_nb").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"),
        F.sum("_nb").over(w).alias("_all"),
    )
    names = list(probs)
    pos = {n: F.lit(float(probs[n])) * (F.col("_all") - 1) for n in names}
    low = {n: F.floor(pos[n]) for n in names}
    high = {n: F.ceil(pos[n]) for n in names}

    def holds(rank: Column, at: str, size: str) -> Column:
        return (rank >= F.col(at)) & (rank < F.col(at) + F.col(size))

    wanted = F.lit(False)
    for n in names:
        wanted = wanted | holds(low[n], "_at", "_nb") | holds(high[n], "_at", "_nb")
    picked = counts.join(hist.where(wanted), [*keys, "_b"]) if keys else counts.join(hist.where(wanted), "_b")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    picked = picked.withColumn("_at", F.col("_at") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    aggs = []
    for i, n in enumerate(names):
        aggs += [
            F.max(F.when(holds(low[n], "_at", "_n"), F.col("_v"))).alias(f"_lo{i}"),
            F.max(F.when(holds(high[n], "_at", "_n"), F.col("_v"))).alias(f"_hi{i}"),
            F.max(pos[n] - low[n]).alias(f"_f{i}"),
        ]
    ends = picked.groupBy(*keys).agg(*aggs)
    out = ends.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(n)
            for i, n in enumerate(names)
        ],
    )
    return df.select(*keys).distinct().join(out, keys, "left") if keys else out


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number ``__n`` of rows per group and non-null value."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))


def value_shares(counts: DataFrame, keys: Sequence[str], value: str, out: str, size: str | None = None) -> DataFrame:
    """Of counted values (see :func:`counted`), ``100 * share of the group's values <= this one`` (and the group's number, as ``size``).

    Distinct values are ranked within value buckets, with carries across the buckets; a value that many rows have is one row.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("__b", value_bucket(F.col(value)))
    hist = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__nb")).select(
        *keys,
        "__b",
        F.coalesce(F.sum("__nb").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__at"),
        F.sum("__nb").over(w).alias("__all"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn("__in", F.sum("__n").over(inside)).join(hist, [*keys, "__b"])
    pct = F.lit(100.0) * (F.col("__at") + F.col("__in")) / F.col("__all")
    return ranks.select(*keys, value, pct.alias(out), *([F.col("__all").alias(size)] if size else []))


def share_at_or_below(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``100 * share of the group's non-null values <= this value``, for groups of any size."""
    keys = list(keys)
    ranks = value_shares(counted(df, keys, value), keys, value, out)
    return df.join(ranks, [*keys, value], "left").select(*df.columns, out)
