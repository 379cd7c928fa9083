"""Band joins: equi-joins on time buckets, so one hot key is spread over its buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    before: float,
    after: float,
    *,
    how: str = "inner",
    closed: bool = True,
) -> DataFrame:
    """Pairs with ``left-before <= right <= left+after`` (``closed=False``: right end open).

    Column names must differ apart from ``keys``. With ``how="left"`` a left row touching two buckets
    may also come back unmatched, so aggregate over the left row with null-skipping functions.
    """
    width = float(before + after) or 1.0
    lt, rt = F.col(left_time), F.col(right_time)
    lo, hi = F.floor((lt - before) / width).cast("long"), F.floor((lt + after) / width).cast("long")
    many = left.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    one = right.withColumn("_bucket", F.floor(rt / width).cast("long"))
    upper = rt <= lt + after if closed else rt < lt + after
    one = one.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = (F.col("_bucket") == F.col("_rb")) & (rt >= lt - before) & upper
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return many.join(one.withColumnRenamed("_bucket", "_rb"), on, how).drop("_bucket", "_rb", *[f"_r_{k}" for k in keys])
