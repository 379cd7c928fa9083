"""Curve CSVs of many cases to one long table, and the sinks."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.mix import SERIES_WEIGHTS

# File -> (minute column, [(series, value column, needed value of a selector column)])
FILES = {
    "01f_pc_synergy_m_80_1450_timewin.csv": ("minute", [("tight_w3", "m_w3", None)]),
    "02_ols_line_angle.csv": ("minute", [("ols_distance", "roll_A", ("y_metric", "distance_m"))]),
    "03_self_nearest_distance_lead.csv": ("minute", [("tm_cum", "C", ("reference", "teammates")), ("op_cum", "C", ("reference", "opponents"))]),
    "04_speed_roll10_phi.csv": ("minute", [("speed_phi", "phi_roll10", None)]),
    "05_pass_shot_quality_w5.csv": ("t_min", [("pass_C", "C", None)]),
    "06_standing_position.csv": ("minute", [("standing", "worst_vulnerability_5min_norm", None)]),
}


def series_value(series: str, raw: Column) -> Column:
    """The 0-1 form of a stored column."""
    if series == "ols_distance":
        return S.angle_unit(raw)
    if series in ("tm_cum", "op_cum"):
        return S.clip_unit(raw, S.LEAD_HALF_RANGE_M)
    return S.benefit(raw) if series == "standing" else raw


def case_of(path: Column) -> Column:
    """Folder of the case: the last folder above ``source/``, or the one holding the file.

    Evaluated for every row, so without a pattern that would be tried at every place of the path.
    """

    def part(k: int) -> Column:
        return F.substring_index(F.substring_index(path, "/", -k), "/", 1)

    inside, below = part(1).like("part-_%"), part(4)  # a part file in a folder that counts as one file
    folder = F.when(inside & (part(3) == "source") & (below != ""), below)
    folder = folder.when((inside | (part(2) == "source")) & (part(3) != ""), part(3)).otherwise(part(2))
    return F.when(folder.contains("%"), F.try_url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(folder)


def long_curve(rows: DataFrame, file: str) -> DataFrame:
    """One file's rows (text or typed columns plus ``case``) as ``(case, period, minute, series, value)``.

    ``source_row``, the order of the rows in their file, is kept where ``rows`` has it.
    """
    minute_col, parts = FILES[file]
    minute = S.num(F.col(minute_col))
    period = S.num(F.col("period")).cast("int") if "period" in rows.columns else S.infer_period(minute)
    order = [c for c in ("source_row",) if c in rows.columns]
    out = None
    for series, col, only in parts:
        if col not in rows.columns or (only and only[0] not in rows.columns):
            continue  # a missing column means the series is absent
        d = rows if only is None else rows.where(F.col(only[0]) == only[1])
        d = d.select("case", period.alias("period"), minute.alias("minute"), F.lit(series).alias("series"), series_value(series, S.num(F.col(col))).alias("value"), *order)
        d = d.dropna(subset=["period", "minute", "value"])
        out = d if out is None else out.unionByName(d)
    return out


def file_of(path: Column) -> Column:
    """Name of the curve file; a folder of that name with part files, as Spark writes it, counts as one file."""
    return F.regexp_extract(path, r"([^/]+\.csv)(?:/part-[^/]+)?$", 1)


def headers(spark: SparkSession, root: str) -> DataFrame:
    """Path, file name and first line of every CSV file under ``root``; null for a first line without a minute column.

    Lines that cannot name such a column count as null, so a file has few different ones and the lines are counted down
    by hash, not sorted. The file's name is taken from its one row; a filter on it here would be pushed down to all lines.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    bare = F.replace("value", F.lit('"'), F.lit(""))
    named = reduce(Column.__or__, [bare.contains(c) for c in sorted({minute for minute, _ in FILES.values()})])
    lines = lines.where(F.col("at") == 0).select("path", F.when(named, F.col("value")).alias("value"), F.monotonically_increasing_id().alias("row"))
    firsts = lines.groupBy("path", "value").agg(F.min("row").alias("row")).groupBy("path").agg(F.min_by("value", "row").alias("header"))
    return firsts.select("path", file_of(F.col("path")).alias("file"), "header")


def _columns(header: str) -> list[str]:
    """Column names of a header line; of equal names the first keeps its name."""
    names: list[str] = []
    for n in next(csv.reader([header.lstrip("\ufeff").rstrip("\r")]), []):
        k = 0
        while (n if not k else f"{n}.{k}") in names:
            k += 1
        names.append(n if not k else f"{n}.{k}")
    return names


def read_curves(spark: SparkSession, root: str) -> DataFrame:
    """All cases' curve files under ``root/<case>/source/``; files may be missing per case or altogether.

    Files are grouped by their header and every group is read by it, so columns are found by name wherever a file
    has them. ``source_row`` orders the rows of a file.
    """
    layouts: dict[tuple[str, str], list[str]] = {}
    for r in headers(spark, root).collect():  # one row per file, as in Spark's own listing
        if r.file in FILES and r.header is not None:
            layouts.setdefault((r.file, r.header), []).append(unquote(r.path))
    out = None
    for (file, header), paths in sorted(layouts.items()):
        names = _columns(header)
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        d = spark.read.schema(schema).option("header", True).csv(sorted(paths))
        d = d.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names if n.lower() not in ("case", "source_row")], case_of(F.col("_metadata.file_path")).alias("case"),
                     F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
        d = d.withColumn("source_row", F.format_string("%s %020d %020d", "_file", "_at", F.monotonically_increasing_id())).drop("_file", "_at")
        d = long_curve(d, file) if FILES[file][0] in names else None
        out = d if out is None else (out if d is None else out.unionByName(d))
    if out is None:
        raise FileNotFoundError(f"no curve files under {root}")
    return out


def missing_series(curves: DataFrame, case: Sequence[str] = ("case",), expected: Sequence[str] = tuple(SERIES_WEIGHTS)) -> DataFrame:
    """Expected series a case does not have."""
    all_of = curves.select(*case).distinct().withColumn("series", F.explode(F.array(*[F.lit(s) for s in expected])))
    return all_of.join(curves.select(*case, "series").distinct(), [*case, "series"], "left_anti")


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("match_id",), fmt: str = "parquet", rows_per_file: int = 5_000_000) -> None:
    """Write partitioned by match (or case).

    Rows are rebalanced by the partition keys: adaptive execution sizes the writers, several for a key with much data,
    one for many small keys. No file holds more than ``rows_per_file`` rows.
    """
    w = df.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by)
    (w.option("header", True).csv if fmt == "csv" else w.parquet)(path)
