"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType, StringType


def build_session(app: str = "keystride", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; `master`/`partitions` only for local runs."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        # one machine, little data: keep all cores busy on small shuffles
        b = b.master(master).config("spark.driver.memory", "12g")
        b = b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors see; a session on one machine (tests) without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back by columns; ``by`` cuts it into folders.

    Lineage ends there: a lost executor costs no more than its own tasks. Columns without a type become strings.
    """
    df = df.withColumns({f.name: df[f"`{f.name}`"].cast(StringType()) for f in df.schema if isinstance(f.dataType, NullType)})
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage, so that a long chain of passes stays linear and survives lost executors."""
    return written(df)
