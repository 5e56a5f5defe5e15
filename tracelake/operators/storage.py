"""Tables in the folder that driver and executors share: they end a lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df to the folder that all executors share and read it back, which ends its lineage. by: columns with few values
    that become folders, so that a filter on them reads only its own; their files are written side by side, without a sort.
    What was shuffled for the table is given up once it is written."""
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    put = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.maxConcurrentOutputFileWriters": "8"} if by else {})
    was = {key: conf.get(key) for key in put}
    try:
        for key, value in put.items():
            conf.set(key, value)
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        for key, value in was.items():
            conf.set(key, value)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return rows.select(*df.columns) if by else rows
