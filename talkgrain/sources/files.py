"""Small named files in the folder that all executors share, through Hadoop's filesystems."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path: below spark.checkpoint.dir; on one machine without it, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/talkgrain-files/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file, such as a report or a transcript, from the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut, a lost executor loses nothing, and the size is measured.

    Loops use this and not checkpoint(), which carries estimated sizes along: each join multiplies them, until numbers of
    millions of digits are compared in planning.
    """
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
