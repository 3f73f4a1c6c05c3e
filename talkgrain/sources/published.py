"""Tables that become visible whole, after checks; one writer at a time; stored rules read anew only when they changed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _filesystem(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored table; one that is not there yet is empty if its schema is given."""
    try:
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


def publish(df: DataFrame, path: str, problems: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes beside the path, checks what was written, and renames it; with any problem nothing appears at the path, which must be new."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    here, fs = _filesystem(spark, staged)
    there, _ = _filesystem(spark, path)
    if fs.exists(there):
        raise FileExistsError(path)
    try:
        df.write.parquet(staged)
        found = problems(spark.read.parquet(staged)).take(5)
        if found:
            raise ValueError(f"not published: {[r.asDict() for r in found]}")
        if not fs.rename(here, there):
            raise FileExistsError(path)
    finally:
        fs.delete(here, True)
    return spark.read.parquet(path)


@contextmanager
def only_writer(spark: SparkSession, path: str, patience: float = 0.0, pause: float = 0.2) -> Iterator[None]:
    """Holds a lock file while the block runs. With patience waits for so many seconds, without fails at once; a writer that died leaves its file, which somebody must remove."""
    where, fs = _filesystem(spark, path)
    end = time.monotonic() + patience
    while not fs.createNewFile(where):
        if time.monotonic() >= end:
            raise BlockingIOError(f"another writer holds {path}")
        time.sleep(pause)
    try:
        yield
    finally:
        fs.delete(where, False)


class RuleStore:
    """What was built from the active rules (rule_id, retired); built anew only when their set is another one."""

    def __init__(self, build: Callable[[DataFrame], Any]):
        self.build, self.version, self.built = build, None, None

    def current(self, rules: DataFrame) -> Any:
        active = rules.filter(~F.col("retired"))
        hashed = [F.xxhash64(F.lit(seed), "rule_id") for seed in (1, 2)]
        version = tuple(active.agg(F.count(F.lit(1)), *[F.bit_xor(h) for h in hashed]).first())
        if version != self.version:
            self.built, self.version = self.build(active), version
        return self.built
