"""Cutting lineage with written tables.

Iterative operators write what they carry from round to round to the shared folder named by
`spark.checkpoint.dir`. The tables outlive lost executors, and reading them back gives the
optimizer real sizes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


_local_folder: dict[str, str] = {}
#: What has been written since `only_result` was called, for each open call.
_open: list[list[Written]] = []


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    if context.applicationId not in _local_folder:
        _local_folder[context.applicationId] = tempfile.mkdtemp(prefix="waymark-")
    return _local_folder[context.applicationId]


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Written:
    """A DataFrame stored in the shared folder."""

    codec: str | None = None

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self._spark = spark
        self.path = new_path(spark)
        df.write.parquet(self.path, compression=self.codec)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        for made in _open:
            made.append(self)

    def drop(self) -> None:
        """Delete the files; only for tables no later plan reads."""
        delete(self._spark, self.path)


class Packed(Written):
    """In fewer bytes, for wide tables that stay while others are made."""

    codec = "zstd"


def cut_lineage(df: DataFrame) -> DataFrame:
    return Written(df).df


def packed(df: DataFrame) -> DataFrame:
    return Packed(df).df


def only_result(build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` returns, stored. The tables that it stored on the way are deleted, so nothing may read them later."""
    _open.append([])
    try:
        out = Packed(build())
    finally:
        made = _open.pop()
    for table in made:
        if table is not out:
            table.drop()
    return out.df
