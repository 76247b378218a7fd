"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the context's checkpoint folder. Where neither is set a local[*] session (as in
    tests) gets a temporary one; on a cluster that is an error, as executors would write to folders of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to a Parquet table in the shared folder and read it back: lost executors lose none of it."""
    return _written(frame)[0]


def _written(frame: DataFrame) -> tuple[DataFrame, str]:
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/gridlake-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


class Workspace:
    """Durable tables of one call. Leaving the ``with`` block deletes those that ``keep`` wasn't called for."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Workspace:
        return self

    def durable(self, frame: DataFrame) -> DataFrame:
        table, path = _written(frame)
        self.paths[id(table)] = table, path
        return table

    def keep(self, table: DataFrame) -> DataFrame:
        """The table outlives the block: what the call returns reads it."""
        self.paths.pop(id(table), None)
        return table

    def drop(self, table: DataFrame) -> None:
        found = self.paths.pop(id(table), None)
        if found:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *_: object) -> None:
        for table, _path in list(self.paths.values()):
            self.drop(table)
