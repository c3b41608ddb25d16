"""Tables on the way to a result, kept in the folder that the cluster names in spark.checkpoint.dir, which the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a local session without one gets a temporary folder, a cluster without one is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
        root = _local[context.applicationId]
    return root.rstrip("/")


class Scratch:
    """A folder of stored tables, removed at the end of a ``with`` block: each cuts the lineage of what is built on it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_root(spark)}/scratch-{uuid.uuid4().hex}", 0

    def saved(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()
