"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; a local one if that is unset and all of Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Parquet tables of one run. Written tables cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str = "step") -> str:
        """A folder of this run that nothing else uses."""
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, frame: DataFrame, name: str = "step") -> DataFrame:
        """The frame, written and read back: its size is known and it is not computed again."""
        path = self.path(name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables of this run that nothing needs any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            for file in frame.inputFiles()[:1]:
                path = jvm.org.apache.hadoop.fs.Path(file).getParent()
                path.getFileSystem(conf).delete(path, True)
