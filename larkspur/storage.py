"""Folders that driver and executors share, and manifests that one writer at a time may advance."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one is made only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read back, so that what uses them more than once makes them once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Manifest:
    """Numbered states of a table or a feed in a folder: state n + 1 can be written once, so of two writers that know state n only one goes on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(self.conf)

    def _path(self, number: int):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-{number:012d}.json")

    def current(self) -> tuple[int, dict]:
        """Number and content of the newest state; (0, {}) if there is none."""
        home = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        if not self.fs.exists(home):
            return 0, {}
        numbers = [int(n[6:18]) for n in (f.getPath().getName() for f in self.fs.listStatus(home)) if n.startswith("state-") and n.endswith(".json")]
        if not numbers:
            return 0, {}
        stream = self.fs.open(self._path(max(numbers)))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def advance(self, expected: int, state: dict) -> bool:
        """Write state expected + 1; False, and nothing happens, if it is there already or another one is current."""
        if self.current()[0] != expected:
            return False
        try:
            stream = self.fs.create(self._path(expected + 1), False)
        except Exception:  # the other writer was first
            return False
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        return True
