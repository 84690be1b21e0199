"""Shared storage for intermediate tables.

Executors may be lost at any time, so lineage is cut only through files that
every executor can read: the folder named by ``spark.checkpoint.dir``. A folder
of this machine is used only where the session names none and runs on this
machine alone, as in tests; on a cluster an unnamed folder is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, set on first use where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any file system that Spark reaches, for what is too small to be a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in the folder or one below it; none where there is no such folder."""
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Write a new file whole or not at all; a file of that name is an error."""
        part = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(part, self._at(name)):
            self._fs.delete(part, False)
            raise FileExistsError(f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
