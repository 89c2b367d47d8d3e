"""Files of a collection through Hadoop's file system, so that any shared store works."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """Small-file operations below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def mkdirs(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def remove(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write_new(self, name: str, value: dict) -> bool:
        """Create a file with ``value``; False where the name is taken. Written aside first, so none is seen half."""
        if self.exists(name):
            return False
        aside = f"{name}.{id(value)}.tmp"
        stream = self.fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if self.exists(name) or not self.fs.rename(self._path(aside), self._path(name)):
            self.fs.delete(self._path(aside), False)
            return False
        return True
