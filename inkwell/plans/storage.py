"""Files of an index in any file system that Hadoop knows, for the driver's small reads and writes."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Storage:
    """A folder, by local path or URI. Names below it are relative, with `/` between their parts."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self._jvm, text = spark._jvm, str(root)
        path = self._path(text if "://" in text else Path(text).absolute().as_uri())
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = path.getFileSystem(self._conf)
        self.root: str = self._fs.makeQualified(path).toString()

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a small file beside its place and rename it there over what may be, which is atomic where the file system's rename is."""
        new = self._path(self.at(f"{name}.{os.getpid()}.new"))
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = SparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf).rename(new, self._path(self.at(name)), over)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)
