"""Numbered pointer files: the commit point of folders that many may read.

A state is one small JSON file ``p-<number>``; the highest number counts.  A
change writes its data first and then renames its pointer into place without
overwriting: of two writers that start from the same state one fails.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tidemark.session import hadoop_path


class Conflict(RuntimeError):
    """Another writer has moved the pointer since it was read."""


class Pointers:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self) -> list[str]:
        fs, path = hadoop_path(self.spark, self.folder)
        if not fs.exists(path):
            return []
        return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("p-"))

    def read(self) -> tuple[int, dict | None]:
        """(number, content) of the newest pointer; (0, None) if there is none."""
        names = self._names()
        if not names:
            return 0, None
        fs, path = hadoop_path(self.spark, f"{self.folder}/{names[-1]}")
        jvm = self.spark.sparkContext._jvm
        source = fs.open(path)
        try:
            return int(names[-1][2:]), json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def swap(self, number: int, content: dict) -> None:
        """Put pointer ``number`` in place; the one before must be the newest."""
        jvm = self.spark.sparkContext._jvm
        fs, path = hadoop_path(self.spark, f"{self.folder}/p-{number:020d}")
        held = self._names()
        if held and int(held[-1][2:]) != number - 1:
            raise Conflict(f"{self.folder}: {held[-1]} is newer than {number - 1}")
        temporary = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_tmp.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.hsync()
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temporary, path, options)
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if fs.exists(path):
                raise Conflict(f"{self.folder}: pointer {number} is taken") from e
            raise

    def tidy(self) -> None:
        """Delete all pointers but the newest."""
        for name in self._names()[:-1]:
            fs, path = hadoop_path(self.spark, f"{self.folder}/{name}")
            fs.delete(path, False)
