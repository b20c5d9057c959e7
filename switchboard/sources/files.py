"""Small files of a shared folder, through the file system that Spark reads it with."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder in any store Spark knows; only names and small texts pass through it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(root).toUri(), conf)

    def at(self, name: str):
        return self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path))

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder below, none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Makes a whole file appear at once; false if there is one of that name."""
        draft = f"_draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name):
            self.delete(draft)
            return False
        self.fs.mkdirs(self.at(name).getParent())
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, none)
        try:
            self.context.rename(self.at(draft), self.at(name), options)
        except Exception:
            if not self.exists(name):
                raise
            self.delete(draft)  # another writer was faster
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def move(self, source: str, target: str) -> bool:
        """Moves a file of the same store, given whole paths; false if it isn't there."""
        path = self.jvm.org.apache.hadoop.fs.Path
        if not self.fs.exists(path(source)):
            return False
        self.fs.mkdirs(path(target).getParent())
        return self.fs.rename(path(source), path(target))
