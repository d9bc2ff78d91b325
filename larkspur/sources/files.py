"""Files of any Hadoop file system, through the session's own client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Small text files and folders; table data goes through Spark's readers and writers."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> bool:
        """Write a file whole; False if it was there already and may not be replaced."""
        fs, p = self._at(path)
        if not overwrite and fs.exists(p):
            return False
        part = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{self._jvm.java.util.UUID.randomUUID()}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if overwrite and fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(part, p):
            fs.delete(part, False)
            return False
        return True

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> tuple[int, int]:
        """(bytes, files) below a path."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return 0, 0
        summary = fs.getContentSummary(p)
        return summary.getLength(), summary.getFileCount()

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True) if fs.exists(p) else False

    def copy(self, source: str, destination: str) -> None:
        a, p = self._at(source)
        b, q = self._at(destination)
        b.mkdirs(q.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, self._conf)
