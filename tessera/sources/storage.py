"""Small files on whatever file system a path names, through Hadoop's API: what a driver writes beside Spark's tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """A folder on a local disk, HDFS or an object store; names are relative to it."""

    def __init__(self, root: str, spark: SparkSession | None = None):
        spark = spark or SparkSession.active()
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What a folder holds, sorted; nothing if it is not there."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file; one of that name is an error."""
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """Moves a file over another one in one step."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else self._fs.getUri(), self._conf)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        how[0] = options.OVERWRITE
        context.rename(self._path(source), self._path(target), how)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
