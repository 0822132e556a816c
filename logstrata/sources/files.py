"""Files of any file system that Spark knows, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self._conf)

    def local(self, path: str) -> str | None:
        """The plain path, if it lies in a mounted file system that this process can open."""
        at, fs = self._path(path)
        return at.toUri().getPath() if fs.getUri().getScheme() == "file" else None

    def exists(self, path: str) -> bool:
        at, fs = self._path(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        """Names of the files of a folder that readers do not pass over; none if it does not exist."""
        at, fs = self._path(path)
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in found if n[0] not in "._")

    def make(self, path: str) -> None:
        at, fs = self._path(path)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        at, fs = self._path(path)
        fs.delete(at, True)

    def read(self, path: str) -> str:
        at, fs = self._path(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes beside the file and then takes its place in one step, so readers find the old or the new."""
        at, fs = self._path(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self._jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        array[0] = overwrite
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), self._conf).rename(beside, at, array)
