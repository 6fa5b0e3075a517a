"""Small files and folders in whatever file system a path names, by Hadoop's own client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder that all of a cluster sees."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def folders(self) -> list[str]:
        """Names of the folders inside, sorted."""
        if not self.exists(""):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.isDirectory())

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Puts the whole file in place at once."""
        part = self._at(f"{name}.part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name):
            self._fs.delete(self._at(name), False)
        self._fs.rename(part, self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
