"""Files in Spark's own stores, from the driver: whatever path Spark can read, this can."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import SparkSession


class SharedFolder:
    """A folder reached through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        made = self._path(path)
        self._fs = made.getFileSystem(self._conf)
        self.path = self._fs.makeQualified(made).toString().rstrip("/")
        self._fs.mkdirs(made)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def under(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def files(self, name: str = "") -> dict[str, int]:
        """Names and sizes of the files directly below."""
        at = self._path(self.under(name))
        if not self._fs.exists(at):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(at) if s.isFile()}

    def ages(self, name: str = "") -> dict[str, float]:
        """Names of the files directly below and the seconds since each was changed last."""
        at, now = self._path(self.under(name)), self._jvm.java.lang.System.currentTimeMillis()
        return {s.getPath().getName(): (now - s.getModificationTime()) / 1000 for s in self._fs.listStatus(at) if s.isFile()}

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.under(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Writes a file in full beside its place, then renames it there; False if the place is taken.

        The rename does not overwrite, so of two writers one wins and readers see whole files only.
        """
        beside = self.under(f".{name}.{self._jvm.java.util.UUID.randomUUID()}")
        stream = self._fs.create(self._path(beside), False)
        try:
            self._jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self._conf)
        try:
            context.rename(self._path(beside), self._path(self.under(name)), options)
            return True
        except Exception:
            self.delete(beside.rpartition("/")[2])
            if name in self.files():
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.under(name)), True)

    def move(self, source: str, name: str) -> None:
        if not self._fs.rename(self._path(self.under(source)), self._path(self.under(name))):
            raise OSError(f"{source} could not be moved to {name}")
