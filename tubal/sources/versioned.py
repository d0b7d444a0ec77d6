"""Tables in versions: a new one is written beside the old and takes effect by one rename.

A table's folder holds data folders and ``_versions``, in which file ``n`` names the data folder of version n. A file there is put in place whole, by a rename that
fails where there is one of that number: so readers see one version or the next, a writer that dies at any point leaves the last version as it is, and of
two writers that started from one version the second fails with ``Conflict`` and may begin again. That is as safe as the file system's rename is atomic."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tubal.sources.sinks import upserted


class Conflict(Exception):
    """Another writer was first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _where(self, *parts: str):
        return self._fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._where().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._where("_versions")
        if not self._files().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files().listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The last version; 0 where there is none yet."""
        return max(self.versions(), default=0)

    def _folder(self, version: int) -> str:
        stream = self._files().open(self._where("_versions", str(version)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """That version, or the last; an empty table where there is none."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._folder(version)}")

    def _write(self, df: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _publish(self, name: str, version: int) -> None:
        beside = self._where("_versions", f"new-{uuid.uuid4().hex}")
        stream = self._files().create(beside, False)
        stream.write(bytearray(name.encode()))
        stream.close()
        self._rename(beside, self._where("_versions", str(version)))

    def _rename(self, source, target) -> None:
        context = self._fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(source, target, none)
        except Py4JJavaError as e:
            self._files().delete(source, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{target} is there already") from None
            raise

    def commit(self, df: DataFrame, read_version: int) -> int:
        """``df`` as the version after ``read_version``, the one that it was made from."""
        columns = self.read(0).columns if not read_version else self.read(read_version).columns
        self._publish(self._write(df.select(*columns)), read_version + 1)
        return read_version + 1

    def upsert(self, new: DataFrame, keys: list[str], tries: int = 1) -> int:
        """Rows of ``new`` take the place of those with their keys; with more ``tries`` from the then last version where another writer was first."""
        for left in range(tries - 1, -1, -1):
            at = self.version()
            try:
                return self.commit(upserted(self.read(at), new.select(*self.read(0).columns), keys), at)
            except Conflict:
                if not left:
                    raise
        raise ValueError("one try at least")

    def drop_old(self, keep: int = 2) -> None:
        """Versions but the last ``keep`` go, and data folders that no version names: those of writers that died. No writer may be at work."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - max(1, keep))]:
            self._files().delete(self._where("_versions", str(v)), False)
        named = {self._folder(v) for v in self.versions()}
        for status in self._files().listStatus(self._where()):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in named:
                self._files().delete(status.getPath(), True)
