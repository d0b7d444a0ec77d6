"""Tables between the steps of iterative work, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []

#: How blocks are written as Parquet: a row may be megabytes, so sizes are looked at after each and not after a hundred, and
#: numbers of this kind gain nothing from a dictionary or compression.
BLOCK_OPTIONS = {
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false", "compression": "none",
}


def shared_folder(spark: SparkSession) -> str:
    """As the cluster names it in ``spark.checkpoint.dir``. Only on one machine may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster names its shared folder in spark.checkpoint.dir")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="shared-"))
    return _own_folder[0]


class Steps:
    """Tables written on the way: each cuts the lineage, so that a lost executor costs a reread. ``drop`` deletes those but
    the ones to stay; nothing read later may need them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.written = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.written)}"
        self.written.append(path)
        df.write.options(**BLOCK_OPTIONS).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, stay: list[int] | None = None) -> None:
        for k, path in enumerate(self.written):
            if k not in (stay or []):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    @property
    def last(self) -> int:
        return len(self.written) - 1
