"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are bounded by rows and by bytes, so that a run of very long texts does
#: not meet in one batch.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.  Only a local
    session without the setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="quarrymill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Parquet tables in the shared folder: they cut lineage, survive lost executors and
    are read again column by column.  Results read them lazily, so they stay until the
    driver's JVM ends and deletes them (a killed driver leaves them behind)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/quarrymill/{name}-{uuid.uuid4().hex}"
        self.marked = False

    def _path(self, name: str = ""):
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(jsc.hadoopConfiguration()), path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        if not self.marked:
            files, root = self._path()
            files.deleteOnExit(root)
            self.marked = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        files, path = self._path(name)
        files.delete(path, True)


#: A key is hot beyond this many rows, or beyond a MOST_HOT-th of all rows if that is more, so
#: there are at most MOST_HOT hot keys.
HOT, MOST_HOT = 128, 10_000


def hot_bound(total: int) -> int:
    """Rows of a key beyond which it counts as hot; fewer than MOST_HOT keys are."""
    return max(HOT, total // MOST_HOT)


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """rows joined to table, which has a row for each key (keys without one fall away) and in n
    the key's number of rows; total: all rows.  Hot keys' rows stay where they are: their part of
    table is broadcast, fewer than MOST_HOT rows.  Only the other rows are shuffled."""
    bound = hot_bound(total)
    hot, cold = F.broadcast(table.where(F.col(n) > bound)), table.where(F.col(n) <= bound)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the fold crc32(doc_id as text) mod 4 = 2; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pick(share: F.Column, *cols: F.Column, seed: int = 7) -> F.Column:
    """A repeatable choice of the share of rows, by a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) < share * (1 << 30)
