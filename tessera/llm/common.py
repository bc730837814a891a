"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these; Java and Python read the class alike.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, in order; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for a local session one of our own.

    A cluster without the setting is refused, as a machine's own folder would not be seen by the others.
    """
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext.getCheckpointDir()
        at = current.rsplit("/", 1)[0] if current else None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: lineage is cut, a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator writes on its way, deleted together once its result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
        """The rows as a table bucketed by key: joins and groups on it move the other side only. Rows of a task go to one file per
        bucket, so df should be dealt by key already, or hold few keys a task."""
        path = fresh_path(self.spark, name)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        self.paths.append(path)
        self.tables.append(table)
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        """Deletes what was written; calling it twice does no harm."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths, self.tables = [], []
