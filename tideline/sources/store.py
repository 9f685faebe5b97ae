"""Where tables live: in memory, or as Parquet below a folder, the event journal by month."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalars import month_label
from tideline.sources.schemas import TABLES


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where the session names none, a local
    session gets a temporary one; on a cluster that is an error, since no folder of one machine would do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tideline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialised(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as Parquet to the folder that driver and executors share and read back; and where it lies."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """df, written to the shared folder in buckets by a column, by which it is then joined and grouped without a
    shuffle. Its rows should be dealt by that column already: each task writes a file for every bucket it has rows of."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, by).option("path", f"{shared_base(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


@contextmanager
def small_splits(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Within it, tasks that scan files read no more than so many bytes each; less where the session says so."""
    name = "spark.sql.files.maxPartitionBytes"
    had = spark.conf.get(name)
    if most is not None and most < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(had):
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class TableStore(Protocol):
    def read(self, name: str) -> DataFrame: ...

    def append(self, name: str, rows: DataFrame) -> None: ...

    def replace(self, name: str, rows: DataFrame) -> None: ...


class MemoryStore:
    def __init__(self, spark: SparkSession):
        self.tables = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name]

    def append(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = self.tables[name].unionByName(rows, allowMissingColumns=True)

    def replace(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = rows


class ParquetStore:
    """Each replacement is a version of its own below the table's folder, so that a job can read the table
    that it replaces; the newest is the table. Only one writer may be at work."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        done = [s.getPath() for s in system.listStatus(path) if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v")) for p in done)

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name] + ", month string" * (name == "events")).parquet(f"{self.folder}/{name}/v{versions[-1]}")
        return rows

    def _write(self, name: str, rows: DataFrame, version: int, mode: str) -> None:
        rows = self.spark.createDataFrame([], TABLES[name]).unionByName(rows.drop("month"), allowMissingColumns=True)
        path = f"{self.folder}/{name}/v{version}"
        if name == "events":
            rows.withColumn("month", month_label("inserted_at")).repartition("month", F.xxhash64("run_id") % 16).sortWithinPartitions("run_id", "seq").write.mode(mode).partitionBy("month").parquet(path)
        else:
            rows.write.mode(mode).parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, (self._versions(name) or [0])[-1], "append")

    def replace(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, (self._versions(name) or [-1])[-1] + 1, "overwrite")

    def months(self) -> DataFrame:
        """The months that the journal has partitions of; reads no rows."""
        return self.read("events").select("month").distinct().orderBy("month")

    def drop_months(self, months: list[str]) -> None:
        """Remove these partitions' folders; the others are not touched. No query may be reading them."""
        versions = self._versions("events")
        for month in months if versions else ():
            delete(self.spark, f"{self.folder}/events/v{versions[-1]}/month={month}")


def ensure_months(events: DataFrame, have: DataFrame) -> DataFrame:
    """month, moved_rows: months of the journal that have no partition yet, with the rows that move there."""
    return events.groupBy(month_label("inserted_at").alias("month")).agg(F.count(F.lit(1)).alias("moved_rows")).join(have.select("month"), "month", "left_anti")


def dump_history(events: DataFrame, run_id: str, path: str) -> None:
    """One run's events as JSON lines."""
    events.where(F.col("run_id") == run_id).orderBy("seq").coalesce(1).write.mode("overwrite").json(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLES["events"]).json(path)
