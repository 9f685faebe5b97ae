"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.store import shared_base

SPACE = r"[\x20\x09-\x0D]+"
#: A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is not a letter or digit becomes a space, so that split() gives
#: the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir)."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialised(df: DataFrame, name: str, into: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage is cut, and lost executors cost
    no more than the stage that ran."""
    path = into or shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in the shared folder. Those that nothing reads any more can go before the job ends, and
    with them the shuffle files behind them, which Spark keeps until the driver collects its garbage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as the table of this name; what had the name before goes once the new table is written."""
        old, self.paths[name] = self.paths.get(name), shared_dir(self.spark, name)
        out = materialised(df, name, self.paths[name])
        if old:
            delete(self.spark, old)
        self.spark._jvm.System.gc()
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.paths.pop(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def normalised(column: Column) -> Column:
    """The text with every run of ASCII white space replaced by one space."""
    return F.regexp_replace(column, SPACE, " ")


def carried_columns(docs: DataFrame, keep: list[str], text_column: str, own: Collection[str] = ()) -> tuple[DataFrame, list[str], str]:
    """The columns to keep as c0, c1 and so on, and the text, which goes to Python once: it is one of them, or
    comes last as _text; the kept columns' names, with _given where an own result has the same; the text's name."""
    columns = [docs[c].alias(f"c{k}") for k, c in enumerate(keep)]
    text = f"c{keep.index(text_column)}" if text_column in keep else "_text"
    if text == "_text":
        columns.append(docs[text_column].alias(text))
    return docs.select(*columns), [f"{c}_given" if c in own else c for c in keep], text
