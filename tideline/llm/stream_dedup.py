"""Exact deduplication as a stateful stream.

The stream reads the document files as they arrive and keeps, for each digest of a normalised text, the
smallest identifier seen, where its content lies (file and row), and how many rows had it. The state is
keyed, lies on disk (RocksDB) and never expires; partial aggregation before the shuffle keeps a digest that
many rows share from meeting in one task. A hit is a digest with more than one row: the full normalised
bytes of its rows are compared, and digests whose rows differ are told apart by those bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import materialised, normalised, shared_dir, text_of

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    #: Else every partition's store sets several MB of disk aside before it holds anything.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(df: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    """id, text (normalised), digest and place of each row. A null id comes after all others."""
    text = normalised(text_of(df[text_column]))
    place = F.struct(
        df[id_column].isNull().alias("none"),
        df[id_column].alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return df.select(df[id_column].alias("id"), text.alias("text"), digest(text).alias("digest"), place.alias("place"))


def stream_state(spark: SparkSession, source: str, id_column: str, text_column: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """The state after all files of the folder: digest, first (place), n. With the same checkpoint folder a
    later call goes on where the last one ended and reads new files only."""
    folder = checkpoint or shared_dir(spark, "dedup")
    options = {"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {"maxBytesPerTrigger": str(256 << 30)}
    where = spark._jvm.org.apache.hadoop.fs.Path(source)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        #: A file source watches a folder; here one name in it.
        source_folder, options["pathGlobFilter"] = where.getParent().toString(), where.getName()
    else:
        source_folder = source
    schema = spark.read.parquet(source).schema
    arriving = spark.readStream.schema(schema).options(**options).parquet(source_folder)
    state = (
        _rows(arriving, id_column, text_column, digest)
        .groupBy("digest")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/groups/part={number}")

    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(put)
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = schema[id_column].dataType.simpleString()
    kept = f"digest string, first struct<none:boolean,id:{kind},file:string,row:bigint>, n bigint, batch bigint"
    #: The newest row of a digest holds what its state held at the end.
    return (
        spark.read.schema(kept).parquet(f"{folder}/groups/*")
        .groupBy("digest")
        .agg(F.max_by(F.struct("first", "n"), "batch").alias("s"))
        .select("digest", "s.first", "s.n")
    ) if _any(spark, f"{folder}/groups") else spark.createDataFrame([], kept).drop("batch")


def _any(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def exact_dedup(spark: SparkSession, source: str, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, salts: int = 16) -> DataFrame:
    """One row per row of the Parquet folder: id, keep_id, group_size, kept, text_sha256, file, row.

    Texts are equal when they are the same bytes after each run of ASCII white space became one space; null
    counts as empty. The smallest id of equal texts stays (ties: the first file and row; a null id comes
    last), so exactly one row of each group has kept = true. Extra columns are ignored."""
    groups = materialised(stream_state(spark, source, id_column, text_column, digest, files_per_batch), "dedup-groups")
    rows = _rows(spark.read.parquet(source), id_column, text_column, digest)

    #: Full bytes of hits: within (digest, salt) first, so that no task gets a whole hot group.
    hits = groups.where("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("place.file", "place.row"), F.lit(salts)).cast("int"))
    spans = (
        salted.join(hits, ["digest", "salt"])
        .groupBy("digest", "salt")
        .agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .groupBy("digest")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    clashes = materialised(spans.where("low != high").select("digest"), "dedup-clashes")

    known = rows.join(groups, "digest").select("id", "text", "digest", "place", "first", "n")
    if not clashes.isEmpty():
        own = (
            rows.join(clashes, "digest").groupBy("digest", "text").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        )
        apart = rows.join(clashes, "digest").join(own, ["digest", "text"])
        known = known.join(clashes, "digest", "left_anti").unionByName(apart.select(*known.columns))
    return known.select(
        F.col("id").alias(id_column),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("place.file") == F.col("first.file")) & (F.col("place.row") == F.col("first.row"))).alias("kept"),
        (F.col("digest") if digest is sha256 else sha256(F.col("text"))).alias("text_sha256"),
        F.col("place.file").alias("file"),
        F.col("place.row").alias("row"),
    )



def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns. docs is written to the shared folder, from where it
    streams; a row is found again by its file and its place there."""
    spark = docs.sparkSession
    source = shared_dir(spark, "dedup-source")
    plain = [f"c{k}" for k in range(len(docs.columns))]
    docs.toDF(*plain).write.parquet(source)
    own = {c: plain[docs.columns.index(c)] for c in (id_column, text_column)}
    kept = exact_dedup(spark, source, own[id_column], own[text_column], **options).where("kept").select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    rows = spark.read.parquet(source).select(*plain, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(kept, ["_file", "_row"], "left_semi").select(*plain).toDF(*docs.columns)
