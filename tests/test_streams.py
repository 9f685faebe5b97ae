from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.sources.schemas import TABLES
from tideline.streaming import signals

T = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)


def drained(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def arriving(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_deliveries_once(spark, tmp_path):
    row = lambda i, d: (i, "r", "g", "n", d, None, False, T(0))
    stream = arriving(spark, tmp_path, [[row("1", "d"), row("2", None)], [row("3", "d"), row("4", None), row("5", "e")]], TABLES["signals"])
    got = drained(signals.deliveries_once(stream), tmp_path, "once")
    assert sorted(r["id"] for r in got if r["delivery_id"] is None) == ["2", "4"] and sorted(r["delivery_id"] for r in got if r["delivery_id"]) == ["d", "e"]


def test_signal_or_timeout(spark, tmp_path):
    schema = "run_id string, name string, kind string, at timestamp, timeout_at timestamp"
    batches = [[("early", "n", "signal", T(0), None), ("late", "n", "await", T(0), T(5))], [("early", "n", "await", T(1), T(2)), ("open", "n", "await", T(1), None)], [("clock", "n", "signal", T(60), None)], [("clock", "n", "signal", T(61), None)]]
    stream = arriving(spark, tmp_path, batches, schema).withWatermark("at", "1 minute")
    got = drained(signals.signal_or_timeout(stream), tmp_path, "race")
    assert sorted((r["run_id"], r["winner"]) for r in got) == [("early", "signal"), ("late", "timeout")]


def test_near_timers_and_epochs(spark):
    timers = spark.createDataFrame([("a", "r", T(0), False), ("b", "r", T(1), False), ("c", "r", T(9), False), ("d", "r", T(0), True)], TABLES["timers"])
    assert sorted((r["id"], r["wait_ms"]) for r in signals.due_timers(timers, "2024-01-01 00:00:30").collect()) == [("a", 0), ("b", 30_000)]
    beats = spark.createDataFrame([("r", "o", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 20)] + [("r", "o", T(3))], "run_id string, owner string, at timestamp")
    assert sorted(r["beats"] for r in signals.lease_epochs(beats).collect()) == [1, 3]


def test_counters(spark, tmp_path):
    stream = arriving(spark, tmp_path, [[("r", 0, "patched", "p", None, T(0))], [("r", 1, "patched", "p", None, T(0))]], TABLES["events"])
    got = drained(signals.event_counters(stream), tmp_path, "counters", "complete")
    assert [(r["events"], r["through_seq"]) for r in got] == [(2, 1)]
