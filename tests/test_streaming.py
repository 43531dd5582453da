import datetime as dt

from pyspark.sql import functions as F

from colloquy.streaming import jobs
from tests.conftest import SF

T0 = dt.datetime(2024, 1, 1)


def test_due_jobs():
    times = {"digest": jobs.END_OF_DAY, "sweep": jobs.SWEEP}
    assert jobs.due_jobs(T0 + dt.timedelta(hours=20), T0 + dt.timedelta(hours=1), times) == ["digest", "sweep"]
    assert jobs.due_jobs(T0 + dt.timedelta(hours=18), T0 + dt.timedelta(hours=2), times) == ["digest"]
    assert jobs.due_jobs(T0, T0, times) == []


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_on_a_stream_are_those_of_the_table(spark, tmp_path):
    events(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = jobs.tumbling_counts(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.table("tumbling").collect()}
    assert got == {(r["window_start"], r["event_type"]): r["n"] for r in jobs.tumbling_counts(events(spark)).collect()}


def test_log_takes_each_key_once(spark, tmp_path):
    twice = events(spark).unionByName(events(spark))
    twice.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(twice.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.append_once(stream, ["event_id"], out, str(tmp_path / "cp"), "60 days").awaitTermination(120)
    assert spark.read.parquet(out).count() == events(spark).count()


def test_upserts_are_idempotent(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    for k in range(2):  # run again from the start: nothing changes
        jobs.keyed_upserts(stream, str(tmp_path / "out"), "event_type", str(tmp_path / f"cp{k}")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == events(spark).count()


def test_sessions_cover_all_events(spark):
    assert jobs.sessions(events(spark)).agg(F.sum("n")).first()[0] == events(spark).count()


def test_items_without_decision_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("a", "created", at(0)), ("b", "created", at(0)), ("b", "approved", at(5))], [("c", "created", at(100))], [("d", "created", at(120))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "extraction_id string, event_type string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("extraction_id string, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.expiry_stream(stream).writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k in range(len(batches)):
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{k}.parquet")
            q.processAllAvailable()
    finally:
        q.stop()
    assert [r["extraction_id"] for r in spark.table("expired").collect()] == ["a"]
