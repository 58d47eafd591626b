"""A stream gives the rows of the batch; progress messages end with one result or error."""

from pyspark.sql import functions as F

from quillstone.streaming import events as E


def rows(spark):
    return spark.createDataFrame([(i, 1_700_000_000 + i * 700, i % 3, "ab"[i % 2], float(i), "{}") for i in range(60)], "event_id long, s long, user_id long, event_type string, value double, props string").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", "props")


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark).repartition(3).write.parquet(src)
    for name, f in (("w", lambda d: E.tumbling(d, late="10 days")), ("s", lambda d: E.sessions(d, late="10 days"))):
        q = f(E.event_stream(spark, src)).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(rows(spark)).collect()))


def test_delivery(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark).repartition(2).write.parquet(src)
    got = []
    E.deliver(E.event_stream(spark, src, files=1), lambda df, n: got.append((n, df.count())), str(tmp_path / "c")).awaitTermination()
    assert sum(n for _, n in got) == 60 and len({k for k, _ in got}) == len(got)


def test_progress(spark):
    steps = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", False), (2, 0, "a", False)], "qid int, hop int, tool string, confident boolean")
    got = E.progress(steps).orderBy("qid", "hop").collect()
    assert [(r["qid"], r["kind"]) for r in got] == [(1, "step"), (1, "step"), (1, "result"), (2, "step"), (2, "error")]
