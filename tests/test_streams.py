"""Streams: watched files with bursts, and logs that grow, both over a restart."""

import os
import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gneiss.streaming import streams
from gneiss.streaming.tail import LogTail, TailReader, last_break

KEYS = "file string, version bigint, keys array<struct<key:string,severity:string>>"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_watch_with_bursts_and_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(source)
    come, wait = [], 5000

    def put(at, *versions):
        come.extend((*v, at) for v in versions)
        spark.createDataFrame(list(versions), KEYS).coalesce(1).write.mode("append").parquet(source)

    def run(total):
        """Timers keep batches coming, so the stream is watched until its rows are there."""
        q = streams.watch_stream(spark.readStream.schema(KEYS).option("maxFilesPerTrigger", 1).parquet(source), "high", wait).writeStream.format("parquet").outputMode("append").trigger(processingTime="500 milliseconds").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            deadline = time.time() + 40
            while q.isActive and time.time() < deadline and found() < total:
                time.sleep(0.5)
        finally:
            q.stop()

    def found():
        try:
            return spark.read.parquet(out).count()
        except AnalysisException:
            return 0

    # a burst of three versions of f, of which the last counts; g alone
    put(0.0, ("f", 1, [("a", "high"), ("b", "low")]), ("f", 2, [("c", "high")]), ("g", 1, [("x", "critical")]))
    put(1.0, ("f", 3, [("a", "high"), ("d", "low"), ("e", "critical")]))  # in a batch of its own, within the wait
    run(3)
    assert rows(spark.read.parquet(out), "file", "version", "key", "change") == [("f", 3, "a", "new"), ("f", 3, "e", "new"), ("g", 1, "x", "new")]
    # after a restart: f is deleted, g loses nothing and gains one
    put(100.0, ("f", 4, None), ("g", 2, [("x", "critical"), ("y", "high")]))
    run(7)
    got = rows(spark.read.parquet(out), "file", "version", "key", "change")
    assert got[2:5] == [("f", 4, "a", "resolved"), ("f", 4, "d", "resolved"), ("f", 4, "e", "resolved")] and got[-1] == ("g", 2, "y", "new") and len(got) == 7
    flat = spark.createDataFrame([(f, v, k, t) for f, v, k, t in come], KEYS + ", t double").select("file", "version", F.timestamp_seconds("t").alias("at"), F.explode_outer("keys").alias("k")).select("file", "version", "at", "k.key", "k.severity")
    assert rows(streams.watch_changes(streams.last_versions(flat, wait), "high"), "file", "version", "key", "change") == got


def test_tail_offsets(tmp_path):
    log = tmp_path / "a.log"
    reader = TailReader({"paths": str(tmp_path / "*.log"), "splitbytes": "5"})

    def between(start, end):
        return [(at, line) for p in reader.partitions(start, end) for _, at, line in reader.read(p)]

    log.write_bytes(b"one\ntwo two two\r\n\nhalf")
    first = reader.latestOffset()
    assert between({}, first) == [(0, "one"), (4, "two two two"), (17, "")]
    with log.open("ab") as f:
        f.write(b" done\nlast\xff\n")
    second = reader.latestOffset()
    assert between(first, second) == [(18, "half done"), (28, "last�")]
    assert between(second, second) == []
    log.write_bytes(b"new\n")  # shorter: from the start
    third = reader.latestOffset()
    assert between(second, third) == [(0, "new")]
    (tmp_path / "b.log").write_bytes(b"other file of the name\n")
    os.replace(tmp_path / "b.log", log)
    assert between(third, reader.latestOffset()) == [(0, "other file of the name")]
    log.unlink()
    assert reader.latestOffset() == {} and between(third, {}) == []
    long = tmp_path / "c.log"
    long.write_bytes(b"x" * 200_000)
    assert last_break(str(long), 200_000) == 0
    assert LogTail.name() == "log_tail"


def test_tail_stream_over_a_restart(spark, tmp_path):
    log, out = tmp_path / "app.log", str(tmp_path / "out")
    alert = "stack trace: at run (app.js:10:2)"

    def run(*steps):
        q = streams.tail_stream(spark, str(tmp_path / "*.log"), split=64).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        for text in steps:
            with log.open("a") as f:
                f.write(text)
            q.processAllAvailable()
        q.stop()
        return spark.read.parquet(out).count()

    one = run("fine\n" * 50 + alert + "\n")
    assert one == 1
    assert run("fine\n" + alert[:10], alert[10:] + "\nfine\n") == 2  # half a line, then the rest
    log.write_text("")
    assert run(alert + "\n") == 3
