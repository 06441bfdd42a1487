"""Streams: log lines that alert, and files that are watched."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from gneiss.functions.scalars import rank_of, severity_rank
from gneiss.operators.textscan import monitor
from gneiss.streaming.tail import LogTail


def monitor_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of the text files that arrive in a folder: stateless, so no watermark is needed."""
    lines = spark.readStream.format("text").load(folder).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))
    return monitor(lines)


def watch_changes(versions: DataFrame, threshold: str = "info") -> DataFrame:
    """Batch twin of watch_stream. versions(file, version, key, severity; key null for none): keys new in a version, at
    the threshold or above, and keys that it resolves. A version without keys, as after a deletion, resolves all."""
    numbered = versions.select("file", "version").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("version")))
    keys = versions.where("key is not null").join(numbered, ["file", "version"]).select("file", "nth", "key", "severity").distinct()
    before = keys.select("file", (F.col("nth") + 1).alias("nth"), "key")
    new = keys.join(before, ["file", "nth", "key"], "left_anti").where(severity_rank("severity") <= rank_of(threshold)).select("file", "nth", "key", F.lit("new").alias("change"))
    gone = before.join(numbered, ["file", "nth"], "left_semi").join(keys, ["file", "nth", "key"], "left_anti").select("file", "nth", "key", F.lit("resolved").alias("change"))
    out = new.unionByName(gone).join(numbered, ["file", "nth"])
    return out.select("file", "version", "key", "change")


def tail_stream(spark: SparkSession, paths: str, split: int | None = None) -> DataFrame:
    """Alerts of log files as they grow. paths: patterns of paths, one a line; see tail for what is read when."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("paths", paths)
    return monitor((reader.option("splitBytes", split) if split else reader).load())


def last_versions(versions: DataFrame, wait: int) -> DataFrame:
    """Versions that no other of their file follows within `wait` milliseconds of `at`: what is left of a burst."""
    later = F.lead("at").over(Window.partitionBy("file").orderBy("version"))
    kept = versions.select("file", "version", "at").distinct().withColumn("later", later)
    quiet = F.col("later").isNull() | (F.unix_millis("later") - F.unix_millis("at") >= wait)
    return versions.join(kept.where(quiet).select("file", "version"), ["file", "version"], "left_semi")


class Watch(StatefulProcessor):
    """The last keys of each file as a map, and the version that waits for its burst to end."""

    def __init__(self, threshold: str, wait: int):
        self.limit, self.wait = rank_of(threshold), wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "key string", "severity string")
        self.pending = handle.getValueState("pending", "version bigint, keys array<string>, severities array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        come = sorted((int(v), [(k["key"], k["severity"]) for k in (keys if keys is not None else [])]) for batch in rows for v, keys in zip(batch["version"], batch["keys"], strict=True))
        if not self.wait:
            for version, keys in come:
                yield from self._settled(key, version, dict(keys))
            return
        version, keys = come[-1]
        if self.pending.exists() and self.pending.get()[0] > version:  # late: a newer one waits already
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.pending.update((version, [k for k, _ in keys], [s for _, s in keys]))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, keys, severities = self.pending.get()
        self.pending.clear()
        yield from self._settled(key, version, dict(zip(keys, severities, strict=True)))

    def _settled(self, key: tuple, version: int, now: dict[str, str]) -> Iterator[pd.DataFrame]:
        known = {k[0] for k in self.known.keys()}
        new = [k for k in sorted(now) if k not in known and rank_of(now[k]) <= self.limit]
        gone = sorted(known - set(now))
        for k in gone:
            self.known.removeKey((k,))
        for k in now:
            if k not in known:
                self.known.updateValue((k,), (now[k],))
        if new or gone:
            yield pd.DataFrame([(key[0], version, k, "new") for k in new] + [(key[0], version, k, "resolved") for k in gone], columns=["file", "version", "key", "change"])

    def close(self) -> None:
        pass


def watch_stream(versions: DataFrame, threshold: str = "info", wait: int = 0) -> DataFrame:
    """versions(file, version, keys array<struct<key, severity>>) as a stream: keys new in a file, and resolved ones. A version
    counts once no other has come for `wait` milliseconds, by a timer; 0 takes each at once, in order. A version without keys
    resolves all. State lives in RocksDB, so a file's keys are a map of entries and not one value."""
    versions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return versions.groupBy("file").transformWithStateInPandas(Watch(threshold, wait), "file string, version bigint, key string, change string", "Append", "ProcessingTime" if wait else "None")
