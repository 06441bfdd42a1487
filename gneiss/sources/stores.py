"""Stored tables of a project: results, baselines, suppressions and history, as Parquet.

`save` and `load` are plain tables. A `Store` holds several tables in versions: a version is written beside the others, and
then a small file that names the current one is replaced in one step. A failed write changes nothing, readers see one version
or the other, and a frame that reads the store can be saved into it.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored table, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share (spark.checkpoint.dir). Where that is unset a fresh one of this machine is set, if the
    session runs on this machine alone; elsewhere that would lose what is written."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines reach")
        folder = f"file://{tempfile.mkdtemp(prefix='gneiss-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder that executors share and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Tables in versions under a folder that all machines reach. schemas: DDL by table name."""

    CURRENT = "current.json"

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._context = self._hadoop.FileContext.getFileContext(self._hadoop.Path(self.path).toUri(), spark._jsc.hadoopConfiguration())
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def version(self) -> str | None:
        """The current version; none without one, and where what names it can't be read or names none that is there."""
        try:
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/{self.CURRENT}").collect())
            name = json.loads(text)["version"]
        except (PySparkException, Py4JJavaError, ValueError, KeyError, TypeError):
            return None
        good = isinstance(name, str) and re.fullmatch(r"v-[0-9a-f]+", name) and all(self._fs.exists(self._at(name, t, "_SUCCESS")) for t in self.schemas)
        return name if good else None

    def load(self, table: str) -> DataFrame:
        """The table in the current version; empty without one, or where any table's files are broken or of other columns: a
        version holds what belongs together."""
        version = self.version()
        found = {t: self._read(version, t) for t in self.schemas} if version else {}
        return found[table] if found and None not in found.values() else self.spark.createDataFrame([], self.schemas[table])

    def _read(self, version: str, table: str) -> DataFrame | None:
        wanted = self.spark.createDataFrame([], self.schemas[table]).schema
        try:
            found = self.spark.read.parquet(f"{self.path}/{version}/{table}")
        except (PySparkException, Py4JJavaError):
            return None
        same = {(f.name, f.dataType) for f in found.schema} == {(f.name, f.dataType) for f in wanted}
        return found.select(*wanted.names) if same else None

    def save(self, tables: dict[str, DataFrame], keep: int = 2) -> str:
        """Writes all tables as a new version and makes it the current one; of older versions, the last `keep` - 1 stay for
        readers that are under way."""
        if set(tables) != set(self.schemas):
            raise ValueError(f"a version holds {sorted(self.schemas)}")
        before = self.version()
        name = f"v-{uuid.uuid4().hex}"
        for table, df in tables.items():
            columns = self.spark.createDataFrame([], self.schemas[table]).schema
            df.select(*(F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in columns)).write.parquet(f"{self.path}/{name}/{table}")
        history = [name, *([before, *self._history()] if before else [])]
        kept = list(dict.fromkeys(history))[: max(1, keep)]
        self._replace(json.dumps({"version": name, "history": kept}))
        for status in self._fs.listStatus(self._at()):
            old = status.getPath().getName()
            if old.startswith("v-") and old not in kept:
                self._fs.delete(self._at(old), True)
        return name

    def _history(self) -> list[str]:
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/{self.CURRENT}").collect())
        found = json.loads(text).get("history")
        return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []

    def _replace(self, text: str) -> None:
        """Renames a finished file over the one that names the version."""
        fresh = self._at(f"next-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        over[0] = self._hadoop.Options.Rename.OVERWRITE
        self._context.rename(fresh, self._at(self.CURRENT), over)
