"""Session helpers of the text operators: the shared folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir. Where that is unset a fresh one of this machine is set, if
    the session runs on this machine alone; elsewhere executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines reach")
        found = tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        return f"file://{found}"
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of an executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: rows are whole documents here, and a batch lies in memory several times on its way.
BATCH_ROWS = 1500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless someone has set them to other than Spark's default."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and the named columns alone: columns of other names can't clash with an operator's own."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", *columns)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over edges(a, b), for each node of an edge.

    Minimum labels spread over the edges and then jump to their label's label, so a chain of length n takes about
    log n rounds. Each round is a staged table; the driver sees one count a round and no links.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        at = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = stage(low.join(at, "low").select("node", F.least("low", "next").alias("component"), "was"), f"{name}-{turn}")
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
