"""Tables that the registered queries share, in Spark and in SQL, and their registry.

The driver's tables hold prose and orders. Files are its texts; findings, scans, dependencies and graphs are derived
from orders and parts by arithmetic that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.sources.corpus import tables_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, as SQL gives them."""
    return df.select(*(F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(function(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


files = tables_corpus
FILES = """files AS (
  SELECT 'doc/' || doc_id AS path, text AS content FROM documents
  UNION ALL SELECT 'page/' || page_id || '.html', html FROM pages
  UNION ALL SELECT 'conv/' || conv_id || '/' || turn, text FROM conversations),
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)"""


def severity_of(quantity: str = "l_quantity"):
    q = F.col(quantity)
    return F.when(q >= 46, "critical").when(q >= 36, "high").when(q >= 21, "medium").when(q >= 6, "low").otherwise("info")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordinal = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("F"), ordinal.cast("string")).alias("id"),
        F.concat(F.lit("r"), (F.col("l_partkey") % 40).cast("string")).alias("rule"),
        F.concat(F.lit("title "), F.col("l_linenumber").cast("string")).alias("title"),
        severity_of().alias("severity"),
        F.concat("l_returnflag", "l_linestatus").alias("category"),
        F.concat(F.lit("f"), (F.col("l_orderkey") % 500).cast("string")).alias("file"),
        (F.col("l_suppkey") % 200 + 1).alias("line"),
        F.when(F.col("l_discount") >= 0.05, "high").otherwise("medium").alias("confidence"),
        (F.col("l_tax") >= 0.06).alias("ai_verified"),
        (F.col("l_tax") < 0.01).alias("false_positive"),
        F.trunc("l_shipdate", "month").cast("timestamp").alias("scan_id"),
        ordinal.alias("ordinal"),
    )


FINDINGS = """findings AS (SELECT 'F' || o AS id, 'r' || (l_partkey % 40) AS rule, 'title ' || l_linenumber AS title,
  CASE WHEN l_quantity >= 46 THEN 'critical' WHEN l_quantity >= 36 THEN 'high' WHEN l_quantity >= 21 THEN 'medium' WHEN l_quantity >= 6 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN l_quantity >= 46 THEN 0 WHEN l_quantity >= 36 THEN 1 WHEN l_quantity >= 21 THEN 2 WHEN l_quantity >= 6 THEN 3 ELSE 4 END AS rank,
  CASE WHEN l_quantity >= 46 THEN 20 WHEN l_quantity >= 36 THEN 10 WHEN l_quantity >= 21 THEN 5 WHEN l_quantity >= 6 THEN 2 ELSE 0 END AS cost,
  l_returnflag || l_linestatus AS category, 'f' || (l_orderkey % 500) AS file, l_suppkey % 200 + 1 AS line,
  CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'medium' END AS confidence, l_tax >= 0.06 AS ai_verified, l_tax < 0.01 AS false_positive,
  date_trunc('month', l_shipdate)::TIMESTAMP AS scan_id, o AS ordinal,
  'r' || (l_partkey % 40) || ':f' || (l_orderkey % 500) || ':' || ((l_suppkey % 200 + 1) // 5 * 5) AS fingerprint
  FROM (SELECT *, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS o FROM lineitem))"""

OLD = "scan_id < TIMESTAMP '1998-07-01'"


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings before and from the middle of 1998 on."""
    f = findings(spark, sf_dir)
    return f.where(OLD), f.where(f"NOT {OLD}")


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    eco = F.element_at(F.array(*map(F.lit, ("npm", "PyPI", "Go"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")).alias("version"), eco.alias("ecosystem"), F.concat(F.lit("lock"), (F.col("p_partkey") % 7).cast("string")).alias("lockfile"), F.col("p_partkey").alias("ordinal"),
        F.element_at(F.array(*map(F.lit, ("MIT", "GPL-3.0", "LGPL-2.1", "GPL-3.0 OR MIT", "Apache-2.0", "", "Proprietary", "MPL-2.0"))), (F.col("p_partkey") % 8 + 1).cast("int")).alias("license"),
    )


DEPS = """deps AS (SELECT replace(p_name, ' ', '-') AS name, '1.' || p_size || '.0' AS version, ['npm', 'PyPI', 'Go'][p_partkey % 3 + 1] AS ecosystem,
  'lock' || (p_partkey % 7) AS lockfile, p_partkey AS ordinal,
  ['MIT', 'GPL-3.0', 'LGPL-2.1', 'GPL-3.0 OR MIT', 'Apache-2.0', '', 'Proprietary', 'MPL-2.0'][p_partkey % 8 + 1] AS license FROM part)"""
