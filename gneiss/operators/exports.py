"""Findings as SARIF, JSON, CSV, tickets and messages: each a DataFrame, of one text or a row a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import severity_rank
from gneiss.operators.scoring import severity_counts
from gneiss.schemas import SEVERITIES

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none"}
JIRA = {"critical": "Highest", "high": "High", "medium": "Medium", "low": "Low", "info": "Lowest"}
LINEAR = {"critical": 1, "high": 2, "medium": 3, "low": 4, "info": 4}
CSV = (("ID", "id"), ("Severity", "severity"), ("Title", "title"), ("Rule", "rule"), ("Category", "category"), ("CWE", "cwe"), ("File", "file"), ("Line", "line"), ("Confidence", "confidence"), ("Description", "description"), ("Snippet", "snippet"))


def _map(column: str, table: dict):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column))


def sarif_rules(found: DataFrame) -> DataFrame:
    """A row a rule: that of its first finding, by first appearance."""
    return found.groupBy("rule").agg(F.min("ordinal").alias("first_seen"), F.min_by("title", "ordinal").alias("title"), F.min_by("severity", "ordinal").alias("severity")).withColumn("level", F.coalesce(_map("severity", LEVELS), F.lit("none")))


def sarif_results(found: DataFrame) -> DataFrame:
    """A row a finding: ruleId, level, message, uri with forward slashes, startLine, startColumn (1 where unknown)."""
    column = F.coalesce("column", F.lit(1)) if "column" in found.columns else F.lit(1)
    return found.select("ordinal", F.col("rule").alias("ruleId"), F.coalesce(_map("severity", LEVELS), F.lit("none")).alias("level"), F.coalesce("title", F.lit("")).alias("message"), F.replace("file", F.lit("\\"), F.lit("/")).alias("uri"), F.col("line").alias("startLine"), column.alias("startColumn"))


def sarif(found: DataFrame, tool: str = "gneiss", version: str = "1") -> DataFrame:
    """One SARIF 2.1.0 text. For a report that people read; large tables are better written as sarif_results."""
    region = F.struct("startLine", "startColumn")
    place = F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    results = sarif_results(found).select(F.struct("ordinal", F.struct("ruleId", "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")).alias("r")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"))
    rules = sarif_rules(found).select(F.struct("first_seen", F.struct(F.col("rule").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription")).alias("r")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), "rules")
    return results.crossJoin(rules).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), "results")).alias("runs"))).alias("json"))


def json_summary(found: DataFrame) -> DataFrame:
    return severity_counts(found).select(F.to_json(F.struct(F.col("total").alias("total_findings"), F.struct(*SEVERITIES).alias("by_severity"))).alias("json"))


def csv_field(column: str):
    """Quoted only where it must be, quotes doubled."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_rows(found: DataFrame) -> DataFrame:
    """(ordinal, row), without the header; header is csv_header()."""
    held = [c if c in found.columns else None for _, c in CSV]
    return found.select("ordinal", F.concat_ws(",", *(csv_field(c) if c else F.lit("") for c in held)).alias("row"))


def csv_header() -> str:
    return ",".join(k for k, _ in CSV)


def write_csv(found: DataFrame, path: str) -> None:
    found.select(*(F.col(c).alias(k) for k, c in CSV if c in found.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def tickets(found: DataFrame) -> DataFrame:
    """Priorities for Jira, Linear and GitHub."""
    github = F.when(F.col("severity").isin("critical", "high"), "priority: high").otherwise("priority: medium")
    return found.select("ordinal", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title").alias("summary"), F.coalesce(_map("severity", JIRA), F.lit("Low")).alias("jira"), F.coalesce(_map("severity", LINEAR), F.lit(4)).alias("linear"), github.alias("github"))


def markdown(found: DataFrame) -> DataFrame:
    """(rank, severity, body): a section of lines for each severity that occurs.

    Lines are sorted in ranges and joined in blocks of 65,536 places; the task that makes a section reads joined text only.
    """
    line = F.concat(F.lit("- **"), "title", F.lit("** `"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("`"))
    placed = found.select("severity", "ordinal", line.alias("l")).orderBy("severity", "ordinal", "l").select("severity", "l", F.monotonically_increasing_id().alias("place"))
    blocks = placed.groupBy("severity", F.shiftright("place", 16).alias("block")).agg(F.when(F.count("l") > 0, _joined("place", "l")).alias("text"))
    return blocks.groupBy(severity_rank("severity").alias("rank"), "severity").agg(_joined("block", "text").alias("body"))


def _joined(place: str, text: str):
    """The texts of a group in the order of their places, a line each; null ones are left out."""
    return F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]))


def notify_payload(found: DataFrame, n: int = 5) -> DataFrame:
    """Counts, and the first critical or high findings."""
    first = found.where(F.col("severity").isin("critical", "high")).orderBy("ordinal").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "title", "file", "line"))), lambda x: F.struct(x["title"].alias("title"), x["file"].alias("file"), x["line"].alias("line"))).alias("top"))
    return severity_counts(found).crossJoin(first).select(F.to_json(F.struct("total", "critical", "high", "top")).alias("json"))
