"""Findings from other tools' reports. Each takes reports(path, content) and returns import rows.

Rows: rule, title, description, severity, file, line, column, snippet, cwe, tool. JSON is read by schema; malformed
reports give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import mask_secret
from gneiss.schemas import SEVERITIES

MAX_REPORT = 50 * 1024 * 1024


def _row(df: DataFrame, tool: str, rule: Column, title: Column, description: Column, severity: Column, file: Column, line: Column, column: Column | None = None, snippet: Column | None = None, cwe: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        rule.alias("rule"), title.alias("title"), description.alias("description"), severity.alias("severity"), F.coalesce(file, F.lit("unknown")).alias("file"), F.coalesce(line.cast("int"), F.lit(0)).alias("line"),
        (F.lit(None) if column is None else column).cast("int").alias("column"), (none if snippet is None else snippet).alias("snippet"), (none if cwe is None else cwe).alias("cwe"), F.lit(tool).alias("tool"),
    )


def _words(value: Column, pairs: dict[str, str], default: str) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in pairs.items():
        out = out.when(value == k, v)
    return out.otherwise(F.lit(default))


def sarif(reports: DataFrame) -> DataFrame:
    schema = "struct<runs:array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,snippet:struct<text:string>>>>>>>>>>"
    r = reports.select(F.from_json("content", schema).alias("j")).select(F.explode("j.runs").alias("run")).select(F.explode("run.results").alias("r"))
    at = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]
    text = F.coalesce("r.message.text", F.lit(""))
    return _row(r, "sarif", F.coalesce("r.ruleId", F.lit("unknown")), F.substring(text, 1, 100), text, _words(F.col("r.level"), {"error": "high", "warning": "medium", "note": "low"}, "medium"), at["artifactLocation"]["uri"], at["region"]["startLine"], at["region"]["startColumn"], at["region"]["snippet"]["text"])


def semgrep(reports: DataFrame) -> DataFrame:
    schema = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>,extra:struct<message:string,severity:string,lines:string,metadata:struct<cwe:string>>>>>"
    r = reports.select(F.from_json("content", schema).alias("j")).select(F.explode("j.results").alias("r"))
    return _row(r, "semgrep", F.col("r.check_id"), F.element_at(F.split("r.check_id", r"\."), -1), F.coalesce("r.extra.message", F.lit("")), _words(F.col("r.extra.severity"), {"ERROR": "high", "WARNING": "medium", "INFO": "low"}, "medium"), F.col("r.path"), F.col("r.start.line"), F.col("r.start.col"), F.col("r.extra.lines"), F.col("r.extra.metadata.cwe"))


def snyk(reports: DataFrame) -> DataFrame:
    schema = "struct<vulnerabilities:array<struct<id:string,title:string,description:string,severity:string,identifiers:struct<CWE:array<string>>,`from`:array<string>>>>"
    r = reports.select(F.from_json("content", schema).alias("j")).select(F.explode("j.vulnerabilities").alias("r"))
    severity = F.when(F.col("r.severity").isin(*SEVERITIES), F.col("r.severity")).otherwise("info")
    return _row(r, "snyk", F.col("r.id"), F.col("r.title"), F.coalesce("r.description", F.lit("")), severity, F.try_element_at(F.col("r").getField("from"), F.lit(1)), F.lit(0), cwe=F.try_element_at("r.identifiers.CWE", F.lit(1)))


def trivy(reports: DataFrame) -> DataFrame:
    """Vulnerabilities; the severity is lower-cased and not checked."""
    schema = "struct<Results:array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,Title:string,Description:string,Severity:string,PkgName:string,InstalledVersion:string>>>>>"
    r = reports.select(F.from_json("content", schema).alias("j")).select(F.explode("j.Results").alias("t")).select("t.Target", F.explode("t.Vulnerabilities").alias("r"))
    return _row(r, "trivy", F.col("r.VulnerabilityID"), F.coalesce("r.Title", "r.VulnerabilityID"), F.coalesce("r.Description", F.lit("")), F.lower("r.Severity"), F.col("Target"), F.lit(0), snippet=F.concat_ws("@", "r.PkgName", "r.InstalledVersion"))


def trivy_all(reports: DataFrame) -> DataFrame:
    """Vulnerabilities, misconfigurations and masked secrets."""
    schema = "struct<Results:array<struct<Target:string,Misconfigurations:array<struct<ID:string,Title:string,Description:string,Severity:string,CauseMetadata:struct<StartLine:int>>>,Secrets:array<struct<RuleID:string,Title:string,Severity:string,StartLine:int,Match:string>>>>>"
    t = reports.select(F.from_json("content", schema).alias("j")).select(F.explode("j.Results").alias("t"))
    bad = t.select("t.Target", F.explode("t.Misconfigurations").alias("r"))
    secret = t.select("t.Target", F.explode("t.Secrets").alias("r"))
    return (
        trivy(reports)
        .unionByName(_row(bad, "trivy", F.col("r.ID"), F.col("r.Title"), F.coalesce("r.Description", F.lit("")), F.lower("r.Severity"), F.col("Target"), F.col("r.CauseMetadata.StartLine")))
        .unionByName(_row(secret, "trivy", F.col("r.RuleID"), F.col("r.Title"), F.lit(""), F.lower("r.Severity"), F.col("Target"), F.col("r.StartLine"), snippet=mask_secret("r.Match")))
    )


def gitleaks(reports: DataFrame) -> DataFrame:
    """Always critical, values masked."""
    schema = "array<struct<RuleID:string,Description:string,File:string,StartLine:int,StartColumn:int,Secret:string>>"
    r = reports.select(F.explode(F.from_json("content", schema)).alias("r"))
    return _row(r, "gitleaks", F.col("r.RuleID"), F.col("r.Description"), F.col("r.Description"), F.lit("critical"), F.col("r.File"), F.col("r.StartLine"), F.col("r.StartColumn"), mask_secret("r.Secret"), F.lit("CWE-798"))


def checkov(reports: DataFrame) -> DataFrame:
    """Failed checks, as high."""
    schema = "struct<results:struct<failed_checks:array<struct<check_id:string,check_name:string,file_path:string,file_line_range:array<int>,check_result:struct<result:string>>>>>"
    r = reports.select(F.from_json("content", schema).alias("j")).select(F.explode("j.results.failed_checks").alias("r")).where("r.check_result.result = 'FAILED'")
    return _row(r, "checkov", F.col("r.check_id"), F.col("r.check_name"), F.col("r.check_name"), F.lit("high"), F.col("r.file_path"), F.try_element_at("r.file_line_range", F.lit(1)))


def nuclei(reports: DataFrame) -> DataFrame:
    """JSON lines, one match each."""
    schema = "struct<`template-id`:string,info:struct<name:string,description:string,severity:string>,`matched-at`:string>"
    r = reports.select(F.explode(F.split("content", "\n")).alias("line")).select(F.from_json("line", schema).alias("r")).where(F.col("r").getField("template-id").isNotNull())
    return _row(r, "nuclei", F.col("r").getField("template-id"), F.col("r.info.name"), F.coalesce("r.info.description", F.lit("")), F.when(F.lower("r.info.severity").isin(*SEVERITIES), F.lower("r.info.severity")).otherwise("info"), F.col("r").getField("matched-at"), F.lit(0))


def json_or_lines(reports: DataFrame) -> DataFrame:
    """Tool output: one JSON text, else one for each line that is JSON. (path, content), a row each."""
    whole = F.try_parse_json("content").isNotNull()
    lines = reports.where(~whole).select("path", F.explode(F.split("content", "\n")).alias("content")).where(F.try_parse_json("content").isNotNull())
    return reports.where(whole).select("path", "content").unionByName(lines)


FORMATS = {"sarif": sarif, "semgrep": semgrep, "snyk": snyk, "trivy": trivy}


def detect(content: Column) -> Column:
    """A report's format by what it mentions; null if none. Trivy must be named by the caller."""
    return (
        F.when(F.contains(content, F.lit('"runs"')) & (F.contains(content, F.lit("sarif")) | F.contains(content, F.lit('"version"'))), "sarif")
        .when(F.contains(content, F.lit('"results"')) & F.contains(content, F.lit('"check_id"')), "semgrep")
        .when(F.contains(content, F.lit('"vulnerabilities"')), "snyk")
    )


def import_reports(reports: DataFrame, kind: str | None = None) -> DataFrame:
    """All reports of one named format, or each by its own; larger ones than MAX_REPORT and unknown ones give no rows."""
    reports = reports.where(F.octet_length("content") <= MAX_REPORT)
    if kind:
        return FORMATS[kind](reports)
    out = None
    for name in ("sarif", "semgrep", "snyk"):
        rows = FORMATS[name](reports.where(detect(F.col("content")) == name))
        out = rows if out is None else out.unionByName(rows)
    return out
