"""Registered queries of advisories with version ranges, and of the store behind repeated scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.operators import advisories as V
from gneiss.operators.findings import SCAN_STORE, incremental_scan
from gneiss.plans.base import FILES, query, read
from gneiss.plans.base import files as corpus
from gneiss.plans.scan_queries import _RULES
from gneiss.sources.stores import Store, shared_folder

#: Packages at versions with and without a pre-release, and two advisories each, by arithmetic on the keys of `part`.
_VERSIONS = """p AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 40) AS name, p_partkey % 40 AS d, p_size AS minor, p_partkey % 3 AS patch, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 11 END AS rc FROM part),
q AS (SELECT *, '1.' || minor || '.' || patch || coalesce('-rc.' || rc, '') AS version, [minor, patch, CASE WHEN rc IS NULL THEN 1 ELSE 0 END, coalesce(rc, 0)] AS v FROM p)"""
_AFFECTED = f"""WITH {_VERSIONS} SELECT DISTINCT name, version, 'A' || d AS id FROM q WHERE v >= [d % 10, 0, 1, 0] AND v < [d % 10 + 15, 1, 0, 2] OR d % 2 = 0 AND v >= [40, 0, 0, 5] OR version = '1.' || (d % 10 + 20) || '.1'
UNION SELECT DISTINCT name, version, 'B' || d FROM q WHERE v <= [d % 7 + 2, 1, 1, 0]"""


def packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dependencies, advisory texts)."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    version = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("."), (k % 3).cast("string"), F.when(k % 5 == 0, F.concat(F.lit("-rc."), (k % 11).cast("string"))).otherwise(""))
    deps = part.select(F.concat(F.lit("pkg"), (k % 40).cast("string")).alias("name"), version.alias("version"), F.lit("npm").alias("ecosystem"), F.lit("x.lock").alias("lockfile"))
    d = part.select((k % 40).alias("d")).distinct()
    number = lambda c: c.cast("string")
    one, text = F.col("d") % 10, F.lit(None).cast("string")
    event = lambda introduced=text, fixed=text, last=text: F.struct(introduced.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"))
    a = F.concat(F.array(event(F.concat(F.lit("1."), number(one))), event(fixed=F.concat(F.lit("v1."), number(one + 15), F.lit(".1-rc.2")))), F.when(F.col("d") % 2 == 0, F.array(event(F.lit("1.40.0-rc.5")))).otherwise(F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>")))
    b = F.array(event(F.lit("0")), event(last=F.concat(F.lit("1."), number(F.col("d") % 7 + 2), F.lit(".1+build"))))

    def advisory(prefix: str, events, versions):
        package = F.struct(F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg"), number(F.col("d"))).alias("name"))
        commits = F.struct(F.lit("GIT").alias("type"), F.array(event(F.lit("0"))).alias("events"))
        affected = F.array(F.struct(package.alias("package"), F.array(commits, F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges"), versions.alias("versions")))
        return F.to_json(F.struct(F.concat(F.lit(prefix), number(F.col("d"))).alias("id"), F.lit("summary").alias("summary"), affected.alias("affected")))

    only = F.array(F.concat(F.lit("1."), number(one + 20), F.lit(".1")))
    texts = d.select(F.explode(F.array(advisory("A", a, only), advisory("B", b, F.array().cast("array<string>")), F.lit("no advisory"))).alias("json"))
    return deps, texts


@query("advisory_ranges", _AFFECTED)
def advisory_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps, texts = packages(spark, sf_dir)
    return V.affected(deps, V.parsed(texts)).select("name", "version", "id")


@query("advisory_findings", f"{_AFFECTED.replace('WITH', 'WITH h AS (WITH', 1)}) SELECT 'dep:' || id AS rule, name || '@' || version AS snippet, 'high' AS severity, count(*) AS n FROM h JOIN (WITH {_VERSIONS} SELECT name, version FROM q) d USING (name, version) GROUP BY ALL")
def advisory_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps, texts = packages(spark, sf_dir)
    return V.vulnerable_by_range(deps, V.parsed(texts)).groupBy("rule", "snippet", "severity").agg(F.count("*").alias("n"))


_TWICE = f"""WITH {FILES}, one AS (SELECT path, content FROM files WHERE path NOT LIKE '%7'),
two AS (SELECT path, CASE WHEN path LIKE '%3' THEN content || chr(10) || 'Licensed under X' ELSE content END AS content FROM files),
l AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM two), {_RULES},
a AS (SELECT two.path FROM two LEFT JOIN one ON one.path = two.path AND one.content IS NOT DISTINCT FROM two.content WHERE one.path IS NULL)
SELECT 'again' AS what, NULL AS rule, count(*) AS n FROM a UNION ALL SELECT 'findings', rule, count(*) FROM l JOIN rules ON regexp_matches(l.line, rx, 'i') GROUP BY rule"""


@query("incremental_scan", _TWICE)
def incremental_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scanned twice through one store, the second time with new and changed ones: how many were scanned again, and all
    findings of the second version."""
    files = corpus(spark, sf_dir)
    store = Store(spark, f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}", SCAN_STORE)
    incremental_scan(files.where("path not like '%7'"), store, "1", (R.CORPUS,))
    changed = files.withColumn("content", F.when(F.endswith("path", F.lit("3")), F.concat("content", F.lit("\nLicensed under X"))).otherwise(F.col("content")))
    found, again = incremental_scan(changed, store, "1", (R.CORPUS,))
    counted = again.agg(F.lit("again").alias("what"), F.lit(None).cast("string").alias("rule"), F.count("*").alias("n"))
    return counted.unionByName(found.groupBy(F.lit("findings").alias("what"), "rule").agg(F.count("*").alias("n")))
