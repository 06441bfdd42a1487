"""Lockfiles as dependency rows: (name, version, ecosystem, lockfile).

A parser takes files(path, content) that it owns and returns its rows in native expressions; JSON is read by schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names looked for at a project's root. Those without a parser give no rows.
DISCOVERED = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "Pipfile.lock", "poetry.lock", "go.sum", "Cargo.lock", "Gemfile.lock", "composer.lock", "pom.xml", "build.gradle")


def _name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def discover(files: DataFrame, root: str = "") -> DataFrame:
    base = root.rstrip("/")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    return files.where(_name().isin(*DISCOVERED) & (parent == base))


def _rows(df: DataFrame, name: Column, version: Column, ecosystem: str) -> DataFrame:
    return df.select(name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"), F.col("path").alias("lockfile"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("at", "line"))


def npm(files: DataFrame) -> DataFrame:
    entry = "map<string,struct<version:string>>"
    doc = files.select("path", F.from_json("content", f"struct<packages:{entry},dependencies:{entry}>").alias("j"))
    new = doc.where("j.packages is not null").select("path", F.explode("j.packages").alias("k", "v")).where("k <> '' and v.version is not null")
    old = doc.where("j.packages is null and j.dependencies is not null").select("path", F.explode("j.dependencies").alias("k", "v")).where("v.version is not null")
    return _rows(new, F.regexp_replace("k", "^node_modules/", ""), F.col("v.version"), "npm").unionByName(_rows(old, F.col("k"), F.col("v.version"), "npm"))


def yarn(files: DataFrame) -> DataFrame:
    blocks = files.select("path", F.explode(F.split("content", "\n(?=\\S)")).alias("b"))
    found = blocks.select("path", F.regexp_extract("b", r'^"?([^@"\s]+)@[^\n]*:\s*\n', 1).alias("n"), F.regexp_extract("b", r'\n\s+version:?\s+"?([^"\s]+)"?', 1).alias("v"))
    return _rows(found.where("n <> '' and v <> ''"), F.col("n"), F.col("v"), "npm")


def requirements(files: DataFrame) -> DataFrame:
    found = _lines(files).select("path", F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#') and not startswith(line, '-')")
    pattern = r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*==\s*([A-Za-z0-9_.\-+!]+)"
    return _rows(found.where(F.col("line").rlike(pattern)), F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2), "PyPI")


def pipfile(files: DataFrame) -> DataFrame:
    entry = "map<string,struct<version:string>>"
    doc = files.select("path", F.from_json("content", f"struct<default:{entry},develop:{entry}>").alias("j"))
    both = doc.select("path", F.explode("j.default").alias("k", "v")).unionByName(doc.select("path", F.explode("j.develop").alias("k", "v"))).where("v.version is not null")
    return _rows(both, F.col("k"), F.regexp_replace("v.version", "^==", ""), "PyPI")


def go_sum(files: DataFrame) -> DataFrame:
    pattern = r"^(\S+) v([^\s/]+)(?:/go\.mod)? "
    found = _lines(files).where(F.col("line").rlike(pattern)).select("path", F.regexp_extract("line", pattern, 1).alias("n"), F.regexp_extract("line", pattern, 2).alias("v")).dropDuplicates()
    return _rows(found, F.col("n"), F.col("v"), "Go")


def cargo(files: DataFrame) -> DataFrame:
    blocks = files.select("path", F.posexplode(F.split("content", r"\[\[package\]\]")).alias("at", "b")).where("at > 0")
    found = blocks.select("path", F.regexp_extract("b", r'(?m)^name\s*=\s*"([^"]+)"', 1).alias("n"), F.regexp_extract("b", r'(?m)^version\s*=\s*"([^"]+)"', 1).alias("v"))
    return _rows(found.where("n <> '' and v <> ''"), F.col("n"), F.col("v"), "crates.io")


def gemfile(files: DataFrame) -> DataFrame:
    mark = F.when(F.trim("line") == "specs:", F.lit(True)).when(F.col("line").rlike(r"^\S"), F.lit(False))
    inside = F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("at"))
    pattern = r"^ {4}([^\s(]+) \(([^)]+)\)"
    found = _lines(files).withColumn("inside", inside).where(F.col("inside") & F.col("line").rlike(pattern))
    return _rows(found, F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2), "RubyGems")


def composer(files: DataFrame) -> DataFrame:
    entry = "array<struct<name:string,version:string>>"
    doc = files.select("path", F.from_json("content", f"struct<packages:{entry},`packages-dev`:{entry}>").alias("j"))
    both = doc.select("path", F.explode("j.packages").alias("p")).unionByName(doc.select("path", F.explode(F.col("j").getField("packages-dev")).alias("p")))
    return _rows(both.where("p.name is not null and p.version is not null"), F.col("p.name"), F.regexp_replace("p.version", "^v", ""), "Packagist")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "package-lock.json": npm,
    "yarn.lock": yarn,
    "requirements.txt": requirements,
    "Pipfile.lock": pipfile,
    "go.sum": go_sum,
    "Cargo.lock": cargo,
    "Gemfile.lock": gemfile,
    "composer.lock": composer,
}


def parse_lockfiles(files: DataFrame, root: str = "") -> DataFrame:
    found = discover(files, root)
    out = None
    for name, parser in PARSERS.items():
        rows = parser(found.where(_name() == name))
        out = rows if out is None else out.unionByName(rows)
    return out
