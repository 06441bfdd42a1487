"""Advisories with version ranges: versions as keys that sort as their ecosystem orders them, and ranges joined by package.

An advisory text is in the form of an open vulnerability table: affected packages with ranges of events (introduced, fixed,
last_affected) and lists of single versions. Packages and versions that occur are few beside the rows that name them, so
the join is over distinct ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.deps import vulnerable

#: A version of Python's ecosystem: epoch, release, pre-release, post-release (two forms), development release.
PYTHON = r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?(\d*))?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+.*)?$"


def _number(digits: Column) -> Column:
    """Digits as a text that sorts by value: how many there are, then these."""
    bare = F.regexp_replace(F.regexp_replace(digits, r"\D", ""), r"^0+(?=.)", "")
    bare = F.when(bare == "", "0").otherwise(bare)
    return F.concat(F.lpad(F.length(bare).cast("string"), 3, "0"), bare)


def _release(numbers: Column) -> Column:
    """4 and the number for each part, without zeros at the end."""
    kept = F.regexp_replace(numbers, r"(\.0+)+$", "")
    return F.transform(F.split(kept, r"\."), lambda n: F.concat(F.lit("4"), _number(n)))


def _semantic(version: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(version, r"^[vV=]+", ""), r"\+.*$", "")
    release = F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)", 1)
    rest = F.regexp_replace(F.regexp_replace(bare, r"^\d+(?:\.\d+)*", ""), r"^[-._]", "")
    # of pre-release parts, numbers are less than words, and a longer list is more than its beginning
    parts = F.transform(F.split(rest, r"[.-]"), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("1"), _number(x))).otherwise(F.concat(F.lit("2"), x)))
    return F.when(release == "", F.array(F.concat(F.lit("0"), version))).otherwise(F.concat(_release(release), F.when(rest == "", F.array(F.lit("2"))).otherwise(F.concat(F.array(F.lit("1")), parts, F.array(F.lit("0"))))))


def _python(version: Column) -> Column:
    low = F.lower(version)
    group = lambda n: F.regexp_extract(low, PYTHON, n)
    pre, post, dev = group(3), (group(5) != "") | (group(6) != ""), group(8) != ""
    kind = F.when(pre.isin("a", "alpha"), "a").when(pre.isin("b", "beta"), "b").otherwise("c")
    first = F.when(pre != "", F.concat(F.lit("1"), kind, _number(group(4)))).when(dev & ~post, "0").otherwise("2")
    after = F.when(post, F.concat(F.lit("b"), _number(F.concat(group(5), group(7))))).otherwise("a")
    last = F.when(dev, F.concat(F.lit("a"), _number(group(9)))).otherwise("b")
    return F.concat(F.array(F.concat(F.lit("4"), _number(group(1)))), _release(group(2)), F.array(first, after, last))


def version_key(version: Column | str, ecosystem: Column | str) -> Column:
    """An array of texts that sorts as the versions do: numbers by value, trailing zeros aside, a pre-release before its
    release. PyPI's versions have their own order; what it can't read, and all others, are read as semantic versions. A
    version without a number at its start is less than all others; null gives null."""
    version, ecosystem = (F.col(x) if isinstance(x, str) else x for x in (version, ecosystem))
    return F.when(version.isNotNull(), F.when((ecosystem == "PyPI") & F.lower(version).rlike(PYTHON), _python(version)).otherwise(_semantic(version)))


_OSV = "id string, summary string, details string, severity array<struct<type: string, score: string>>, database_specific struct<severity: string>, affected array<struct<package: struct<ecosystem: string, name: string>, ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>, versions: array<string>>>"


ABOUT = ("id", "summary", "details", "severity", "db_severity", "ecosystem", "name")


def parsed(texts: DataFrame, column: str = "json") -> DataFrame:
    """ABOUT, introduced, fixed, last_affected, version: a row for each range of an advisory and for each single version. Texts
    that are no advisory, and ranges of commits, give none."""
    one = texts.select(F.from_json(column, _OSV).alias("a")).where("a.id is not null").select("a.*", F.explode("a.affected").alias("p"))
    base = one.select("id", "summary", "details", "severity", F.col("database_specific.severity").alias("db_severity"), F.col("p.package.ecosystem").alias("ecosystem"), F.col("p.package.name").alias("name"), "p.ranges", "p.versions").where("name is not null")
    events = base.select(*ABOUT, F.explode("ranges").alias("r")).where("coalesce(r.type, '') <> 'GIT'").withColumn("events", F.col("r.events"))
    # the event after one that introduces says how far its range goes, unless it introduces itself
    following = lambda i, field: F.get(F.col("events"), i + 1)[field]
    spans = F.filter(F.transform("events", lambda e, i: F.struct(e["introduced"].alias("introduced"), following(i, "fixed").alias("fixed"), following(i, "last_affected").alias("last_affected"))), lambda s: s["introduced"].isNotNull())
    ranges = events.select(*ABOUT, F.explode(spans).alias("s")).select(*ABOUT, "s.*", F.lit(None).cast("string").alias("version"))
    none = {k: F.lit(None).cast("string") for k in ("introduced", "fixed", "last_affected")}
    single = base.select(*ABOUT, F.explode("versions").alias("version")).withColumns(none)
    return ranges.unionByName(single, allowMissingColumns=True)


def affected(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, version, id): versions of deps that an advisory (as from `parsed`) names or has in a range: from
    `introduced` on (0: from the first), before `fixed`, up to `last_affected`."""
    keys = ["ecosystem", "name"]
    have = deps.where("version is not null").select(*keys, "version").distinct().withColumn("v", version_key("version", "ecosystem"))
    bound = advisories.select(*keys, "id", F.col("version").alias("only"), *(version_key(F.nullif(F.col(k), F.lit("0")), F.col("ecosystem")).alias(k) for k in ("introduced", "fixed", "last_affected")))
    v = F.col("v")
    inside = F.col("only").isNull() & F.coalesce(F.col("introduced") <= v, F.lit(True)) & F.coalesce(v < F.col("fixed"), F.lit(True)) & F.coalesce(v <= F.col("last_affected"), F.lit(True))
    return have.join(bound, keys).where(F.coalesce(F.col("only") == F.col("version"), F.lit(False)) | inside).select(*keys, "version", "id").distinct()


def vulnerable_by_range(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings as from deps.vulnerable, by ranges: each advisory once for each dependency that it affects."""
    said = advisories.groupBy("id").agg(F.first(F.struct("summary", "details", "severity", "db_severity")).alias("s")).select("id", "s.*")
    return vulnerable(deps, affected(deps, advisories).join(said, "id"))
