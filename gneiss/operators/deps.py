"""Dependencies: duplicates, advisories, licenses, bills of materials, and supply-chain checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import advisory_severity, license_class, purl


def dedup_deps(deps: DataFrame, keys: tuple[str, ...] = ("ecosystem", "name", "version"), order: str = "ordinal") -> DataFrame:
    """The first row of each key. The license and dependency views leave the ecosystem out of the key."""
    return deps.groupBy(*keys).agg(F.min_by(F.struct(*deps.columns), order).alias("_first")).select("_first.*")


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings of dependencies that an advisory of an offline table names in just this version."""
    keys = ["ecosystem", "name", "version"]
    hit = deps.join(advisories, keys)
    return hit.select(
        F.concat(F.lit("dep:"), "id").alias("rule"), F.coalesce("summary", "id").alias("title"), F.substring(F.coalesce("details", F.lit("")), 1, 300).alias("description"), advisory_severity().alias("severity"),
        F.lit("dependency").alias("category"), F.col("lockfile").alias("file"), F.lit(0).alias("line"), F.concat_ws("@", "name", "version").alias("snippet"), F.lit("high").alias("confidence"),
    )


def flag_vulnerable(deps: DataFrame, found: DataFrame) -> DataFrame:
    """deps with `vulnerable`: whether a dependency finding's snippet starts with name@version."""
    bad = found.where("category = 'dependency'").select(F.split("snippet", " ")[0].alias("_key")).distinct()
    return deps.withColumn("_key", F.concat_ws("@", "name", "version")).join(bad.withColumn("vulnerable", F.lit(True)), "_key", "left").withColumn("vulnerable", F.coalesce("vulnerable", F.lit(False))).drop("_key")


def by_ecosystem(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("ecosystem").agg(F.count("*").alias("total"), F.count_if("vulnerable").alias("vulnerable"))


def license_buckets(deps: DataFrame) -> DataFrame:
    """deps(license) by class and count."""
    return deps.withColumn("license_class", license_class("license")).groupBy("license_class").agg(F.count("*").alias("n"))


def sbom_components(deps: DataFrame) -> DataFrame:
    return deps.select("name", "version", "ecosystem", purl().alias("purl"))


def cyclonedx(deps: DataFrame) -> DataFrame:
    """One CycloneDX 1.5 text over all components, in order of their purl."""
    parts = sbom_components(deps).select(F.struct("purl", F.struct(F.lit("library").alias("type"), "name", "version", "purl").alias("c")).alias("x"))
    sorted_ = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"])
    return parts.agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), sorted_.alias("components"))).alias("json"))


def spdx(deps: DataFrame, project: str) -> DataFrame:
    """SPDX 2.3 packages with ids from 1 in order of their purl, and what the project depends on."""
    every = F.array_sort(F.collect_list(F.struct("purl", "name", "version")))
    packages = F.transform(every, lambda x, i: F.struct(F.format_string("SPDXRef-Package-%d", i + 1).alias("SPDXID"), x["name"].alias("name"), x["version"].alias("versionInfo"), x["purl"].alias("purl")))
    links = F.transform(every, lambda x, i: F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"), F.format_string("SPDXRef-Package-%d", i + 1).alias("relatedSpdxElement")))
    return sbom_components(deps).agg(F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit(project).alias("name"), packages.alias("packages"), links.alias("relationships"))).alias("json"))


#: Well-known names that impostors come close to, and the impostors.
TYPOSQUATS = {
    "lodash": ("lodahs", "lodasg", "1odash"), "express": ("expres", "expresss", "exress"), "react": ("raect", "reacct"), "axios": ("axois", "axio"), "chalk": ("chalks", "chaulk"), "commander": ("comander", "commmander"), "debug": ("debugg", "debig"),
    "request": ("requst", "reqeust"), "moment": ("momnet", "moement"), "webpack": ("webpak", "wepback"), "requests": ("request5", "reqests"), "numpy": ("numppy", "nunpy"), "django": ("djang0", "dajngo"), "flask": ("flaskk", "fiask"),
}


def typosquats(deps: DataFrame, targets: dict[str, tuple[str, ...]] = TYPOSQUATS) -> DataFrame:
    """The dependency's name in lower case against the list as it is."""
    spark = deps.sparkSession
    table = spark.createDataFrame([(bad, good) for good, names in targets.items() for bad in names], "impostor string, target string")
    hit = deps.join(F.broadcast(table), F.lower("name") == F.col("impostor"))
    return hit.select(F.lit("supply:typosquat").alias("rule"), F.lit("critical").alias("severity"), "name", "target", F.col("lockfile").alias("file"))


def _rule(df: DataFrame, rule: str, severity: str, name: str = "name") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("path").alias("file"), F.col(name).alias("snippet"))


def supply_chain(files: DataFrame) -> DataFrame:
    """Checks of manifests: install scripts, dependencies from git, open versions, missing lockfiles, Python pins and indexes."""
    name = F.element_at(F.split("path", "/"), -1)
    entry = "map<string,string>"
    j = files.where(name == "package.json").select("path", F.from_json("content", f"struct<scripts:{entry},dependencies:{entry},devDependencies:{entry}>").alias("j"))
    scripts = j.select("path", F.explode("j.scripts").alias("k", "v")).where(F.col("k").isin("preinstall", "install", "postinstall") & F.col("v").rlike(r"(?i)curl|wget|node -e|bash|sh -c|eval"))
    every = j.select("path", F.explode(F.map_concat(F.coalesce("j.dependencies", F.create_map().cast(entry)), F.coalesce("j.devDependencies", F.create_map().cast(entry)))).alias("k", "v"))
    locked = files.where(name.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml")).select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).distinct()
    bare = j.select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).join(locked, "dir", "left_anti").withColumn("name", F.lit("package.json"))
    lines = files.where(name == "requirements.txt").select("path", F.explode(F.split("content", "\n")).alias("line")).withColumn("line", F.trim("line"))
    parts = [
        _rule(scripts, "supply:dangerous-install-script", "high", "v"),
        _rule(every.where(F.col("v").rlike(r"^(git|github:|https?://.*\.git)")), "supply:git-dependency", "medium", "k"),
        _rule(every.where(F.col("v").isin("*", "latest", "")), "supply:unpinned-dependency", "medium", "k"),
        _rule(bare, "supply:no-lockfile", "medium"),
        _rule(lines.where(F.col("line").rlike(r"^[A-Za-z0-9_.-]+\s*(>=|>|~=|$)")), "supply:unpinned-python-dep", "low", "line"),
        _rule(lines.where(F.col("line").rlike(r"^--(extra-)?index-url")), "supply:custom-index", "medium", "line"),
    ]
    return reduce(DataFrame.unionByName, parts)


def dependency_confusion(files: DataFrame) -> DataFrame:
    """Private packages without a scope, names anyone may claim, registries and tokens in settings, extra Python indexes."""
    name = F.element_at(F.split("path", "/"), -1)
    j = files.where(name == "package.json").select("path", F.from_json("content", "struct<name:string,private:boolean,dependencies:map<string,string>>").alias("j"))
    unscoped = j.where("j.private and not startswith(j.name, '@')").select("path", F.col("j.name").alias("name"))
    claim = j.select("path", F.explode("j.dependencies").alias("name", "v")).where(F.col("name").rlike(r"(?i)(internal|private|corp|company)") & ~F.startswith("name", F.lit("@")))
    rc = files.where(name == ".npmrc").select("path", F.explode(F.split("content", "\n")).alias("name"))
    pip = files.where(name.isin("pip.conf", "requirements.txt")).select("path", F.explode(F.split("content", "\n")).alias("name"))
    parts = [
        _rule(unscoped, "depcon:unscoped-private", "medium"),
        _rule(claim, "depcon:claimable-name", "high"),
        _rule(rc.where(F.col("name").rlike(r"^registry\s*=") & ~F.contains("name", F.lit("registry.npmjs.org"))), "depcon:global-private-registry", "medium"),
        _rule(rc.where(F.col("name").rlike(r"_authToken\s*=\s*[^$\s]")), "depcon:auth-token-hardcoded", "high"),
        _rule(pip.where(F.col("name").rlike(r"extra-index-url")), "depcon:python-extra-index", "high"),
    ]
    return reduce(DataFrame.unionByName, parts)


def env_checks(files: DataFrame) -> DataFrame:
    """Settings files (.env and its kin): empty, default, debugging, insecure and unsafe values, and files that may be committed."""
    name = F.element_at(F.split("path", "/"), -1)
    own = files.where(name.rlike(r"^\.env(\..*)?$"))
    pair = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    lines = own.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).where(F.col("text").rlike(pair))
    k, v = F.upper(F.regexp_extract("text", pair, 1)), F.regexp_replace(F.regexp_extract("text", pair, 2), "^[\"']|[\"']$", "")
    production = F.col("path").rlike(r"production|prod$")
    secret = k.rlike("SECRET|PASSWORD|TOKEN|KEY")
    tests = [
        F.when(secret & (v == ""), F.struct(F.lit("env:empty-required").alias("rule"), F.lit("medium").alias("severity"))),
        F.when(secret & F.lower(v).isin("changeme", "password", "secret", "admin", "default", "123456", "test"), F.struct(F.lit("env:default-value").alias("rule"), F.lit("high").alias("severity"))),
        F.when(k.rlike("DEBUG") & F.lower(v).isin("true", "1", "yes", "*") & production, F.struct(F.lit("env:debug-in-prod").alias("rule"), F.lit("medium").alias("severity"))),
        F.when(v.rlike(r"^http://(?!localhost|127\.)"), F.struct(F.lit("env:insecure-url").alias("rule"), F.lit("low").alias("severity"))),
        F.when(v.rlike(r"\$\(|`"), F.struct(F.lit("env:injection").alias("rule"), F.lit("high").alias("severity"))),
    ]
    found = lines.select("path", (F.col("pos") + 1).alias("line"), F.explode(F.array_compact(F.array(*tests))).alias("h")).select("h.rule", "h.severity", F.col("path").alias("file"), "line")
    ignored = files.where(name == ".gitignore").select(F.explode(F.split("content", "\n")).alias("g")).where(F.trim("g").isin(".env", ".env*", "*.env", ".env.*")).select(F.regexp_replace(F.trim("g"), r"\*|\.\*", "").alias("g")).distinct()
    open_ = own.join(ignored, F.contains(name, F.col("g")), "left_anti").select(F.lit("env:not-gitignored").alias("rule"), F.lit("high").alias("severity"), F.col("path").alias("file"), F.lit(0).alias("line"))
    return found.unionByName(open_)
