"""Policies, custom rules and services out of YAML files, as tables.

Each reader takes files(path, content) and reads each file once: what it asks of a whole document it finds among that
document's own scalars; the work after that is grouping and joining of rows, by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.sources.stores import staged
from gneiss.sources.yamlfiles import at, documents, list_at, text_at, text_of, under


def first_file(files: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """The file of the first of these paths that there is."""
    place = F.array_position(F.array(*map(F.lit, paths)), F.col("path"))
    return files.where(F.col("path").isin(*paths)).agg(F.min(F.struct(place, "path", "content")).alias("x")).where("x is not null").select("x.path", "x.content")


def _whole(files: DataFrame) -> DataFrame:
    """Files of one document: more of them are an error where one is asked for."""
    return documents(files).where("last = 0")


def _is_object(*keys: str | None) -> Column:
    """Aggregate: whether a map or a list is under these keys."""
    return F.coalesce(F.bool_or(under(*keys, None) | (at(*keys) & F.col("kind").isin("map", "list"))), F.lit(False))


def _is_text(*keys: str | None) -> Column:
    return F.coalesce(F.bool_or(at(*keys) & (F.col("kind") == "str")), F.lit(False))


POLICY_RULES = "path string, policy string, ordinal int, id string, description string, action string, cond_type string, severity string, categories array<string>, rules array<string>, max_count double, min_score double, compliance array<string>"


def policies(files: DataFrame) -> DataFrame:
    """The rules of each policy file, as operators.policy takes them (POLICY_RULES), in the file's order.

    A file counts if it is one document with a name and a list of rules that all have an id, a description and an action,
    each a text, and a condition. An action other than block warns; a threshold without a severity is critical."""
    named = F.exists("rows", lambda r: at("name", of=r["keys"]) & (r["kind"] == "str"))
    listed = F.exists("rows", lambda r: at("rules", of=r["keys"]) & (r["kind"] == "list") | under("rules", "[0]", of=r["keys"]))
    rows = _whole(files).where(named & listed).select("path", text_of("name").alias("policy"), F.inline("rows"))
    place = F.get("keys", F.lit(1))
    r, c = ("rules", None), ("rules", None, "condition")
    rules = rows.where(under(*r)).groupBy("path", "policy", place.alias("item")).agg(
        (_is_text(*r, "id") & _is_text(*r, "description") & _is_text(*r, "action") & _is_object(*c)).alias("valid"),
        text_at(*r, "id").alias("id"), text_at(*r, "description").alias("description"), F.when(text_at(*r, "action") == "block", "block").otherwise("warn").alias("action"),
        text_at(*c, "type").alias("cond_type"), F.coalesce(text_at(*c, "severity"), F.lit("critical")).alias("severity"), list_at(*c, "categories").alias("categories"), list_at(*c, "rules").alias("rules"),
        text_at(*c, "maxCount").cast("double").alias("max_count"), text_at(*c, "minScore").cast("double").alias("min_score"), list_at(*r, "compliance").alias("compliance"),
    )
    ordinal = F.regexp_extract("item", r"\d+", 0).cast("int")
    good = F.bool_and("valid").over(Window.partitionBy("path"))
    return rules.withColumns({"good": good, "ordinal": ordinal}).where("good").select(*(x.split()[0] for x in POLICY_RULES.split(", ")))


def custom_rules(files: DataFrame) -> DataFrame:
    """path, ordinal, id, title, severity, category, cwe, languages, patterns (regular expressions) of rule files: a list of
    rules, one under `rules`, or a single rule. A rule without an id or a list of patterns is left out; the rest has
    defaults."""
    first = lambda r: F.get(r["keys"], F.lit(0))
    is_list, has_rules = F.exists("rows", lambda r: F.startswith(first(r), F.lit("["))), F.exists("rows", lambda r: first(r) == "rules")
    own = _whole(files).select("path", is_list.alias("is_list"), has_rules.alias("has_rules"), F.inline("rows"))
    drop = F.when(F.col("is_list"), 1).when(F.col("has_rules"), 2).otherwise(0)
    own = own.where(F.col("is_list") | ~F.col("has_rules") | (under("rules", None) & F.startswith(F.get("keys", F.lit(1)), F.lit("["))))
    own = own.withColumns({"item": F.when(drop > 0, F.regexp_extract(F.get("keys", drop - 1), r"\d+", 0).cast("int")).otherwise(0), "keys": F.slice("keys", drop + 1, F.greatest(F.size("keys") - drop, F.lit(0)))})
    p = under("patterns", None) & F.startswith(F.get("keys", F.lit(1)), F.lit("["))
    # the parts of one pattern meet in a map by their place
    part = F.when(p & (F.size("keys") == 3), F.struct(F.regexp_extract(F.get("keys", F.lit(1)), r"\d+", 0).cast("int").alias("n"), F.get("keys", F.lit(2)).alias("k"), "value"))
    rules = own.groupBy("path", F.col("item").alias("ordinal")).agg(
        text_at("id").alias("id"), text_at("title").alias("title"), text_at("severity").alias("severity"), text_at("category").alias("category"), text_at("cwe").alias("cwe"), list_at("languages").alias("languages"),
        F.bool_or(p | (at("patterns") & (F.col("kind") == "list"))).alias("has"), F.array_sort(F.collect_list(part)).alias("parts"),
    )
    other = F.transform(F.filter("parts", lambda x: (x["k"] == "type") & (x["value"] != "regex")), lambda x: x["n"])
    patterns = F.transform(F.filter("parts", lambda x: (x["k"] == "pattern") & ~F.array_contains(F.col("other"), x["n"])), lambda x: x["value"])
    text = lambda name, default: F.when(F.coalesce(F.col(name), F.lit("")) == "", default).otherwise(F.col(name)).alias(name)
    good = rules.where("has and id is not null and id <> ''").withColumn("other", other).withColumn("patterns", patterns)
    return good.select("path", "ordinal", "id", text("title", F.col("id")), text("severity", F.lit("medium")), text("category", F.lit("custom")), "cwe", F.when(F.size("languages") > 0, F.col("languages")).otherwise(F.array(F.lit("*"))).alias("languages"), "patterns")


#: Where compose files and manifests are looked for.
COMPOSE = r"^(docker-)?compose[^/]*\.ya?ml$"
MANIFESTS = r"^k8s/(.*/)?[^/]+\.ya?ml$|^(kubernetes|manifests|deploy)/(.*/)?[^/]+\.yml$"
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet")
SERVICE = "project string, path string, ordinal int, name string, image string, ports array<int>, environment map<string,string>, depends_on array<string>, volumes array<string>"


def _project(files: DataFrame) -> DataFrame:
    return files if "project" in files.columns else files.withColumn("project", F.lit(""))


def _entries(pairs: Column) -> Column:
    """A map of (ordinal, key, value) triples; the last of equal keys counts."""
    return F.map_from_entries(F.transform(F.filter(pairs, lambda x: ~F.exists(pairs, lambda y: (y["k"] == x["k"]) & (y["ordinal"] > x["ordinal"]))), lambda x: F.struct(x["k"], x["v"])))


def parsed(files: DataFrame, where: str = f"{COMPOSE}|{MANIFESTS}") -> DataFrame:
    """project, path and documents (yamlfiles.DOCUMENT) of the files at these paths; all readers below take it in place of
    files, so that one reading serves several of them."""
    files = files.where(F.col("path").rlike(where))
    if "rows" in files.columns:
        return files
    docs = documents(_project(files).select(F.to_json(F.struct("project", "path")).alias("path"), "content"))
    return docs.withColumn("place", F.from_json("path", "project string, path string")).select("place.project", "place.path", "document", "last", "rows")


def compose_services(files: DataFrame) -> DataFrame:
    """Services of compose files at a project's root. files(path, content), and project where there are several.

    A port is the number behind a colon; long forms of ports and volumes name none. Environments are lists of key=value or
    maps, dependencies lists or maps. A service without any settings ends its file."""
    empty = F.filter("rows", lambda r: at("services", None, of=r["keys"]) & (r["kind"] == "null"))
    docs = parsed(files, COMPOSE).where("last = 0").select("project", "path", F.array_min(F.transform(empty, lambda r: r["ordinal"])).alias("end"), F.inline("rows"))
    rows = docs.where(under("services", None)).where("end is null or ordinal < end")
    name = F.get("keys", F.lit(1))
    s = ("services", None)
    value, four = F.coalesce("value", F.lit("")), F.get("keys", F.lit(3))
    listed = F.startswith(four, F.lit("["))
    pair = F.when(at(*s, "environment", None) & listed, F.struct("ordinal", F.split(value, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(value, "=", 2), F.lit(1)), F.lit("")).alias("v"))).when(at(*s, "environment", None), F.struct("ordinal", four.alias("k"), value.alias("v")))
    needs = F.when(under(*s, "depends_on", None), F.struct(F.col("ordinal"), F.when(listed, F.col("value")).otherwise(four).alias("v")))
    out = rows.groupBy("project", "path", name.alias("name")).agg(F.min("ordinal").alias("ordinal"), text_at(*s, "image").alias("image"), list_at(*s, "ports").alias("ports"), F.array_sort(F.collect_list(pair)).alias("pairs"), F.array_distinct(F.transform(F.array_sort(F.collect_list(needs)), lambda x: x["v"])).alias("depends_on"), list_at(*s, "volumes").alias("volumes"))
    ports = F.filter(F.transform("ports", lambda p: F.regexp_extract(p, r":(\d+)", 1).try_cast("int")), lambda p: p.isNotNull())
    return out.select("project", "path", "ordinal", "name", "image", ports.alias("ports"), _entries(F.col("pairs")).alias("environment"), "depends_on", "volumes")


def _manifests(files: DataFrame) -> DataFrame:
    """Documents of manifests, with what kind of object each is and its name."""
    return parsed(files, MANIFESTS).withColumns({"of": text_of("kind"), "own_name": text_of("metadata", "name")})


def manifest_services(files: DataFrame) -> DataFrame:
    """A service for each container of the workloads in manifests, by the workload's name."""
    c = ("spec", "template", "spec", "containers", None)
    docs = _manifests(files).where(F.col("of").isin(*WORKLOADS)).select("project", "path", "document", F.col("own_name").alias("workload"), F.inline("rows"))
    rows = docs.where(under(*c)).withColumn("container", F.regexp_extract(F.get("keys", F.lit(4)), r"\d+", 0).cast("int"))
    # an environment's entries are maps themselves: their names and values meet by place
    part = F.when(at(*c, "env", None, None), F.struct("ordinal", F.get("keys", F.lit(6)).alias("item"), F.get("keys", F.lit(7)).alias("field"), "value"))
    port = F.when(at(*c, "ports", None, "containerPort") & (F.col("kind") == "int") & (F.col("value") != "0"), F.struct("ordinal", F.col("value").cast("int").alias("v")))
    out = rows.groupBy("project", "path", "document", "workload", "container").agg(F.min("ordinal").alias("ordinal"), text_at(*c, "name").alias("own"), text_at(*c, "image").alias("image"), F.transform(F.array_sort(F.collect_list(port)), lambda x: x["v"]).alias("ports"), F.array_sort(F.collect_list(part)).alias("parts"))
    said = lambda n: F.get(F.filter("parts", lambda p: (p["field"] == "value") & (p["item"] == n["item"])), F.lit(0))["value"]
    pairs = F.transform(F.filter("parts", lambda p: p["field"] == "name"), lambda n: F.struct(n["ordinal"].alias("ordinal"), n["value"].alias("k"), said(n).alias("v")))
    name = F.coalesce(F.nullif("workload", F.lit("")), F.nullif("own", F.lit("")), F.lit("unknown"))
    empty = F.array().cast("array<string>")
    out = out.withColumn("pairs", F.filter(pairs, lambda x: (x["k"] != "") & (x["v"] != "")))
    return out.select("project", "path", "ordinal", name.alias("name"), "image", "ports", _entries(F.col("pairs")).alias("environment"), empty.alias("depends_on"), empty.alias("volumes"))


def services(files: DataFrame) -> DataFrame:
    """All services of compose files and manifests."""
    return compose_services(files).unionByName(manifest_services(files))


def manifest_connections(files: DataFrame) -> DataFrame:
    """A connection for each target port of the Service objects in manifests: project, source, target, protocol, port,
    description."""
    docs = _manifests(files).where("of = 'Service'")
    kind = F.coalesce(F.nullif(text_of("spec", "type"), F.lit("")), F.lit("ClusterIP"))
    rows = docs.select("project", F.col("own_name").alias("name"), kind.alias("type"), F.inline("rows"))
    out = rows.where(at("spec", "ports", None, "targetPort") & (F.coalesce("value", F.lit("")) != "") & ~((F.col("kind") == "int") & (F.col("value") == "0"))).withColumnRenamed("value", "target_port")
    return out.select("project", F.concat(F.lit("k8s-service:"), F.coalesce("name", F.lit("undefined"))).alias("source"), F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown")).alias("target"), F.lit("tcp").alias("protocol"), F.col("target_port").try_cast("int").alias("port"), F.concat(F.lit("K8s "), F.col("type"), F.lit(" service → port "), F.col("target_port")).alias("description"))


def selected_workloads(files: DataFrame) -> DataFrame:
    """(project, service, workload): Service objects and the workloads whose pods have all labels of their selector. Labels
    are joined pair by pair; a workload is selected if as many pairs meet as the selector has. The labels are staged, so that
    both sides of the join come from one reading."""

    def labels(*keys: str | None) -> Column:
        own = F.filter("rows", lambda r: at(*keys, None, of=r["keys"]))
        return F.transform(own, lambda r: F.struct(F.get(r["keys"], F.lit(len(keys))).alias("k"), F.coalesce(r["value"], F.lit("")).alias("v")))

    own = F.when(F.col("of") == "Service", labels("spec", "selector")).otherwise(labels("spec", "template", "metadata", "labels"))
    docs = _manifests(files).where(F.col("of").isin("Service", *WORKLOADS))
    docs = staged(docs.select("project", "path", "document", "of", F.col("own_name").alias("name"), own.alias("labels")), "labels")
    wanted = docs.where("of = 'Service'").select("project", "path", "document", F.col("name").alias("service"), F.size("labels").alias("size"), F.inline("labels"))
    held = docs.where("of <> 'Service'").select("project", F.struct("path", "document").alias("of_workload"), F.col("name").alias("workload"), F.inline("labels"))
    met = wanted.join(held, ["project", "k", "v"]).groupBy("project", "path", "document", "service", "size", "of_workload", "workload").agg(F.count("*").alias("met"))
    return met.where("met = size").select("project", "service", "workload")
