"""Registered queries of the graph operators over derived graphs, and of imports and endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import graph as G
from gneiss.plans.base import FINDINGS, findings, query, read
from gneiss.sources import changes, imports


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations call each other."""
    n = read(spark, sf_dir, "nation")
    step = F.explode(F.array(F.lit(1), F.lit(7)))
    return n.select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string"), F.lit(":n"), F.col("n_nationkey").cast("string")).alias("caller"), F.col("n_nationkey").alias("k"), step.alias("step")).select("caller", F.concat(F.lit("n"), ((F.col("k") + F.col("step")) % 25).cast("string")).alias("callee"), F.regexp_extract("caller", "^(f[0-9]+)", 1).alias("file"), F.col("step").alias("line"))


_CALLS = "calls AS (SELECT 'f' || n_regionkey || ':n' || n_nationkey AS caller, 'n' || ((n_nationkey + s) % 25) AS callee, 'f' || n_regionkey AS file, s::BIGINT AS line FROM nation, (VALUES (1), (7)) v(s))"
_FUNCS = "funcs AS (SELECT 'f' || n_regionkey AS path, 'n' || n_nationkey AS name FROM nation WHERE n_nationkey % 6 <> 5 UNION ALL SELECT 'f9', 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0)"
_IMPORTS = "imps AS (SELECT 'f' || n_regionkey AS file, 'n' || n_nationkey AS callee, 'f9:n' || n_nationkey AS via FROM nation WHERE n_nationkey % 8 = 0)"
_EDGES = f"""WITH {_CALLS}, {_FUNCS}, {_IMPORTS}, sole AS (SELECT name, min(path) AS path FROM (SELECT DISTINCT path, name FROM funcs) GROUP BY name HAVING count(*) = 1),
edges AS (SELECT caller, coalesce(i.via, l.path || ':' || l.name, o.path || ':' || o.name, 'external:' || c.callee) AS callee, c.file, c.line FROM calls c LEFT JOIN imps i ON i.file = c.file AND i.callee = c.callee LEFT JOIN (SELECT DISTINCT path, name FROM funcs) l ON l.path = c.file AND l.name = c.callee LEFT JOIN sole o ON o.name = c.callee)"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name")
    return n.where("n_nationkey % 6 <> 5").select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("path"), name).unionByName(n.where("n_nationkey % 4 = 0").select(F.lit("f9").alias("path"), name))


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").where("n_nationkey % 8 = 0")
    return n.select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("path"), F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("names"), F.lit("./f9").alias("source"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_calls(call_graph(spark, sf_dir), functions(spark, sf_dir), imported(spark, sf_dir))


@query("call_resolve", f"{_EDGES} SELECT * FROM edges")
def call_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("caller", "callee", "file", "line")


@query("callers", f"{_EDGES} SELECT * FROM edges WHERE ends_with(callee, ':n8')")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.callers(edges(spark, sf_dir), "n8").select("caller", "callee", "file", "line")


@query("callees", f"{_EDGES} SELECT * FROM edges WHERE ends_with(caller, ':n3')")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.callees(edges(spark, sf_dir), "n3").select("caller", "callee", "file", "line")


@query("trace_paths", """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + s) % 25 AS b FROM nation, (VALUES (1), (7)) v(s)), p AS (SELECT 0 AS node, [0] AS path UNION ALL SELECT e.b, list_append(p.path, e.b) FROM p JOIN e ON e.a = p.node WHERE len(p.path) <= 10 AND p.node <> 15 AND NOT list_contains(p.path, e.b))
SELECT array_to_string(path, '>') AS path FROM p WHERE node = 15""")  # fmt: skip
def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("caller"), F.explode(F.array(F.lit(1), F.lit(7))).alias("s"), "n_nationkey").select("caller", ((F.col("n_nationkey") + F.col("s")) % 25).cast("string").alias("callee"))
    return G.trace_paths(e, "0", "15").select(F.array_join("path", ">").alias("path"))


@query("taint_pairs", f"""WITH {FINDINGS}, s AS (SELECT file, line FROM findings WHERE rule = 'r1'), k AS (SELECT file, line FROM findings WHERE rule = 'r2') SELECT s.file, s.line AS source_line, k.line AS sink_line FROM s JOIN k ON k.file = s.file AND k.line > s.line""")
def taint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    s, k = f.where("rule = 'r1'").select("file", F.col("line").alias("source_line")), f.where("rule = 'r2'").select("file", F.col("line").alias("sink_line"))
    return s.join(k, "file").where("sink_line > source_line")


CODE = """const auth = require('passport');
router.get('/admin/users', (req, res) => {
  const id = req.query.id;
  db.query('select ' + id);
  res.send(escape(id));
});
app.post('/login', auth, (req, res) => {
  const url = req.body.url;
  res.redirect(url);
});
function helper(data) {
  eval(data);
}
"""


@query("code_graph")
def code_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, calls and taint of a small source file beside each page, by parsing; SQL has no counterpart."""
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("src/p"), "page_id", F.lit(".js")).alias("path"), F.lit(CODE).alias("content"), F.lit("javascript").alias("lang"))
    flows = G.taint_in_handlers(pages)
    return flows.groupBy("route", "source", "sink", "sanitized").agg(F.count("*").alias("n"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    route = F.element_at(F.array(*map(F.lit, ("/admin/users", "/health", "/items", "/payment/new", "//odd", "/public/a"))), (k % 6 + 1).cast("int"))
    return G.endpoints(c.select(F.concat(F.lit("f"), (k % 500).cast("string")).alias("path"), F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE"))), (k % 4 + 1).cast("int")).alias("method"), route.alias("route"), F.when(k % 5 == 0, "requireAuth, h").when(k % 7 == 0, "Passport.authenticate('jwt')").when(k % 11 == 0, "apiKey, session").otherwise("h").alias("handlers"), k.alias("line")))


_ENDPOINTS = """WITH c AS (SELECT c_custkey AS line, 'f' || (c_custkey % 500) AS path, ['GET', 'POST', 'PUT', 'DELETE'][c_custkey % 4 + 1] AS method, ['/admin/users', '/health', '/items', '/payment/new', '//odd', '/public/a'][c_custkey % 6 + 1] AS route,
  CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' WHEN c_custkey % 7 = 0 THEN 'JWT' WHEN c_custkey % 11 = 0 THEN 'Session' END AS auth_type FROM customer),
e AS (SELECT *, auth_type IS NOT NULL AS has_auth, route IN ('/health', '/public/a', '//odd') AS pub, regexp_matches(route, 'admin|user|payment') AS sens, method <> 'GET' AS wr, contains(route, 'admin') AS adm FROM c),
m AS (SELECT *, CASE WHEN NOT has_auth AND (wr OR sens) THEN 'high' WHEN adm THEN 'medium' WHEN NOT has_auth THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN NOT has_auth AND wr THEN method || ' endpoint without authentication' WHEN NOT has_auth AND sens THEN 'Sensitive path ''' || route || ''' without authentication' WHEN adm THEN 'Admin endpoint — verify authorization checks' END AS why FROM e)"""


@query("endpoint_risk", f"{_ENDPOINTS} SELECT line, has_auth, auth_type, pub AS public, risk, why AS risk_reason FROM m")
def endpoint_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints(spark, sf_dir).select("line", "has_auth", "auth_type", "public", "risk", "risk_reason")


@query("endpoint_unprotected", f"{_ENDPOINTS} SELECT line FROM m WHERE NOT has_auth AND NOT pub AND sens")
def endpoint_unprotected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unprotected(endpoints(spark, sf_dir)).select("line")


@query("endpoint_assessment", f"{_ENDPOINTS} SELECT count(*) AS total, count(*) FILTER (has_auth) AS with_auth, count(*) FILTER (NOT has_auth) AS without_auth, count(*) FILTER (risk = 'high') AS high_risk, coalesce(round(100.0 * count(*) FILTER (has_auth) / nullif(count(*), 0))::BIGINT, 100) AS auth_percent FROM m")
def endpoint_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.endpoint_assessment(endpoints(spark, sf_dir))


@query("endpoint_findings", f"{_ENDPOINTS}, {FINDINGS}, n AS (SELECT file, count(*) AS n FROM findings GROUP BY file) SELECT line, coalesce(n.n, 0) AS findings FROM m LEFT JOIN n ON n.file = m.path")
def endpoint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.endpoint_findings(endpoints(spark, sf_dir), findings(spark, sf_dir)).select("line", "findings")


@query("threat_model", f"{_ENDPOINTS} SELECT 'spoofing' AS threat, method, route FROM m WHERE NOT has_auth AND risk = 'high' UNION ALL SELECT 'tampering', method, route FROM m WHERE method IN ('POST', 'PUT')")
def threat_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.threat_model(endpoints(spark, sf_dir))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = F.concat(F.lit("svc-"), F.lpad(k.cast("string"), 2, "0"))
    other = F.concat(F.lit("svc-"), F.lpad(((k * 3 + 1) % 25).cast("string"), 2, "0"))
    value = F.when(k % 3 == 0, F.concat(F.lit("http://"), other, F.lit(":80"))).when(k % 3 == 1, F.lit("postgres://u:p@db.example.org:5432/x")).otherwise(F.lit("plain"))
    return n.select(name.alias("name"), F.when(k % 4 == 0, "postgres:16").otherwise("app").alias("image"), F.when(k % 6 == 0, F.array(F.lit(80), F.lit(5432))).when(k % 2 == 0, F.array(F.lit(80))).otherwise(F.array().cast("array<int>")).alias("ports"), F.create_map(F.lit("URL"), value).alias("environment"), F.when(k % 5 == 0, F.array(other)).otherwise(F.array().cast("array<string>")).alias("depends_on"))


_SERVICES = "WITH s AS (SELECT n_nationkey AS k, 'svc-' || lpad(n_nationkey::VARCHAR, 2, '0') AS name, 'svc-' || lpad(((n_nationkey * 3 + 1) % 25)::VARCHAR, 2, '0') AS other FROM nation)"


@query("service_edges", f"{_SERVICES} SELECT name AS source, other AS target, 'depends' AS kind FROM s WHERE k % 5 = 0 UNION ALL SELECT name, other, 'environment' FROM s WHERE k % 3 = 0 AND name <> other UNION ALL SELECT name, 'db.example.org', 'external' FROM s WHERE k % 3 = 1")
def service_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.service_edges(services(spark, sf_dir))


@query("trust_boundaries", f"""{_SERVICES}, p AS (SELECT *, k % 2 = 0 AS open, k % 4 = 0 AS store FROM s),
r AS (SELECT name, 1 AS z, CASE WHEN k % 6 = 0 THEN name || ' exposes sensitive port(s): 80, 5432' END AS risk FROM p WHERE open UNION ALL SELECT name, 2, NULL FROM p WHERE NOT open UNION ALL SELECT name, 3, CASE WHEN open THEN name || ' database port exposed publicly' END FROM p WHERE store)
SELECT ['Public-facing services', 'Internal services', 'Data layer'][z] AS boundary, ['public', 'internal', 'private'][z] AS exposure, string_agg(name, ',' ORDER BY name) AS services, coalesce(string_agg(risk, ';' ORDER BY name), '') AS risks FROM r GROUP BY z""")
def trust_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.trust_boundaries(services(spark, sf_dir)).select("boundary", "exposure", F.array_join("services", ",").alias("services"), F.array_join("risks", ";").alias("risks"))


@query("band_overlap", f"WITH {FINDINGS}, m AS (SELECT file, line AS a, line + 3 AS b FROM findings WHERE rule = 'r5'), t AS (SELECT 'f' || (p_partkey % 600) AS file, p_partkey % 200 AS first, p_partkey % 200 + 5 AS last, p_partkey FROM part) SELECT p_partkey, EXISTS (SELECT 1 FROM m WHERE m.file = t.file AND m.a <= t.last AND m.b >= t.first) AS caught FROM t")
def band_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = findings(spark, sf_dir).where("rule = 'r5'").select("file", F.col("line").alias("start_line"), (F.col("line") + 3).alias("end_line"))
    k = F.col("p_partkey")
    t = read(spark, sf_dir, "part").select(F.concat(F.lit("f"), (k % 600).cast("string")).alias("file"), (k % 200).alias("first"), (k % 200 + 5).alias("last"), k)
    return G.band_overlap(m, t).select("p_partkey", "caught")


@query("changed_files", "WITH l AS (SELECT event_id AS o, user_id % 40 AS p, CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status FROM events), f AS (SELECT p, arg_min(status, o) AS status FROM l GROUP BY p) SELECT 'p' || p AS path, status FROM f WHERE status <> 'deleted'")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("A"), F.lit("D"), F.lit("M")), (F.col("event_id") % 3 + 1).cast("int"))
    lines = read(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.concat(code, F.lit("\tp"), (F.col("user_id") % 40).cast("string")).alias("line"))
    return changes.changed_files(lines)


@query("history_fill", "WITH l AS (SELECT event_id AS o, user_id % 10 AS h, CASE WHEN event_type = 'click' THEN event_id % 9 END AS f FROM events), x AS (SELECT o, h, f, last_value(f IGNORE NULLS) OVER (PARTITION BY h ORDER BY o) AS g FROM l) SELECT h::VARCHAR AS hash, o AS ordinal, 'f' || g AS file FROM x WHERE f IS NULL")
def history_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("+++ b/f"), (F.col("event_id") % 9).cast("string"))).otherwise("+x")
    diff = read(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("string").alias("hash"), F.col("event_id").alias("ordinal"), line.alias("line"))
    return changes.added_lines(diff).select("hash", "ordinal", "file")


@query("import_semgrep", "SELECT 'pkg.rule' || (doc_id % 7) AS rule, 'rule' || (doc_id % 7) AS title, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'medium' END AS severity, source AS file, doc_id AS line FROM documents")
def import_semgrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    level = F.element_at(F.array(*map(F.lit, ("ERROR", "WARNING", "INFO", "OTHER"))), (F.col("doc_id") % 4 + 1).cast("int"))
    result = F.struct(F.concat(F.lit("pkg.rule"), (F.col("doc_id") % 7).cast("string")).alias("check_id"), F.col("source").alias("path"), F.struct(F.col("doc_id").alias("line")).alias("start"), F.struct(level.alias("severity")).alias("extra"))
    reports = d.select(F.concat(F.lit("r"), "doc_id").alias("path"), F.to_json(F.struct(F.array(result).alias("results"))).alias("content"))
    return imports.import_reports(reports).select("rule", "title", "severity", "file", "line")


@query("calibration", """WITH c AS (SELECT 'G' || p_partkey AS "case", CASE WHEN p_partkey % 2 = 0 THEN 'C' || p_partkey ELSE 'G' || p_partkey END AS alias, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'a.py' ELSE 'a.ts' END AS file, p_partkey % 50 AS first, p_partkey % 50 + 4 AS last, p_partkey AS k FROM part),
r AS (SELECT *, CASE WHEN file IS NULL THEN 'case has no calibration_target' WHEN k % 3 = 0 AND NOT k % 6 = 0 THEN 'no A1 seed pattern for ' || alias WHEN file = 'a.py' THEN 'unsupported language for file a.py' END AS skip_reason FROM c),
m AS (SELECT l_partkey AS k, l_linenumber * 9 AS a, l_linenumber * 9 + 2 AS b FROM lineitem), n AS (SELECT r.k, count(*) AS total, count(*) FILTER (m.a <= r.last AND m.b >= r.first) AS overlapping FROM r JOIN m ON m.k = r.k WHERE skip_reason IS NULL GROUP BY r.k)
SELECT "case", alias, file, coalesce(total, 0) AS total, coalesce(overlapping, 0) AS overlapping, coalesce(overlapping, 0) > 0 AS matched, skip_reason FROM r LEFT JOIN n ON n.k = r.k""")  # fmt: skip
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are known by name or, for every sixth case, by alias."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(F.lit("G"), k.cast("string"))
    alias = F.when(k % 2 == 0, F.concat(F.lit("C"), k.cast("string")))
    file = F.when(k % 5 == 0, None).when(k % 7 == 0, "a.py").otherwise("a.ts")
    cases = p.select(name.alias("case"), alias.alias("alias"), file.alias("file"), (k % 50).alias("first"), (k % 50 + 4).alias("last"))
    seeds = p.where(k % 3 != 0).select(name.alias("case")).union(p.where(k % 6 == 0).select(alias))
    at = F.col("l_linenumber") * 9
    matches = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("case"), at.alias("start_line"), (at + 2).alias("end_line"))
    return G.calibrate(cases, seeds, matches).drop("first", "last")
