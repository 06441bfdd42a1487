"""Registered queries over derived findings: algebra, scores, governance, dependencies and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.scalars import cvss_band, fingerprint, line_bucket, number_prefix
from gneiss.operators import deps as D
from gneiss.operators import exports as X
from gneiss.operators import findings as A
from gneiss.operators import policy as P
from gneiss.operators import scoring as S
from gneiss.operators.textscan import ROTATION, rotation_guide
from gneiss.plans.base import DEPS, FILES, FINDINGS, OLD, deps, files, findings, old_and_new, query, read
from gneiss.sources.corpus import explode_lines
from gneiss.streaming.streams import watch_changes

W = f"WITH {FINDINGS}"
TENTHS = "least(greatest(100 - {}, 0), 100) / 10"


@query("fingerprint", f"{W} SELECT id, fingerprint FROM findings")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("id", fingerprint().alias("fingerprint"))


@query("line_bucket", f"{W} SELECT line // 5 * 5 AS bucket, count(*) AS n FROM findings GROUP BY 1")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy(line_bucket("line").alias("bucket")).agg(F.count("*").alias("n"))


@query("dedup_most_severe", f"{W} SELECT file, line, category, arg_min(id, (rank, ordinal)) AS id, min(ordinal) AS position FROM findings GROUP BY file, line, category")
def dedup_most_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dedup(findings(spark, sf_dir)).select("file", "line", "category", "id", "position")


@query("severity_threshold", f"{W} SELECT severity, count(*) AS n FROM findings WHERE rank <= 1 GROUP BY severity")
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.at_least(findings(spark, sf_dir), "high").groupBy("severity").agg(F.count("*").alias("n"))


def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where("ordinal % 97 = 0").select("rule", "file", "line")


_SUPPRESSED = "(SELECT fingerprint FROM findings WHERE ordinal % 97 = 0)"


@query("suppress_stored", f"{W} SELECT id FROM findings WHERE fingerprint NOT IN {_SUPPRESSED}")
def suppress_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.filter_suppressed(findings(spark, sf_dir), suppressions(spark, sf_dir)).select("id")


@query("suppressed_stored", f"{W} SELECT id FROM findings WHERE fingerprint IN {_SUPPRESSED}")
def suppressed_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.suppressed(findings(spark, sf_dir), suppressions(spark, sf_dir)).select("id")


@query("suppress_inline", f"""WITH {FILES}, f AS (SELECT path AS file, line_no AS line, 'loser' AS rule FROM lines WHERE contains(line, 'the'))
SELECT f.file, f.line::BIGINT AS line FROM f JOIN lines own ON own.path = f.file AND own.line_no = f.line LEFT JOIN lines prev ON prev.path = f.file AND prev.line_no = f.line - 1
WHERE NOT contains(own.line, 'Licensed') AND NOT coalesce(contains(prev.line, 'Licensed') AND (contains(prev.line, 'loser') OR NOT contains(prev.line, ':')), false)""")  # fmt: skip
def suppress_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(files(spark, sf_dir))
    found = lines.where(F.contains("line", F.lit("the"))).select(F.col("path").alias("file"), F.col("line_no").alias("line"), F.lit("loser").alias("rule"))
    return A.filter_inline(found, lines, "Licensed").select("file", "line")


IGNORES = A.parse_ignores(["# kept for the record", "rule: r39", "f4*", "category:AF", "severity: info"])


@query("suppress_ignorefile", f"{W} SELECT id FROM findings WHERE NOT (contains(rule, 'r39') OR contains(file, 'f4') OR category = 'AF' OR severity = 'info')")
def suppress_ignorefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.filter_ignored(findings(spark, sf_dir), IGNORES).select("id")


_BASE = f"{W}, base AS (SELECT * FROM findings WHERE {OLD}), cur AS (SELECT fingerprint, arg_max(id, ordinal) AS id, min(ordinal) AS position FROM findings WHERE NOT ({OLD}) GROUP BY fingerprint)"


@query("baseline_new", f"{_BASE} SELECT * FROM cur WHERE fingerprint NOT IN (SELECT fingerprint FROM base)")
def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    return A.baseline_new(new, A.baseline_of(old)).select("fingerprint", "id", "position")


@query("baseline_fixed", f"{_BASE} SELECT rule, file, line FROM base WHERE fingerprint NOT IN (SELECT fingerprint FROM cur)")
def baseline_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    return A.baseline_fixed(new, A.baseline_of(old)).select("rule", "file", "line")


@query("baseline_unchanged", f"{_BASE} SELECT count(*) AS unchanged FROM cur WHERE fingerprint IN (SELECT fingerprint FROM base)")
def baseline_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    return A.baseline_unchanged(new, A.baseline_of(old))


@query("compare_only_a", f"{W} SELECT id FROM findings WHERE {OLD} AND fingerprint NOT IN (SELECT fingerprint FROM findings WHERE NOT ({OLD}))")
def compare_only_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.only_in(*old_and_new(spark, sf_dir)).select("id")


@query("compare_only_b", f"{W} SELECT id FROM findings WHERE NOT ({OLD}) AND fingerprint NOT IN (SELECT fingerprint FROM findings WHERE {OLD})")
def compare_only_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    return A.only_in(new, old).select("id")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verdicts for some findings; the later one counts."""
    f = findings(spark, sf_dir).where("ordinal % 3 = 0")
    one = f.select(F.col("id").alias("original_id"), (F.col("ordinal") % 2 == 0).alias("is_real"), F.when(F.col("ordinal") % 5 == 0, "critical").alias("adjusted_severity"), F.lit(1).alias("ordinal"))
    return one.unionByName(f.where("ordinal % 9 = 0").select(F.col("id").alias("original_id"), F.lit(True).alias("is_real"), F.lit("low").alias("adjusted_severity"), F.lit(2).alias("ordinal")))


_VERDICTS = f"{W}, v AS (SELECT DISTINCT id, CASE WHEN ordinal % 9 = 0 THEN true ELSE ordinal % 2 = 0 END AS real, CASE WHEN ordinal % 9 = 0 THEN 'low' WHEN ordinal % 5 = 0 THEN 'critical' END AS sev FROM findings WHERE ordinal % 3 = 0)"


@query("verdict_merge", f"{_VERDICTS} SELECT f.id, CASE WHEN v.real THEN coalesce(v.sev, f.severity) ELSE f.severity END AS severity, CASE WHEN v.real THEN 'high' ELSE f.confidence END AS confidence FROM findings f LEFT JOIN v ON v.id = f.id WHERE v.id IS NULL OR v.real")
def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.merge_verdicts(findings(spark, sf_dir), verdicts(spark, sf_dir)).select("id", "severity", "confidence")


@query("verdict_dismissed", f"{_VERDICTS} SELECT count(*) FILTER (NOT real) AS dismissed FROM v")
def verdict_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dismissed(findings(spark, sf_dir), verdicts(spark, sf_dir))


@query("chain_resolve", f"""{W}, m AS (SELECT o_orderkey AS position, unnest([0, 1, 2]) AS pos, o_orderkey * 8 + unnest([1, 2, 1]) AS k FROM orders),
r AS (SELECT m.position, m.pos, f.id FROM m JOIN (SELECT DISTINCT 'K' || (ordinal // 1000000000) AS id, ordinal // 1000000000 AS k FROM findings) f ON f.k = m.k)
SELECT 'CHAIN-' || CASE WHEN position + 1 < 1000 THEN lpad((position + 1)::VARCHAR, 3, '0') ELSE (position + 1)::VARCHAR END AS id, string_agg(id, ',' ORDER BY pos) AS members FROM r GROUP BY position HAVING count(*) >= 2""")  # fmt: skip
def chain_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"))
    pairs = F.array(*(F.struct(F.lit(p).alias("pos"), F.concat(F.lit("K"), (F.col("position") * 8 + k).cast("string")).alias("finding_id")) for p, k in ((0, 1), (1, 2), (2, 1))))
    members = chains.select("position", F.explode(pairs).alias("m")).select("position", "m.pos", "m.finding_id")
    found = findings(spark, sf_dir).select(F.concat(F.lit("K"), F.expr("ordinal div 1000000000").cast("string")).alias("id")).distinct()
    return A.resolve_chains(chains, members, found).select("id", F.array_join("members", ",").alias("members"))


_COUNTS = "count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low"


@query("severity_counts", f"{W} SELECT {_COUNTS}, count(*) FILTER (severity = 'info') AS info FROM findings")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.severity_counts(findings(spark, sf_dir))


@query("category_top", f"{W} SELECT category, count(*) AS n, ['critical', 'high', 'medium', 'low', 'info'][min(rank) + 1] AS top_severity, min(ordinal) AS first_seen FROM findings GROUP BY category")
def category_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.category_top(findings(spark, sf_dir))


@query("trust_score", f"{W} SELECT file, {TENTHS.format('sum(cost)::BIGINT')} AS trust_score FROM findings GROUP BY file")
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history_rows(findings(spark, sf_dir), "file").select("file", "trust_score")


@query("trust_score_chains", f"{W} SELECT {TENTHS.format('coalesce(sum(c), 0)::BIGINT')} AS trust_score FROM (SELECT cost AS c FROM findings UNION ALL SELECT CASE rank WHEN 0 THEN 15 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END FROM findings WHERE ordinal % 20011 = 0)")
def trust_score_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return S.trust_score(f, f.where("ordinal % 20011 = 0"))


@query("scorecard", f"""{W}, n AS (SELECT count(*) FILTER (rank = 0) AS c, count(*) FILTER (rank = 1) AS h, count(*) FILTER (rank = 2) AS m, count(*) FILTER (rank = 3) AS l, count(*) FILTER (k = 'secrets') AS s, count(*) FILTER (k = 'dependency') AS d, count(*) FILTER (k = 'iac') AS i
  FROM (SELECT rank, CASE category WHEN 'AF' THEN 'secrets' WHEN 'RF' THEN 'dependency' WHEN 'NO' THEN 'iac' ELSE '' END AS k FROM findings)),
p AS (SELECT round(greatest(30 - 10 * c - 5 * h - 2 * m - 0.5 * l, 0))::BIGINT AS code, greatest(20 - 10 * s, 0)::BIGINT AS secret_points, greatest(20 - 3 * d, 0)::BIGINT AS dependency_points, greatest(15 - 3 * i, 0)::BIGINT AS iac_points, 9::BIGINT AS tooling FROM n),
t AS (SELECT *, code + secret_points + dependency_points + iac_points + tooling AS total FROM p) SELECT *, CASE WHEN total >= 90 THEN 'A+' WHEN total >= 80 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 60 THEN 'C' WHEN total >= 50 THEN 'D' ELSE 'F' END AS grade FROM t""")  # fmt: skip
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("category") == "AF", "secrets").when(F.col("category") == "RF", "dependency").when(F.col("category") == "NO", "iac").otherwise("")
    return S.scorecard(findings(spark, sf_dir).withColumn("category", kind), True, 9)


_HISTORY = f"{W}, h AS (SELECT scan_id, {_COUNTS}, {TENTHS.format('sum(cost)::BIGINT')} AS trust_score FROM findings GROUP BY scan_id)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history_rows(findings(spark, sf_dir))


@query("history_rows", f"{_HISTORY} SELECT * FROM h")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir)


@query("changelog_delta", f"{_HISTORY} SELECT scan_id, total, trust_score, total - lag(total) OVER w AS total_delta, round((trust_score - lag(trust_score) OVER w) * 10) / 10 AS score_delta FROM h WINDOW w AS (ORDER BY scan_id)")
def changelog_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changelog(history(spark, sf_dir))


@query("first_vs_latest", f"{_HISTORY} SELECT arg_min(total, scan_id) AS first_total, arg_max(total, scan_id) AS latest_total, arg_min(trust_score, scan_id) AS first_score, arg_max(trust_score, scan_id) AS latest_score FROM h")
def first_vs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_and_latest(history(spark, sf_dir))


@query("last_n_scans", f"{_HISTORY} SELECT scan_id, total FROM h ORDER BY scan_id DESC LIMIT 30")
def last_n_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_scans(history(spark, sf_dir), 30).select("scan_id", "total")


@query("topk_severity", f"{W} SELECT id FROM findings ORDER BY rank, ordinal LIMIT 5")
def topk_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(findings(spark, sf_dir), 5).select("id")


@query("topk_severe_in_order", f"{W} SELECT id FROM findings WHERE rank <= 1 ORDER BY ordinal LIMIT 5")
def topk_severe_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(findings(spark, sf_dir), 5, severe_only=True).select("id")


@query("plan_phases", f"{W} SELECT id, (rank + 1)::BIGINT AS phase FROM findings WHERE rank <= 2 QUALIFY rank = 0 OR row_number() OVER (PARTITION BY rank ORDER BY ordinal) <= 10")
def plan_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_phases(findings(spark, sf_dir)).select("id", "phase")


@query("confidence_tiers", f"{W} SELECT count(*) FILTER (NOT false_positive AND ai_verified AND confidence = 'high') AS confirmed, count(*) FILTER (NOT false_positive AND NOT ai_verified AND confidence = 'high') AS likely, count(*) FILTER (NOT false_positive AND confidence <> 'high') AS possible, count(*) FILTER (false_positive) AS dismissed FROM findings")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.confidence_tiers(findings(spark, sf_dir))


@query("distinct_values", f"{W} SELECT string_agg(DISTINCT category, ',' ORDER BY category) AS category, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severity FROM findings")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.distinct_values(findings(spark, sf_dir), "category", "severity")
    return out.select(F.array_join("category", ",").alias("category"), F.array_join("severity", ",").alias("severity"))


@query("replay_scoreboard", f"{W}, c AS (SELECT rule, bool_or(rank = 0 AND category = 'NO') AS caught, count(*) % 2 = 0 AS clean_at_fix, rule < 'r2' AS require_catch FROM findings GROUP BY rule) SELECT count(*) AS total, count(*) FILTER (caught) AS caught, count(*) FILTER (clean_at_fix) AS fix_clean, count(*) FILTER (require_catch AND NOT caught) AS gated_failures FROM c")
def replay_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = findings(spark, sf_dir).groupBy("rule").agg(F.bool_or((F.col("severity") == "critical") & (F.col("category") == "NO")).alias("caught"), (F.count("*") % 2 == 0).alias("clean_at_fix")).withColumn("require_catch", F.col("rule") < "r2")
    return S.replay_scoreboard(cases)


@query("expected_found", f"""{W}, e AS (SELECT p_partkey AS case_id, (p_partkey % 60)::VARCHAR AS hint, 'r' || (p_partkey % 50) AS cls FROM part), f AS (SELECT DISTINCT file, rule FROM findings), k AS (SELECT DISTINCT hint, cls FROM e), c AS (SELECT hint, cls FROM k WHERE EXISTS (SELECT 1 FROM f WHERE suffix(f.file, k.hint) AND contains(f.rule, k.cls)))
SELECT case_id, (hint, cls) IN (SELECT (hint, cls) FROM c) AS caught FROM e""")  # fmt: skip
def expected_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("case"), (F.col("p_partkey") % 60).cast("string").alias("file_hint"), F.concat(F.lit("r"), (F.col("p_partkey") % 50).cast("string")).alias("rule_class"))
    return S.expected_found(e, findings(spark, sf_dir)).select(F.col("case").alias("case_id"), "caught")


def policy_rules(spark: SparkSession) -> DataFrame:
    rows = [
        ("strict", "no-critical", "block", "severity_threshold", "critical", None, None, None, None),
        ("strict", "open-items", "warn", "category_match", None, ["NO", "NO"], None, None, None),
        ("strict", "rule-three", "warn", "rule_match", None, None, ["r3", "r31"], None, None),
        ("strict", "many", "block", "count_threshold", None, None, None, 100, None),
        ("loose", "score", "block", "trust_score", None, None, None, None, None),
        ("loose", "too-many", "warn", "count_threshold", None, None, None, 1_000_000_000, None),
    ]
    return spark.createDataFrame(rows, "policy string, id string, action string, cond_type string, severity string, categories array<string>, rules array<string>, max_count int, min_score double")


_MATCHES = f"""{W}, t AS (SELECT count(*) AS n, {TENTHS.format('coalesce(sum(cost), 0)::BIGINT')} AS score FROM findings),
m AS (SELECT 'strict' AS policy, 'no-critical' AS rule_id, id FROM findings WHERE rank <= 0 UNION ALL SELECT 'strict', 'open-items', id FROM findings WHERE category = 'NO'
  UNION ALL SELECT 'strict', 'rule-three', id FROM findings WHERE starts_with(rule, 'r3') UNION ALL SELECT 'strict', 'many', id FROM findings, t WHERE n > 100
  UNION ALL SELECT 'loose', 'score', id FROM findings, t WHERE score < 7 UNION ALL SELECT 'loose', 'too-many', id FROM findings, t WHERE n > 1000000000)"""  # fmt: skip


@query("policy_matches", f"{_MATCHES} SELECT policy, rule_id, count(*) AS n FROM m GROUP BY policy, rule_id")
def policy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.policy_matches(findings(spark, sf_dir), policy_rules(spark)).groupBy("policy", "rule_id").agg(F.count("*").alias("n"))


@query("policy_verdict", f"{_MATCHES}, k AS (SELECT DISTINCT policy, rule_id FROM m), r(policy, rule_id, action) AS (VALUES ('strict', 'no-critical', 'block'), ('strict', 'open-items', 'warn'), ('strict', 'rule-three', 'warn'), ('strict', 'many', 'block'), ('loose', 'score', 'block'), ('loose', 'too-many', 'warn')) SELECT r.policy, count(k.policy) FILTER (action = 'block') AS blocked, count(k.policy) FILTER (action = 'warn') AS warned, count(k.policy) FILTER (action = 'block') = 0 AS passed FROM r LEFT JOIN k ON k.policy = r.policy AND k.rule_id = r.rule_id GROUP BY r.policy")
def policy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = policy_rules(spark)
    return P.policy_verdict(P.policy_matches(findings(spark, sf_dir), rules), rules)


def controls(spark: SparkSession) -> DataFrame:
    rows = [("one", "c1", ["AF", "RF"]), ("one", "c2", []), ("one", "c3", ["NO"]), ("two", "c1", ["XX"]), ("two", "c2", ["NO", "NO"])]
    return spark.createDataFrame(rows, "framework string, control_id string, categories array<string>")


_CONTROLS = f"""{W}, own AS (SELECT * FROM findings WHERE category <> 'AF' AND (category <> 'NO' OR rank > 1)), c(framework, control_id, cats) AS (VALUES ('one', 'c1', ['AF', 'RF']), ('one', 'c2', []::VARCHAR[]), ('one', 'c3', ['NO']), ('two', 'c1', ['XX']), ('two', 'c2', ['NO'])),
s AS (SELECT framework, control_id, count(f.id) AS findings, count(f.id) FILTER (rank <= 1) AS severe FROM c LEFT JOIN own f ON list_contains(c.cats, f.category) GROUP BY framework, control_id),
k AS (SELECT *, CASE WHEN findings = 0 THEN 'pass' WHEN severe > 0 THEN 'fail' ELSE 'partial' END AS status FROM s)"""  # fmt: skip


def _controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = findings(spark, sf_dir).where("category <> 'AF' and (category <> 'NO' or severity not in ('critical', 'high'))")
    return P.compliance_controls(own, controls(spark))


@query("compliance_report", f"{_CONTROLS} SELECT * FROM k")
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controlled(spark, sf_dir)


@query("compliance_rate", f"{_CONTROLS} SELECT framework, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, round(100.0 * count(*) FILTER (status = 'pass') / count(*))::BIGINT AS rate FROM k GROUP BY framework")
def compliance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compliance_rate(_controlled(spark, sf_dir))


@query("compliance_map", f"{W}, m(category, framework, control) AS (VALUES ('AF', 'x', '1.1'), ('AF', 'y', '7'), ('NO', 'x', '1.2')) SELECT framework, control, count(*) AS n FROM findings JOIN m USING (category) GROUP BY framework, control")
def compliance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame([("AF", "x", "1.1"), ("AF", "y", "7"), ("NO", "x", "1.2")], "category string, framework string, control string")
    return P.compliance_map(findings(spark, sf_dir), m)


@query("compliance_first_five", f"{_CONTROLS}, w AS (SELECT framework, control_id, unnest(cats) AS category FROM c SEMI JOIN (SELECT framework, control_id FROM k WHERE status = 'fail') z USING (framework, control_id)) SELECT framework, control_id, id FROM findings JOIN w USING (category) QUALIFY row_number() OVER (PARTITION BY framework, control_id ORDER BY ordinal) <= 5")
def compliance_first_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_of_failed(findings(spark, sf_dir), controls(spark), _controlled(spark, sf_dir)).select("framework", "control_id", "id")


@query("deps_dedup", f"WITH {DEPS} SELECT name, version, ecosystem, arg_min(lockfile, ordinal) AS lockfile FROM deps GROUP BY name, version, ecosystem")
def deps_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_deps(deps(spark, sf_dir)).select("name", "version", "ecosystem", "lockfile")


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.dedup_deps(deps(spark, sf_dir)).where("ordinal % 11 = 0")
    score = F.when(F.col("ordinal") % 4 == 0, "9.8").when(F.col("ordinal") % 4 == 1, "7.1/x").when(F.col("ordinal") % 4 == 2, "CVSS:3.1/AV:N").otherwise(F.lit(None))
    entry = F.struct(F.lit("CVSS_V3").alias("type"), score.alias("score"))
    return d.select(
        F.concat(F.lit("ADV-"), F.col("ordinal").cast("string")).alias("id"), F.lit("summary").alias("summary"), F.lit("details").alias("details"), F.when(score.isNotNull(), F.array(entry)).otherwise(F.array().cast("array<struct<type:string,score:string>>")).alias("severity"),
        "ecosystem", "name", "version", F.when(F.col("ordinal") % 8 == 3, "MODERATE").alias("db_severity"),
    )


_ADVISORIES = f"WITH {DEPS}, one AS (SELECT name, version, ecosystem, min(ordinal) AS o, arg_min(lockfile, ordinal) AS lockfile FROM deps GROUP BY name, version, ecosystem), adv AS (SELECT *, CASE o % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE CASE WHEN o % 8 = 3 THEN 'medium' ELSE 'high' END END AS severity FROM one WHERE o % 11 = 0)"


@query("deps_vulnerable", f"{_ADVISORIES} SELECT 'dep:ADV-' || o AS rule, severity, name || '@' || version AS snippet, lockfile AS file FROM adv")
def deps_vulnerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.vulnerable(D.dedup_deps(deps(spark, sf_dir)), advisories(spark, sf_dir)).select("rule", "severity", "snippet", "file")


@query("deps_by_ecosystem", f"{_ADVISORIES} SELECT one.ecosystem, count(*) AS total, count(*) FILTER (name || '@' || version IN (SELECT name || '@' || version FROM adv)) AS vulnerable FROM one GROUP BY one.ecosystem")
def deps_by_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.dedup_deps(deps(spark, sf_dir))
    return D.by_ecosystem(D.flag_vulnerable(d, D.vulnerable(d, advisories(spark, sf_dir))))


@query("license_class", f"WITH {DEPS} SELECT CASE WHEN license = '' THEN 'unknown' WHEN regexp_matches(license, 'MIT|ISC|BSD|Apache', 'i') THEN 'ok' WHEN regexp_matches(license, 'GPL|MPL-2.0', 'i') THEN 'copyleft' ELSE 'unknown' END AS license_class, count(*) AS n FROM deps GROUP BY 1")
def license_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.license_buckets(deps(spark, sf_dir))


@query("cvss_bands", "SELECT p_partkey, CASE WHEN s IS NULL THEN 'none' WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END AS band FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 100) / 10 END AS s FROM part)")
def cvss_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 7 == 0, "CVSS:3.1/AV:N").otherwise(F.concat((F.col("p_partkey") % 100 / 10).cast("string"), F.lit(" of 10")))
    score = number_prefix(text)
    return read(spark, sf_dir, "part").select("p_partkey", F.when(score.isNull(), "none").otherwise(cvss_band(score)).alias("band"))


@query("sbom_purl", f"WITH {DEPS} SELECT DISTINCT name, version, 'pkg:' || lower(ecosystem) || '/' || name || '@' || version AS purl FROM deps")
def sbom_purl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sbom_components(deps(spark, sf_dir)).select("name", "version", "purl").distinct()


@query("sbom_cyclonedx")
def sbom_cyclonedx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cyclonedx(D.dedup_deps(deps(spark, sf_dir)))


@query("sbom_spdx")
def sbom_spdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spdx(D.dedup_deps(deps(spark, sf_dir)), "parts")


@query("sarif_rules", f"{W} SELECT rule, min(ordinal) AS first_seen, arg_min(title, ordinal) AS title, arg_min(severity, ordinal) AS severity, ['error', 'error', 'warning', 'note', 'none'][arg_min(rank, ordinal) + 1] AS level FROM findings GROUP BY rule")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sarif_rules(findings(spark, sf_dir))


@query("sarif_results", f"{W} SELECT ordinal, rule AS \"ruleId\", ['error', 'error', 'warning', 'note', 'none'][rank + 1] AS level, title AS message, file AS uri, line AS \"startLine\", 1::BIGINT AS \"startColumn\" FROM findings")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sarif_results(findings(spark, sf_dir))


@query("sarif_report")
def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sarif(findings(spark, sf_dir).where("severity = 'critical' and category = 'RF'"))


@query("json_summary", f"{W} SELECT '{{\"total_findings\":' || count(*) || ',\"by_severity\":{{\"critical\":' || count(*) FILTER (rank = 0) || ',\"high\":' || count(*) FILTER (rank = 1) || ',\"medium\":' || count(*) FILTER (rank = 2) || ',\"low\":' || count(*) FILTER (rank = 3) || ',\"info\":' || count(*) FILTER (rank = 4) || '}}}}' AS json FROM findings")
def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.json_summary(findings(spark, sf_dir))


@query("csv_rows", """SELECT doc_id AS ordinal, 'D' || doc_id || ',low,' || CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',r,' || lang || ',,' || source || ',' || n_chars || ',,,' AS row FROM documents""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return X.csv_rows(d.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.lit("low").alias("severity"), F.col("text").alias("title"), F.lit("r").alias("rule"), F.col("lang").alias("category"), F.col("source").alias("file"), F.col("n_chars").alias("line")))


@query("tickets", f"{W} SELECT ordinal, '[' || upper(severity) || '] ' || title AS summary, ['Highest', 'High', 'Medium', 'Low', 'Lowest'][rank + 1] AS jira, [1, 2, 3, 4, 4][rank + 1]::BIGINT AS linear, CASE WHEN rank <= 1 THEN 'priority: high' ELSE 'priority: medium' END AS github FROM findings")
def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tickets(findings(spark, sf_dir))


@query("markdown_sections", f"{W} SELECT rank::BIGINT AS rank, severity, string_agg('- **' || title || '** `' || file || ':' || line || '`', chr(10) ORDER BY ordinal) AS body FROM findings GROUP BY rank, severity")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.markdown(findings(spark, sf_dir))


@query("notify_payload")
def notify_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.notify_payload(findings(spark, sf_dir))


@query("rotation_guide", f"{W} SELECT CASE WHEN ordinal % 2 = 0 THEN '{ROTATION['secret:github-pat']}' ELSE '{ROTATION['secret:database-url']}' END AS guide, count(*) AS n FROM findings GROUP BY 1".replace("account's", "account''s"))
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = findings(spark, sf_dir).withColumn("rule", F.when(F.col("ordinal") % 2 == 0, "secret:github-pat").otherwise("history:database-url"))
    return rotation_guide(named).groupBy("guide").agg(F.count("*").alias("n"))


@query("watch_diff", """WITH v AS (SELECT DISTINCT 'u' || (user_id % 50) AS file, event_id // 500 AS version, CASE WHEN event_type = 'error' THEN NULL ELSE event_type || (event_id % 3) END AS key FROM events),
n AS (SELECT file, version, row_number() OVER (PARTITION BY file ORDER BY version) AS nth FROM (SELECT DISTINCT file, version FROM v)), k AS (SELECT DISTINCT v.file, nth, key FROM v JOIN n ON n.file = v.file AND n.version = v.version WHERE key IS NOT NULL),
c AS (SELECT a.file, a.nth, a.key, 'new' AS change FROM k a ANTI JOIN k b ON b.file = a.file AND b.key = a.key AND b.nth = a.nth - 1 UNION ALL SELECT b.file, b.nth + 1, b.key, 'resolved' FROM k b ANTI JOIN k a ON b.file = a.file AND b.key = a.key AND b.nth = a.nth - 1)
SELECT c.file, n.version, c.key, c.change FROM c JOIN n ON n.file = c.file AND n.nth = c.nth""")  # fmt: skip
def watch_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    key = F.when(F.col("event_type") != "error", F.concat("event_type", (F.col("event_id") % 3).cast("string")))
    return watch_changes(e.select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("file"), F.expr("event_id div 500").alias("version"), key.alias("key"), F.lit("low").alias("severity")).distinct())
