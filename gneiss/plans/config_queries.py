"""Registered queries of YAML files: scalars, policies, custom rules, services of compose files and manifests.

The driver's tables have no such files: each row of `documents` is written as one, in several shapes, read by the library
and compared with what the row holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import graph as G
from gneiss.operators import policy as P
from gneiss.plans.base import findings, query, read
from gneiss.plans.finding_queries import _MATCHES
from gneiss.sources import configs
from gneiss.sources.stores import staged
from gneiss.sources.yamlfiles import scalars


def written(spark: SparkSession, sf_dir: str, path: str, *shapes: str) -> DataFrame:
    """files(project, path, content): for each document the shape that doc_id % len(shapes) names, with {id}, {m} (doc_id % 7),
    {next} (doc_id % 7 + 1) and {lang} filled in."""
    d = read(spark, sf_dir, "documents").where("doc_id is not null")
    shape = F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % len(shapes) + 1).cast("int"))
    fields = {"id": F.col("doc_id").cast("string"), "m": (F.col("doc_id") % 7).cast("string"), "next": (F.col("doc_id") % 7 + 1).cast("string"), "lang": F.coalesce("lang", F.lit("en"))}

    def filled(text: Column) -> Column:
        for k, v in fields.items():
            text = F.replace(text, F.lit(f"{{{k}}}"), v)
        return text

    return d.select(F.concat(F.lit("p"), fields["id"]).alias("project"), filled(F.lit(path)).alias("path"), filled(shape).alias("content"))


D = "d AS (SELECT doc_id AS id, doc_id % 7 AS m, doc_id % 7 + 1 AS next, coalesce(lang, 'en') AS lang FROM documents WHERE doc_id IS NOT NULL)"

BLOCKS = """# file {id}
name: "doc {id}\\tx"   # a note
list:
- {m}
- 'it''s {lang}'
-   - [a, "{lang}", {x: {id}}]
    - ~
nested: {deep: {k: [1, 2.5]}, "q: r": yes, none: }
base: &base
  a: {id}
  b: true
merged:
  <<: *base
  b: false
text: |
  line {id}
    more

folded: >-
  one
  two

  three {lang}
plain: a plain
  scalar#of {lang} # not this
empty: {}
"""
DOCUMENTS = """---
kind: {lang}
---
- key: {id}
  other: [ 'x', # note
    {a: b}, y ]
- - 0x1f
  - -1.5e3
...
"""
BROKEN = "name: {id}\nlist: [1, 2\n"
_SCALARS = f"""WITH {D}, r AS (
SELECT id, unnest([{{document: 0, keys: 'name', kind: 'str', v: 'doc ' || id || chr(9) || 'x'}}, {{document: 0, keys: 'list/[0]', kind: 'int', v: m::VARCHAR}}, {{document: 0, keys: 'list/[1]', kind: 'str', v: 'it''s ' || lang}},
  {{document: 0, keys: 'list/[2]/[0]/[0]', kind: 'str', v: 'a'}}, {{document: 0, keys: 'list/[2]/[0]/[1]', kind: 'str', v: lang}}, {{document: 0, keys: 'list/[2]/[0]/[2]/x', kind: 'int', v: id::VARCHAR}}, {{document: 0, keys: 'list/[2]/[1]', kind: 'null', v: NULL}},
  {{document: 0, keys: 'nested/deep/k/[0]', kind: 'int', v: '1'}}, {{document: 0, keys: 'nested/deep/k/[1]', kind: 'float', v: '2.5'}}, {{document: 0, keys: 'nested/q: r', kind: 'str', v: 'yes'}}, {{document: 0, keys: 'nested/none', kind: 'null', v: NULL}},
  {{document: 0, keys: 'base/a', kind: 'int', v: id::VARCHAR}}, {{document: 0, keys: 'base/b', kind: 'bool', v: 'true'}}, {{document: 0, keys: 'merged/b', kind: 'bool', v: 'false'}}, {{document: 0, keys: 'merged/a', kind: 'int', v: id::VARCHAR}},
  {{document: 0, keys: 'text', kind: 'str', v: 'line ' || id || chr(10) || '  more' || chr(10)}}, {{document: 0, keys: 'folded', kind: 'str', v: 'one two' || chr(10) || 'three ' || lang}}, {{document: 0, keys: 'plain', kind: 'str', v: 'a plain scalar#of ' || lang}}, {{document: 0, keys: 'empty', kind: 'map', v: NULL}}], recursive := true) FROM d WHERE id % 3 = 0
UNION ALL SELECT id, unnest([{{document: 0, keys: 'kind', kind: 'str', v: lang}}, {{document: 1, keys: '[0]/key', kind: 'int', v: id::VARCHAR}}, {{document: 1, keys: '[0]/other/[0]', kind: 'str', v: 'x'}}, {{document: 1, keys: '[0]/other/[1]/a', kind: 'str', v: 'b'}}, {{document: 1, keys: '[0]/other/[2]', kind: 'str', v: 'y'}},
  {{document: 1, keys: '[1]/[0]', kind: 'int', v: '0x1f'}}, {{document: 1, keys: '[1]/[1]', kind: 'float', v: '-1.5e3'}}], recursive := true) FROM d WHERE id % 3 = 1)
SELECT 'f' || id AS path, document::BIGINT AS document, keys, kind, v AS value FROM r"""


@query("yaml_scalars", _SCALARS)
def yaml_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars(written(spark, sf_dir, "f{id}", BLOCKS, DOCUMENTS, BROKEN)).select("path", "document", F.array_join("keys", "/").alias("keys"), "kind", "value")


POLICY = """name: p{id}
description: any
rules:
  # a comment
  - id: no-{lang}
    description: "none of {lang}"
    action: block
    condition: {type: severity_threshold}
    compliance: [A, B]
  - id: many
    description: more than {m}
    action: note
    condition:
      type: count_threshold
      maxCount: {m}
  - id: some
    description: some
    action: warn
    condition:
      type: category_match
      categories:
      - c{m}
      - c{next}
"""
_POLICIES = f"""WITH {D}, r AS (SELECT id, unnest([
  {{ordinal: 0, rule: 'no-' || lang, action: 'block', cond_type: 'severity_threshold', severity: 'critical', categories: '', max_count: NULL, compliance: 'A,B'}},
  {{ordinal: 1, rule: 'many', action: 'warn', cond_type: 'count_threshold', severity: 'critical', categories: '', max_count: m::DOUBLE, compliance: ''}},
  {{ordinal: 2, rule: 'some', action: 'warn', cond_type: 'category_match', severity: 'critical', categories: 'c' || m || ',c' || next, max_count: NULL, compliance: ''}}], recursive := true) FROM d WHERE id % 5 = 0)
SELECT 'p' || id AS policy, ordinal::BIGINT AS ordinal, rule, action, cond_type, severity, categories, max_count, compliance FROM r"""


@query("policy_files", _POLICIES)
def policy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of five files is a policy: the others lack a description, have an id that is a number, two documents, or no list."""
    bad = (POLICY.replace("    description: some\n", ""), POLICY.replace("id: some", "id: {m}"), POLICY + "---\nname: x\n", "name: x\nrules:\n  a: {id: b}\n")
    rules = configs.policies(written(spark, sf_dir, "f{id}", POLICY, *bad))
    return rules.select("policy", "ordinal", F.col("id").alias("rule"), "action", "cond_type", "severity", F.array_join("categories", ",").alias("categories"), "max_count", F.array_join("compliance", ",").alias("compliance"))


POLICIES = ("""name: strict
rules:
- {id: no-critical, description: d, action: block, condition: {type: severity_threshold, severity: critical}}
- id: open-items
  description: >
    all that
    is open
  action: warn
  condition: {type: category_match, categories: ["NO", 'NO']}
- {id: rule-three, description: "d: e", action: warn, condition: {type: rule_match, rules: [r3, r31]}}
- {id: many, description: d, action: block, condition: {type: count_threshold, maxCount: 100}}
""", """---
name: loose
rules:
  -
    id: score
    description: d
    action: block
    condition:
      type: trust_score
  - id: too-many
    description: d
    action: warn
    condition: {
      type: count_threshold, maxCount: 1000000000 }
""")  # fmt: skip


@query("policy_gate", f"{_MATCHES}, k AS (SELECT DISTINCT policy, rule_id FROM m), r(policy, rule_id, action) AS (VALUES ('strict', 'no-critical', 'block'), ('strict', 'open-items', 'warn'), ('strict', 'rule-three', 'warn'), ('strict', 'many', 'block'), ('loose', 'score', 'block'), ('loose', 'too-many', 'warn')) SELECT r.policy, count(k.policy) FILTER (action = 'block') AS blocked, count(k.policy) FILTER (action = 'warn') AS warned, count(k.policy) FILTER (action = 'block') = 0 AS passed FROM r LEFT JOIN k ON k.policy = r.policy AND k.rule_id = r.rule_id GROUP BY r.policy")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings through the policies of two YAML files."""
    rules = configs.policies(spark.createDataFrame([(f"{i}.yml", p) for i, p in enumerate(POLICIES)], "path string, content string"))
    return P.policy_verdict(P.policy_matches(findings(spark, sf_dir), rules), rules)


RULES = ("""- id: r{id}
  title: Rule {m}
  severity: high
  cwe: CWE-{m}
  languages: [typescript, {lang}]
  patterns:
    - pattern: 'a{m}\\s*='
    - {type: ast, pattern: none}
    - type: regex
      pattern: "b: {lang}"
- title: no id
  patterns: [{pattern: x}]
""", """rules:
  - {id: r{id}, patterns: [{pattern: x}]}
  - {id: s{id}, patterns: none}
""", "id: r{id}\nseverity:\npatterns:\n- pattern: y{m}\n", "id: r{id}\n\tpatterns: []\n")  # fmt: skip
_RULES = f"""WITH {D} SELECT 'f' || id AS path, 0::BIGINT AS ordinal, 'r' || id AS id, CASE WHEN id % 4 = 0 THEN 'Rule ' || m ELSE 'r' || id END AS title, CASE WHEN id % 4 = 0 THEN 'high' ELSE 'medium' END AS severity, 'custom' AS category,
CASE WHEN id % 4 = 0 THEN 'CWE-' || m END AS cwe, CASE WHEN id % 4 = 0 THEN 'typescript,' || lang ELSE '*' END AS languages, ['a' || m || '\\s*=;b: ' || lang, 'x', 'y' || m][id % 4 + 1] AS patterns FROM d WHERE id % 4 < 3"""


@query("custom_rule_files", _RULES)
def custom_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.custom_rules(written(spark, sf_dir, "f{id}", *RULES)).withColumns({"languages": F.array_join("languages", ","), "patterns": F.array_join("patterns", ";")})


COMPOSE = ("""version: "3.8"
services:
  web:
    image: app:{m}
    ports: ["80{m}:80", "443", 127.0.0.1:5432:5432]
    environment:
      - DB_URL=postgres://store:5432/{lang}?a=b
      - HOOK=https://h{m}.example.org:8443/x
      - EMPTY
    depends_on: [store]
    volumes:
      - ./a:/a
  store:
    image: postgres:16
    ports:
      - 5432:5432
      - target: 1
    environment:
      POSTGRES_PASSWORD: password{m}
      PEER:
    depends_on: {}
""", """services:
  job:
    depends_on:
      queue: {condition: started}
      web: {}
    environment: {RABBIT_HOST: "amqp://queue", N: 5}
  queue: {image: rabbit}
  gone:
  web: {}
""", "services: {}\n")  # fmt: skip
MANIFEST = """apiVersion: apps/v1
kind: Deployment
metadata: {name: api-{m}}
spec:
  template:
    metadata:
      labels: {app: api, tier: t{m}, extra: x}
    spec:
      containers:
      - name: main
        image: api:{id}
        ports:
        - containerPort: 8080
        - name: metrics
          containerPort: 90{m}
        env:
        - {name: REDIS_URL, value: "redis://cache:6379"}
        - name: SECRET
          valueFrom: {secretKeyRef: {name: s, key: k}}
      - image: side
---
apiVersion: v1
kind: Service
metadata:
  name: front
spec:
  type: LoadBalancer
  selector:
    app: api
    tier: t{m}
  ports:
  - port: 80
    targetPort: 8080
  - {port: 81, targetPort: http}
  - port: 82
---
---
kind: Service
metadata: {name: other}
spec: {selector: {app: api, tier: other}, ports: [{targetPort: 1}]}
---
kind: StatefulSet
metadata: {name: cache}
spec: {template: {spec: {containers: [{image: redis}]}}}
"""


def infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compose file for each project, and a manifest for those of even ids; other paths aren't looked at."""
    even = F.regexp_extract("project", r"\d+", 0).cast("long") % 2 == 0
    manifest = written(spark, sf_dir, "k8s/sub/app.yaml", MANIFEST).where(even)
    aside = written(spark, sf_dir, "sub/compose.yml", COMPOSE[0])
    return written(spark, sf_dir, "docker-compose.yml", *COMPOSE).unionByName(manifest).unionByName(aside)


_SERVICES = f"""WITH {D}, s AS (
SELECT id, unnest([{{name: 'web', image: 'app:' || m, ports: '80,5432', env: 'DB_URL=postgres://store:5432/' || lang || '?a=b;EMPTY=;HOOK=https://h' || m || '.example.org:8443/x', needs: 'store', volumes: './a:/a'}}, {{name: 'store', image: 'postgres:16', ports: '5432', env: 'PEER=;POSTGRES_PASSWORD=password' || m, needs: '', volumes: ''}}], recursive := true) FROM d WHERE id % 3 = 0
UNION ALL SELECT id, unnest([{{name: 'job', image: NULL, ports: '', env: 'N=5;RABBIT_HOST=amqp://queue', needs: 'queue,web', volumes: ''}}, {{name: 'queue', image: 'rabbit', ports: '', env: '', needs: '', volumes: ''}}], recursive := true) FROM d WHERE id % 3 = 1
UNION ALL SELECT id, unnest([{{name: 'api-' || m, image: 'api:' || id, ports: '8080,90' || m, env: 'REDIS_URL=redis://cache:6379', needs: '', volumes: ''}}, {{name: 'api-' || m, image: 'side', ports: '', env: '', needs: '', volumes: ''}}, {{name: 'cache', image: 'redis', ports: '', env: '', needs: '', volumes: ''}}], recursive := true) FROM d WHERE id % 2 = 0)"""


@query("service_files", f"{_SERVICES} SELECT 'p' || id AS project, name, image, ports, env, needs, volumes FROM s")
def service_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = F.array_join(F.array_sort(F.transform(F.map_entries("environment"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return configs.services(infrastructure(spark, sf_dir)).select("project", "name", "image", F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports"), env.alias("env"), F.array_join("depends_on", ",").alias("needs"), F.array_join("volumes", ",").alias("volumes"))


@query("service_connections", f"""{_SERVICES}, c AS (
SELECT id, name AS source, unnest(string_split(needs, ',')) AS target, 'tcp' AS protocol, NULL::BIGINT AS port, 'depends on ' AS how, '' AS via FROM s WHERE needs <> ''
UNION ALL SELECT id, 'web', 'store', 'tcp', NULL, 'references ', ' via DB_URL' FROM d WHERE id % 3 = 0
UNION ALL SELECT id, 'web', 'h' || m || '.example.org', 'https', NULL, 'connects to external ', ' via HOOK' FROM d WHERE id % 3 = 0
UNION ALL SELECT id, 'job', 'queue', 'amqp', NULL, 'references ', ' via RABBIT_HOST' FROM d WHERE id % 3 = 1
UNION ALL SELECT id, 'api-' || m, 'cache', 'redis', NULL, 'references ', ' via REDIS_URL' FROM d WHERE id % 2 = 0)
SELECT 'p' || id AS project, source, target, protocol, port, source || ' ' || how || target || via AS description FROM c
UNION ALL SELECT 'p' || id, 'k8s-service:front', 'front', 'tcp', 8080, 'K8s LoadBalancer service → port 8080' FROM d WHERE id % 2 = 0
UNION ALL SELECT 'p' || id, 'k8s-service:front', 'front', 'tcp', NULL, 'K8s LoadBalancer service → port http' FROM d WHERE id % 2 = 0
UNION ALL SELECT 'p' || id, 'k8s-service:other', 'other', 'tcp', 1, 'K8s ClusterIP service → port 1' FROM d WHERE id % 2 = 0""")
def service_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = staged(configs.parsed(infrastructure(spark, sf_dir)), "config-documents")
    own = G.inferred_connections(staged(configs.services(files), "services")).withColumn("port", F.lit(None).cast("int"))
    return own.unionByName(configs.manifest_connections(files)).select("project", "source", "target", "protocol", "port", "description")


@query("selected_workloads", f"WITH {D} SELECT 'p' || id AS project, 'front' AS service, 'api-' || m AS workload FROM d WHERE id % 2 = 0")
def selected_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.selected_workloads(infrastructure(spark, sf_dir))
