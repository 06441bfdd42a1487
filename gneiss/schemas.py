"""Schemas of the tables that the operators exchange, as DDL texts, which every Spark reader takes."""

from __future__ import annotations

SEVERITIES = ("critical", "high", "medium", "low", "info")

FILES = "path string, content string, length bigint, lang string"
LINES = "path string, lang string, line_no int, line string"
FINDINGS = "id string, rule string, title string, description string, severity string, category string, file string, line int, `column` int, snippet string, cwe string, confidence string, ai_verified boolean, false_positive boolean, scan_id string, ordinal bigint"
RULES = "id string, title string, severity string, category string, cwe string, languages array<string>, patterns array<string>"
VERDICTS = "original_id string, is_real boolean, adjusted_severity string, ordinal bigint"
BASELINE = "rule string, file string, line int, severity string, title string, fingerprint string"
SUPPRESSIONS = "id string, rule string, file string, line int, reason string, suppressed_at string, suppressed_by string"
IGNORES = "kind string, value string"
POLICY_RULES = "policy string, id string, description string, action string, cond_type string, severity string, categories array<string>, rules array<string>, max_count int, min_score double, compliance array<string>"
CONTROLS = "framework string, control_id string, description string, categories array<string>"
DEPS = "name string, version string, ecosystem string, lockfile string"
ADVISORIES = "id string, summary string, details string, aliases array<string>, severity array<struct<type:string,score:string>>, ecosystem string, name string, version string, db_severity string"
EDGES = "caller string, callee string, file string, line int"
SERVICES = "name string, type string, image string, ports array<int>, environment map<string,string>, depends_on array<string>, volumes array<string>, file string"
RESPONSES = "payload_category string, payload_name string, payload_value string, detect_regex string, status int, elapsed_ms int, body string, location_header string"
LOG_LINES = "source string, line_no bigint, line string"
HISTORY = "ts timestamp, duration bigint, files_scanned int, total bigint, critical bigint, high bigint, medium bigint, low bigint, chains bigint, dismissed bigint, trust_score double"
