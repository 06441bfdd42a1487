"""Registered queries of the scan modes, over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions.deep_rules import DEEP
from gneiss.functions.scalars import entropy, mask_secret
from gneiss.operators import modes, textscan
from gneiss.operators.findings import scan, with_ids
from gneiss.operators.modes import Family, Rule
from gneiss.plans.base import FILES, files, query, read
from gneiss.sources.corpus import explode_lines, for_language, select_paths, size_cap

#: The corpus rules' patterns, spelled for SQL.
CORPUS_SQL = [(i, j, r.id, p.replace("'", "''")) for i, r in enumerate(R.CORPUS.rules) for j, p in enumerate(r.patterns)]
_RULES = "rules(rule_ord, pattern_ord, rule, rx) AS (VALUES " + ", ".join(f"({i}, {j}, '{r}', '{p}')" for i, j, r, p in CORPUS_SQL) + ")"
M1 = f"""WITH {FILES}, {_RULES},
hits AS (SELECT path, line_no AS line, rule_ord, pattern_ord, rule, l.line AS text FROM lines l JOIN rules ON regexp_matches(l.line, rx, 'i'))"""


@query("m1_line_any", f"{M1} SELECT path AS file, rule, pattern_ord::BIGINT AS pattern_ord, line::BIGINT AS line FROM hits")
def m1_line_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.findings(files(spark, sf_dir), R.CORPUS).select("file", "rule", "pattern_ord", "line")


@query("m1_rule_join", f"{M1} SELECT rule, count(*) AS n FROM hits GROUP BY rule")
def m1_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([(r.id, p) for r in R.CORPUS.rules for p in r.patterns], "rule string, regex string")
    return modes.rule_join(explode_lines(files(spark, sf_dir)), table).groupBy("rule").agg(F.count("*").alias("n"))


M2 = Family("", "M2", (Rule("token-near-license", "Token far from a license", "high", (r"(token|secret) ?[:=] ?[\"'][a-z0-9]+",), window=(-2, 2), mitigation=r"licensed|reserved"), Rule("the-line", "Line that starts with The", "low", (r"^the ",), window=(0, 4), mitigation=r"idiot|scum|loser")), cap=None)
_AROUND = "array_to_string(all_lines[greatest(1, line_no + {lo}):line_no + {hi}], chr(10))"


@query("m2_window_mitigated", f"""WITH {FILES}, w AS (SELECT l.path, l.line_no, l.line, string_split(f.content, chr(10)) AS all_lines FROM lines l JOIN files f ON f.path = l.path)
SELECT path, 0::BIGINT AS rule_ord, line_no::BIGINT AS line FROM w WHERE regexp_matches(line, '(token|secret) ?[:=] ?["''][a-z0-9]+', 'i') AND NOT regexp_matches({_AROUND.format(lo=-2, hi=2)}, 'licensed|reserved', 'i')
UNION ALL SELECT path, 1::BIGINT, line_no::BIGINT FROM w WHERE regexp_matches(line, '^the ', 'i') AND NOT regexp_matches({_AROUND.format(lo=0, hi=4)}, 'idiot|scum|loser', 'i')""")  # fmt: skip
def m2_window_mitigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.hits(files(spark, sf_dir), M2).select("path", "rule_ord", "line")


FIRST = Family("", "M3", (Rule("license", "License", "info", (r"apache license", r"licensed under", r"all rights reserved")), Rule("abuse", "Abuse", "medium", (r"worthless", r"pathetic|idiot")), Rule("script", "Script", "low", (r"<script",))), cap=None)
_FIRST_RULES = "rules(rule_ord, pattern_ord, rx) AS (VALUES " + ", ".join(f"({i}, {j}, '{p}')" for i, r in enumerate(FIRST.rules) for j, p in enumerate(r.patterns)) + ")"
_FIRST_HITS = f"""WITH {FILES}, {_FIRST_RULES},
cut AS (SELECT path, rule_ord, pattern_ord, string_split_regex(content, rx, 'i')[1] AS before, string_split(content, chr(10)) AS all_lines FROM files JOIN rules ON regexp_matches(content, rx, 'i')),
firsts AS (SELECT path, rule_ord, pattern_ord, 1 + length(before) - length(replace(before, chr(10), '')) AS line, all_lines FROM cut)"""


@query("m3_file_first", f"{_FIRST_HITS} SELECT path, rule_ord::BIGINT AS rule_ord, min(pattern_ord)::BIGINT AS pattern_ord, arg_min(line, pattern_ord)::BIGINT AS line FROM firsts GROUP BY path, rule_ord")
def m3_file_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.hits(files(spark, sf_dir), FIRST).select("path", "rule_ord", "pattern_ord", "line")


CLEARED = tuple(Rule(r.id, r.title, r.severity, r.patterns, window=(0, 7), mitigation="scum|version") for r in FIRST.rules)
_CLEAR = "NOT regexp_matches(array_to_string(all_lines[line:line + 7], chr(10)), 'scum|version', 'i')"


@query("m4_pattern_first", f"{_FIRST_HITS} SELECT path, rule_ord::BIGINT AS rule_ord, pattern_ord::BIGINT AS pattern_ord, line::BIGINT AS line FROM firsts WHERE {_CLEAR}")
def m4_pattern_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.pattern_first(files(spark, sf_dir), CLEARED).select("path", "rule_ord", "pattern_ord", "line")


@query("m5_first_unmitigated", f"{_FIRST_HITS} SELECT path, rule_ord::BIGINT AS rule_ord, min(pattern_ord)::BIGINT AS pattern_ord, arg_min(line, pattern_ord)::BIGINT AS line FROM firsts WHERE {_CLEAR} GROUP BY path, rule_ord")
def m5_first_unmitigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.first_unmitigated(files(spark, sf_dir), CLEARED).select("path", "rule_ord", "pattern_ord", "line")


CORPUS_LEVEL = (Rule("no-policy", "No content policy", "high", (r"content-security-policy",), check="missing"), Rule("no-charset", "No charset", "low", (r"charset=",), check="missing"), Rule("margin", "Margin in a style", "low", (r"margin:0",), check="present"))


@query("m6_corpus_absence", f"""WITH {FILES}, own AS (SELECT * FROM files WHERE path LIKE 'page/%')
SELECT min(path) AS path, 0::BIGINT AS rule_ord, 0::BIGINT AS line FROM own HAVING count(*) > 0 AND NOT bool_or(regexp_matches(content, 'content-security-policy|helmet', 'i'))
UNION ALL SELECT min(path), 1::BIGINT, 0::BIGINT FROM own HAVING count(*) > 0 AND NOT bool_or(regexp_matches(content, 'charset=|helmet', 'i'))
UNION ALL SELECT path, 2::BIGINT, min(line_no)::BIGINT FROM lines WHERE path LIKE 'page/%' AND regexp_matches(line, 'margin:0', 'i') GROUP BY path""")  # fmt: skip
def m6_corpus_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.corpus_presence(files(spark, sf_dir).where("path like 'page/%'"), CORPUS_LEVEL).select("path", "rule_ord", "line")


STRUCTURAL = (Rule("nav-without-form", "Navigation without a form", "low", (), path_contains=".html", has=("<nav",), lacks=("<form",)), Rule("link", "Links of pages with scripts", "info", (r"<a href=",), path_contains="page/", has=("<script",), lacks=("<iframe",)))


@query("m7_structural", f"""WITH {FILES}
SELECT path, 0::BIGINT AS rule_ord, 1::BIGINT AS line FROM files WHERE contains(path, '.html') AND contains(content, '<nav') AND NOT contains(content, '<form')
UNION ALL SELECT l.path, 1::BIGINT, l.line_no::BIGINT FROM lines l JOIN files f ON f.path = l.path WHERE contains(l.path, 'page/') AND contains(f.content, '<script') AND NOT contains(f.content, '<iframe') AND regexp_matches(l.line, '<a href=', 'i')""")  # fmt: skip
def m7_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.structural(files(spark, sf_dir), STRUCTURAL).select("path", "rule_ord", "line")


@query("file_gate", f"WITH {FILES} SELECT path, line_no::BIGINT AS line FROM lines WHERE path IN (SELECT path FROM files WHERE regexp_matches(content, 'licensed under', 'i')) AND regexp_matches(line, 'version', 'i')")
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = Family("", "M1", (Rule("version", "Version", "info", (r"version",)),), gate=r"licensed under", cap=None)
    return modes.hits(files(spark, sf_dir), family).select("path", "line")


@query("language_filter", f"WITH {FILES} SELECT count(*) AS files FROM files WHERE NOT regexp_matches(path, '[.](ts|tsx|js|jsx|go|java|rb|php)$')")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_language(files(spark, sf_dir), ("python",)).agg(F.count("*").alias("files"))


@query("size_cap", f"WITH {FILES} SELECT count(*) AS files, sum(strlen(content))::BIGINT AS bytes FROM files WHERE strlen(content) <= 5000")
def size_cap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_cap(files(spark, sf_dir), 5000).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("glob_select", f"WITH {FILES} SELECT count(*) AS files FROM files WHERE regexp_matches(path, '^(page/[^/]*[.]html|conv/.*)$') AND NOT regexp_matches(path, '^conv/1[^/]*/')")
def glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_paths(files(spark, sf_dir), ("page/*.html", "conv/**"), ("conv/1*/**",)).agg(F.count("*").alias("files"))


@query("finding_ids", f"{M1} SELECT path AS file, rule, line::BIGINT AS line, 'SPX-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS id FROM (SELECT *, row_number() OVER (ORDER BY path, rule_ord, pattern_ord, line) AS n FROM hits)")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(modes.findings(files(spark, sf_dir), R.CORPUS)).select("file", "rule", "line", "id")


@query("scan_builtin")
def scan_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in families over all texts: patterns with look-ahead, which the oracle lacks."""
    return scan(files(spark, sf_dir), (*R.WIRED, *R.EXPERIMENTAL)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("scan_deep")
def scan_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep families over a script beside each page, and the pages themselves; tests hold a case for each family."""
    pages = files(spark, sf_dir).where(F.startswith("path", F.lit("page/")))
    scripts = pages.withColumn("path", F.concat("path", F.lit(".js"))).withColumn("content", F.concat(F.lit("el.innerHTML = value;\nexec(`ls ${dir}`);\n"), "content")).withColumn("length", F.length("content"))
    return scan(pages.unionByName(scripts.select(*pages.columns)), DEEP).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def redos_sql(tables: str) -> str:
    """The rule over lines(path, line_no, line), of which `tables` makes the rows; files over the cap aside."""
    # spelled for SQL here, not taken from the operator
    signs = (
        ("Nested quantifiers", r"\([^)]*[+*]\)[+*]"), ("Nested quantifier with repetition", r"\([^)]*[+*]\)[{]"), ("Multiple greedy wildcards", r"[.][*][.][*]"), ("Multiple greedy one-or-more", r"[.][+][.][+]"),
        ("Alternation in repeated group", r"\([^)]*[|][^)]*\)[+*]"), ("Back-reference with quantifier", r"[\\][1-9].*[+*]"), ("Greedy capture repeated", r"\([.][*]\)[+]"), ("Character class repeated in repeated group", r"(?i)\([a-z]-[a-z]\][+]\)[+]"),
    )
    cases = " ".join(f"WHEN regexp_matches(p, '{p}') THEN '{n}'" for n, p in signs)
    return f"""WITH {tables}, own AS (SELECT l.path, l.line_no, l.line FROM lines l JOIN files f ON f.path = l.path WHERE strlen(f.content) <= 500000),
s AS (SELECT path, line_no, unnest(regexp_extract_all(line, 'new\\s+RegExp\\s*\\(\\s*["''`]([^"''`]+)["''`]', 1)) AS p FROM own UNION ALL SELECT path, line_no, unnest(regexp_extract_all(line, '/([^/\\n]{{3,}})/[gimsuy]*', 1)) FROM own
  UNION ALL SELECT path, line_no, p FROM (SELECT path, line_no, unnest(regexp_extract_all(line, '`((?:[\\\\]`|[^`])+)`', 1)) AS p FROM own) WHERE regexp_matches(p, '[\\\\][sdwbSDWB]|\\[[^\\]]+\\]|\\([?][:=!]')),
h AS (SELECT path, line_no, CASE {cases} WHEN regexp_matches(p, '[\\\\]s[*+]') AND contains(p, '${{') THEN 'Unbounded whitespace adjacent to template interpolation' END AS indicator FROM s WHERE length(p) >= 3),
n AS (SELECT a.path, a.line_no, bool_or(regexp_matches(b.line, 'req\\.|input|user|body|query|params|request|data|search|filter|match', 'i')) AS near FROM (SELECT DISTINCT path, line_no FROM h WHERE indicator IS NOT NULL) a JOIN lines b ON b.path = a.path AND b.line_no BETWEEN a.line_no - 3 AND a.line_no + 3 GROUP BY 1, 2)
SELECT h.path AS file, h.line_no::BIGINT AS line, indicator, CASE WHEN near THEN 'high' ELSE 'low' END AS severity FROM h JOIN n ON n.path = h.path AND n.line_no = h.line_no WHERE indicator IS NOT NULL"""


@query("redos_scan", redos_sql(FILES))
def redos_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textscan.redos(files(spark, sf_dir)).select("file", "line", "indicator", "severity")


#: Lines of code, of which each text holds three: sources of all kinds, with and without what they need.
CODE = (
    'const a = new RegExp("(x+)+$")', "ok.test(/^(a*)*b/g, s)", "r = /(ab+){2,}/", "const any = /.*.*end/.test(t)", "p = /.+.+/", "f(/(a|b)*c/)", "g = /(x)\\1+/", "k = /(.*)+/i", "c = /([a-z]+)+/", "c = `(A-Z]+)+\\d`",
    "const t = `^\\s*${name}$`", "const t = `\\s* no slot`", "const u = `plain ${text}`", "new RegExp('(?:y+)*')", "x = 1 // y / z", "/ab/", "search(q)", "req.body.x", "// nothing here", "", "t = `[^x](a|b)+` + `(c|d)+` // /(e|f)+/",
)
_CODE_FILES = "code(i, text) AS (VALUES " + ", ".join(f"({i}, '" + c.replace("'", "''") + "')" for i, c in enumerate(CODE)) + f"""),
files AS (SELECT 'c' || e.event_id AS path, a.text || chr(10) || b.text || chr(10) || c.text AS content FROM events e JOIN code a ON a.i = e.event_id % {len(CODE)} JOIN code b ON b.i = (e.event_id // 3) % {len(CODE)} JOIN code c ON c.i = (e.event_id // 7 + 5) % {len(CODE)}),
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)"""


@query("redos", redos_sql(_CODE_FILES))
def redos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    line = lambda k: F.element_at(F.array(*map(F.lit, CODE)), (F.floor(k).cast("long") % len(CODE) + 1).cast("int"))
    own = read(spark, sf_dir, "events").select(F.concat(F.lit("c"), e.cast("string")).alias("path"), F.concat(line(e), F.lit("\n"), line(e / 3), F.lit("\n"), line(F.floor(e / 7) + 5)).alias("content"))
    return textscan.redos(own.withColumn("length", F.octet_length("content"))).select("file", "line", "indicator", "severity")


@query("redirect_header_scan")
def redirect_header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textscan.redirect_headers(files(spark, sf_dir))


@query("grep_top", f"WITH {FILES} SELECT path, line_no::BIGINT AS line_no, line FROM lines WHERE contains(line, 'Licensed') ORDER BY path, line_no LIMIT 50")
def grep_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textscan.grep(explode_lines(files(spark, sf_dir)), "Licensed").select("path", "line_no", "line")


@query("list_files", f"WITH {FILES} SELECT path FROM files WHERE path LIKE 'page/%' ORDER BY path LIMIT 100")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textscan.list_files(files(spark, sf_dir), "page/")


_TOKEN = r"token = \"([0-9a-f]+)\""


@query("mask_secret", f"WITH {FILES}, s AS (SELECT path, line_no, regexp_extract(line, 'token = \"([0-9a-f]+)\"', 1) AS v FROM lines) SELECT path, line_no::BIGINT AS line_no, CASE WHEN length(v) <= 12 THEN v[1:3] || '***' ELSE v[1:6] || '...' || v[-4:] || ' (masked)' END AS masked FROM s WHERE v <> ''")
def mask_secret_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explode_lines(files(spark, sf_dir)).select("path", "line_no", F.regexp_extract("line", _TOKEN, 1).alias("v")).where("v <> ''")
    return found.select("path", "line_no", mask_secret("v").alias("masked"))


@query("token_entropy", f"""WITH {FILES}, s AS (SELECT path, line_no, regexp_extract(line, 'token = "([0-9a-f]+)"', 1) AS v FROM lines), c AS (SELECT path, line_no, v, unnest(string_split(v, '')) AS ch FROM s WHERE v <> ''),
n AS (SELECT path, line_no, v, ch, count(*) AS k FROM c GROUP BY ALL) SELECT path, line_no::BIGINT AS line_no, round(-sum(k / length(v) * log2(k / length(v))), 6) AS entropy FROM n GROUP BY path, line_no, v""")  # fmt: skip
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explode_lines(files(spark, sf_dir)).select("path", "line_no", F.regexp_extract("line", _TOKEN, 1).alias("v")).where("v <> ''")
    return found.select("path", "line_no", F.round(entropy("v"), 6).alias("entropy"))


_MONITOR = "CASE " + " ".join("WHEN regexp_matches(line, '{}', 'i') THEN '{}'".format(p.replace("'", "''"), r) for r, _, p in textscan.MONITOR) + " END"


@query("monitor_first_match", f"WITH {FILES}, m AS (SELECT path, line_no, {_MONITOR} AS rule FROM lines) SELECT path, line_no::BIGINT AS line_no, rule FROM m WHERE rule IS NOT NULL")
def monitor_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textscan.monitor(explode_lines(files(spark, sf_dir))).select("path", "line_no", "rule")


@query("dast_verdict", """WITH r AS (SELECT event_id, event_type, CASE event_id % 2 WHEN 0 THEN 'Time-based blind' ELSE 'Union' END AS name, ['sqli', 'redirect', 'xss'][event_id % 3 + 1] AS category, [200, 302, 304, 500][event_id % 4 + 1] AS status, (value * 100)::BIGINT AS elapsed_ms,
  CASE WHEN event_id % 5 = 0 THEN 'Database error in query' ELSE 'plain' END || props AS body, CASE event_id % 7 WHEN 0 THEN 'https://evil.com/x' WHEN 1 THEN '//elsewhere' ELSE '/home' END AS location FROM events),
v AS (SELECT event_id, CASE WHEN event_type = 'error' AND regexp_matches(body, '"k": 7') THEN 'indicator' WHEN contains(name, 'Time-based') AND elapsed_ms > 4500 THEN 'delay' WHEN category = 'redirect' AND status IN (301, 302, 303, 307, 308) AND (contains(location, 'evil.com') OR starts_with(location, '//')) THEN 'redirect' WHEN category = 'sqli' AND status = 500 AND regexp_matches(body, 'sql|syntax|query|database|ORA-|PG::', 'i') THEN 'server-error' END AS verdict FROM r)
SELECT coalesce(verdict, 'none') AS verdict, count(*) AS n FROM v GROUP BY 1""")  # fmt: skip
def dast_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")

    def pick(n: int, *values: str | int):
        return F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))

    responses = e.select(
        F.when(F.col("event_type") == "error", '"k": 7').alias("detect_regex"), pick(2, "Time-based blind", "Union").alias("payload_name"), pick(3, "sqli", "redirect", "xss").alias("category"), pick(4, 200, 302, 304, 500).alias("status"), F.round(F.col("value") * 100).cast("long").alias("elapsed_ms"),
        F.concat(F.when(k % 5 == 0, "Database error in query").otherwise("plain"), "props").alias("body"), F.when(k % 7 == 0, "https://evil.com/x").when(k % 7 == 1, "//elsewhere").otherwise("/home").alias("location_header"),
    )
    return textscan.dast_verdict(responses).groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


@query("corpus_counts", f"{M1}, s(rule, severity, cost) AS (VALUES " + ", ".join(f"('{r.id}', '{r.severity}', {c})" for r, c in zip(R.CORPUS.rules, (0, 20, 5, 2, 2), strict=True)) + ") SELECT severity, count(*) AS n FROM hits JOIN s ON s.rule = hits.rule GROUP BY severity")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scan, then findings by severity."""
    return modes.findings(files(spark, sf_dir), R.CORPUS).groupBy("severity").agg(F.count("*").alias("n"))
