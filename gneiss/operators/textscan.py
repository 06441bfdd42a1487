"""Scanners with logic of their own: regular expressions that backtrack, redirects that keep credentials, history, logs."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gneiss.functions.rules import SECRETS
from gneiss.functions.scalars import js_trim, mask_secret
from gneiss.operators.modes import regex, window_text
from gneiss.sources.corpus import with_lines

#: Where a line holds the source of a regular expression (group 1), and what a source of the third kind, any
#: template, has to look like.
SOURCES = (r"new\s+RegExp\s*\(\s*[\"'`]([^\"'`]+)[\"'`]", r"/([^/\n]{3,})/[gimsuy]*", r"`((?:\\`|[^`])+)`")
LIKE_REGEX = r"\\[sdwbSDWB]|\[[^\]]{1,}\]|\(\?[:=!]"
#: Fixed values, in order: signs of a source that may backtrack without bound, and what some need beside; the first names it.
INDICATORS = (
    ("Nested quantifiers", r"\([^)]*[+*]\)[+*]", None),
    ("Nested quantifier with repetition", r"\([^)]*[+*]\)\{", None),
    ("Multiple greedy wildcards", r"\.\*\.\*", None),
    ("Multiple greedy one-or-more", r"\.\+\.\+", None),
    ("Alternation in repeated group", r"\([^)]*\|[^)]*\)[+*]", None),
    ("Back-reference with quantifier", r"\\[1-9].*[+*]", None),
    ("Greedy capture repeated", r"\(\.\*\)\+", None),
    ("Character class repeated in repeated group", r"(?i)\([a-z]-[a-z]\]\+\)\+", None),
    ("Unbounded whitespace adjacent to template interpolation", r"\\s[*+]", r"\$\{"),
)
#: Words of lines around that say the source meets input.
USER_FACING = r"req\.|input|user|body|query|params|request|data|search|filter|match"


def redos(files: DataFrame, cap: int | None = 500_000) -> DataFrame:
    """Sources of regular expressions that may backtrack, in constructors, literals and templates: one finding a source, high
    where one of the lines from three before to three after names input. cap: files over so many bytes aren't looked at."""
    small = files if cap is None else files.where(F.col("length") <= cap)
    rows = with_lines(small).select("path", "lines", F.posexplode("lines").alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    *plain, template = (F.regexp_extract_all("text", F.lit(p), 1) for p in SOURCES)
    found = F.filter(F.concat(*plain, F.filter(template, lambda x: x.rlike(LIKE_REGEX))), lambda x: F.length(x) >= 3)
    each = rows.select("path", "lines", "line", "text", F.explode(found).alias("pattern"))
    holds = lambda p, need: F.col("pattern").rlike(p) & (F.col("pattern").rlike(need) if need else F.lit(True))
    indicator = F.coalesce(*(F.when(holds(p, need), F.lit(name)) for name, p, need in INDICATORS))
    near = window_text(-3, 3).rlike(regex(USER_FACING))
    title = F.concat(F.lit("ReDoS: "), "indicator", F.lit(" — "), F.when(near, "user-facing").otherwise("internal"))
    return each.withColumn("indicator", indicator).where("indicator is not null").select(
        F.lit("redos:vulnerable-pattern").alias("rule"), title.alias("title"), F.col("path").alias("file"), "line", F.substring(js_trim("text"), 1, 120).alias("snippet"), "indicator", F.when(near, "high").otherwise("low").alias("severity"), F.when(near, "high").otherwise("medium").alias("confidence")
    )


def redirect_headers(files: DataFrame) -> DataFrame:
    """Lines with a pattern for the authorization header, not the proxy's, near redirects: one a line."""
    rows = with_lines(files).select("path", "lines", F.posexplode("lines").alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    hit = F.col("text").rlike(r"(?i)/[^/\n]*authorization[^/\n]*/") & ~F.col("text").rlike(r"(?i)proxy")
    return rows.where(hit & window_text(-5, 5).rlike(regex("redirect"))).select(F.lit("credential:incomplete-redirect-header-strip").alias("rule"), F.col("path").alias("file"), "line", F.substring(js_trim("text"), 1, 160).alias("snippet"), F.lit("high").alias("severity"))


def history_secrets(added: DataFrame) -> DataFrame:
    """Secrets in added lines of history(hash, ordinal, file, line): the first pattern that matches a line counts."""
    tests = F.coalesce(*(F.when(F.col("line").rlike(regex(p)), F.struct(F.lit(r.id).alias("slug"), F.lit(r.severity).alias("severity"), F.regexp_extract("line", regex(p), 0).alias("value"))) for r in SECRETS.rules for p in r.patterns))
    return added.withColumn("hit", tests).where("hit is not null").select(F.concat(F.lit("history:"), "hit.slug").alias("rule"), "hit.severity", "hash", "file", "ordinal", mask_secret("hit.value").alias("snippet"))


#: Fixed values, in order: a line is reported for the first of these that it matches.
MONITOR = (
    ("sql-error", "high", r"SQL\s*(?:syntax\s*)?error|ORA-\d+|PG::\w+Error"),
    ("stack-trace", "medium", r"stack\s*trace|at\s+\w+\s+\(.*:\d+:\d+\)"),
    ("ssrf-attempt", "high", r"ECONNREFUSED|ETIMEDOUT.*(?:internal|169\.254|10\.|172\.(?:1[6-9]|2\d|3[01]))"),
    ("auth-failure", "medium", r"unauthorized|401.*(?:bearer|token|jwt)"),
    ("authz-failure", "medium", r"403.*forbidden|access\s*denied"),
    ("path-traversal", "high", r"\.\./|\.\.\\|path\s*traversal|directory\s*traversal"),
    ("xss-attempt", "high", r"<script|javascript:|on\w+\s*=|alert\s*\("),
    ("rate-limit", "low", r"rate\s*limit|too\s*many\s*requests|429"),
    ("secret-leak", "critical", r"(?:password|secret|token|key)\s*[:=]\s*\S+"),
    ("memory-error", "critical", r"segfault|SIGSEGV|buffer\s*overflow|heap\s*corruption"),
    ("cmd-injection", "critical", r"exec|spawn|child_process.*(?:;|&&|\|\||`)"),
    ("deserialization", "high", r"deserializ|unmarshal|pickle\.load|readObject"),
)


def monitor_hit(line: Column | str = "line") -> Column:
    """(rule, severity) of the first pattern that a log line matches; null without one."""
    line = F.col(line) if isinstance(line, str) else line
    return F.coalesce(*(F.when(line.rlike(regex(p)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p in MONITOR))


def monitor(lines: DataFrame) -> DataFrame:
    """Alerts of a table or stream of log lines."""
    some = lines.where(F.col("line").rlike(regex("|".join(p for _, _, p in MONITOR))))
    # the array keeps the optimizer from testing the patterns once for the filter and once more for the result
    hit = some.withColumn("_hit", F.explode(F.array(monitor_hit())))
    return hit.select(*lines.columns, "_hit.rule", "_hit.severity")


def dast_verdict(responses: DataFrame) -> DataFrame:
    """responses(payload_name, category, detect_regex, status, body, elapsed_ms, location_header) with verdict and
    vulnerable: the first that holds of an indicator in the body, the delay of a time-based payload, a redirect to another
    host, and a server error that speaks of a database."""
    body, location = F.coalesce("body", F.lit("")), F.coalesce("location_header", F.lit(""))
    shown = F.coalesce(F.expr("coalesce(body, '') rlike detect_regex"), F.lit(False))
    late = F.contains("payload_name", F.lit("Time-based")) & (F.col("elapsed_ms") > 4500)
    moved = (F.col("category") == "redirect") & F.col("status").isin(301, 302, 303, 307, 308) & (F.contains(location, F.lit("evil.com")) | F.startswith(location, F.lit("//")))
    broken = (F.col("category") == "sqli") & (F.col("status") == 500) & body.rlike(r"(?i)sql|syntax|query|database|ORA-|PG::")
    verdict = F.when(shown, "indicator").when(late, "delay").when(moved, "redirect").when(broken, "server-error")
    return responses.withColumn("verdict", verdict).withColumn("vulnerable", F.col("verdict").isNotNull())


def grep(lines: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    return lines.where(F.col("line").rlike(pattern)).orderBy("path", "line_no").limit(limit)


def read_slice(lines: DataFrame, path: str, first: int, last: int) -> DataFrame:
    return lines.where((F.col("path") == path) & F.col("line_no").between(first, last)).orderBy("line_no")


def list_files(files: DataFrame, prefix: str = "", limit: int = 100) -> DataFrame:
    return files.where(F.startswith("path", F.lit(prefix))).select("path").orderBy("path").limit(limit)


def _merged(one: list[list[int]], other: list[list[int]]) -> list[list[int]]:
    """Open braces of two readings that go on as one: levels meet from the innermost on."""
    long, short = (one, other) if len(one) >= len(other) else (other, one)
    for k in range(1, len(short) + 1):
        more, less = (long[-k], short[-k]) if len(long[-k]) >= len(short[-k]) else (short[-k], long[-k])
        more.extend(less)  # the fewer go to the more, so none moves often
        long[-k] = more
    return long


def closed_braces(text: str) -> list[tuple[int, int]]:
    """(start, end) of each brace that closes, read from it on with braces inside JSON strings aside; one pass.

    Whether a place is inside a string depends on where reading began, but of all readings only three kinds differ at a
    place: outside a string, inside, and behind a backslash inside. Each has one stack, and all its braces close together."""
    outside, inside, escaped, after = [], [], None, -2
    found = []
    for m in re.finditer(r'[{}"\\]', text):
        at, c = m.start(), m[0]
        skipped = None
        if escaped is not None:
            if at == after + 1:
                skipped = escaped
            else:
                inside = _merged(inside, escaped)
            escaped = None
        if c == "{":
            outside.append([at])
        elif c == "}":
            if outside:
                found += [(start, at + 1) for start in outside.pop()]
        elif c == '"':
            outside, inside = inside, outside
        else:
            escaped, after, inside = inside, at, []
        if skipped is not None:
            inside = _merged(inside, skipped)
    return found


@F.pandas_udf(ArrayType(StringType()))
def _objects(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str]:
        text = (text or "").strip()
        fenced = (x.strip() for x in re.findall(r"```(?:json)?\s*\n?([\s\S]*?)```", text))
        out = [x for x in (text, *fenced) if x.startswith("{") and x.endswith("}")]
        closed = sorted(closed_braces(text), reverse=True)
        return list(dict.fromkeys([*out, *(text[i:end] for i, end in closed)]))

    return texts.map(one)


def json_candidates(text: Column | str) -> Column:
    """JSON objects in free text, in the order to try them: the whole, fenced blocks, balanced braces from the end on."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(_objects(text), lambda x: F.try_parse_json(x).isNotNull())


#: What to do about a leaked secret, by rule; else by what the rule contains; else the general guide.
ROTATION = {
    "secret:aws-access-key": "Deactivate the key in the account, make a new one, look through the access log.",
    "secret:github-pat": "Revoke the token in the account's settings and make one with fewer scopes.",
    "secret:llm-provider-key": "Revoke the key in the provider's console and set a spending limit.",
    "secret:stripe-key": "Roll the key in the payment dashboard.",
    "secret:database-url": "Change the database password and restrict where it may connect from.",
    "secret:private-key": "Make a new key pair and replace the public key wherever it is trusted.",
    "secret:generic-api-key": "Revoke the key with its issuer and keep the new one outside of source.",
}
GENERAL = "Revoke the secret, replace it, and remove it from history."


def rotation_guide(found: DataFrame) -> DataFrame:
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROTATION.items() for x in kv]), F.col("rule"))
    part = reduce(lambda a, kv: a.when(F.contains("rule", F.lit(kv[0].split(":")[1])), kv[1]), ROTATION.items(), F.when(F.lit(False), ""))
    return found.select("rule", "file", "line", F.coalesce(exact, part, F.lit(GENERAL)).alias("guide"))
