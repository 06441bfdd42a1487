"""Program analysis: entities of source files, calls, paths, taint, endpoints, services and interval overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.scalars import js_trim

ENDS = {"js": 500, "handler": 1000}
#: Words before a bracket that are no calls.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "await", "async", "super", "import", "require", "else", "do", "try", "throw", "delete", "void", "in", "of", "instanceof", "def", "class", "print", "func", "elif", "except", "with", "lambda", "not", "and", "or", "range", "len", "str", "int", "list", "dict", "set", "map", "filter", "make", "append", "panic", "go", "defer", "select", "case")

_FUNCTIONS = {
    "javascript": (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)\)?", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=]+)?=>"),
    "python": (r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)?",),
    "go": (r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)?",),
}
_IMPORTS = {
    "javascript": (r"^\s*import\s+(.+?)\s+from\s+[\"']([^\"']+)[\"']", r"^\s*(?:const|let|var)\s+(.+?)\s*=\s*require\s*\(\s*[\"']([^\"']+)[\"']"),
    "python": (r"^\s*from\s+([\w.]+)\s+import\s+(.+)$",),
    "go": (r"^\s*(?:import\s+)?(\w*)\s*\"([^\"]+)\"\s*$",),
}
_ROUTE = r"\b(?:app|router|server|api)\s*\.\s*(get|post|put|patch|delete|all)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,?(.*)$"


def _family(lang: str = "lang") -> Column:
    return F.when(F.col(lang) == "typescript", "javascript").otherwise(F.col(lang))


def _matched(lines: DataFrame, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """lines that match a pattern of their language, with groups 1 and 2 of the first that does."""
    tests = [F.when((_family() == lang) & F.col("line").rlike(p), F.struct(F.lit(lang).alias("family"), F.regexp_extract("line", p, 1).alias("one"), F.regexp_extract("line", p, 2).alias("two"))) for lang, ps in table.items() for p in ps]
    return lines.withColumn("m", F.coalesce(*tests)).where("m is not null")


def functions(files: DataFrame) -> DataFrame:
    """path, name, params, line, end_line, lang. Ends by braces, or by indentation in Python; both within 500 lines."""
    rows = files.select("path", "lang", F.split("content", "\n").alias("lines"))
    lines = rows.select("path", "lang", "lines", F.posexplode("lines").alias("pos", "line"))
    found = _matched(lines, _FUNCTIONS).select("path", "lang", "lines", (F.col("pos") + 1).alias("at"), F.col("m.one").alias("name"), F.col("m.two").alias("params"))
    end = F.when(F.col("lang") == "python", indent_end()).otherwise(brace_end(500, F.col("at") + 1))
    return found.select("path", "lang", "name", F.filter(F.transform(F.split("params", ","), lambda p: js_trim(F.regexp_replace(p, r"[:=].*$", ""))), lambda p: p != "").alias("params"), F.col("at").alias("line"), end.cast("int").alias("end_line"))


def brace_end(cap: int, missing: Column) -> Column:
    """Line at which the first block after `at` closes, by the depth at ends of lines; `missing` if it doesn't in cap lines."""
    part = F.slice("lines", F.col("at"), F.lit(cap))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        opens, closes = F.length(x) - F.length(F.replace(x, F.lit("{"))), F.length(x) - F.length(F.replace(x, F.lit("}")))
        depth = a["depth"] + opens - closes
        was = a["open"] | (opens > 0)
        return F.struct((a["i"] + 1).alias("i"), depth.alias("depth"), was.alias("open"), F.when((a["end"] == 0) & was & (depth <= 0), a["i"] + 1).otherwise(a["end"]).alias("end"))

    end = F.aggregate(part, zero, step)["end"]
    return F.when(end > 0, F.col("at") + end - 1).otherwise(F.least(missing, F.size("lines")))


def indent_end(cap: int = 500) -> Column:
    """Line before the first later one, not blank, that is indented no deeper."""
    own = F.length(F.regexp_extract(F.get("lines", F.col("at") - 1), r"^(\s*)", 1))
    part = F.slice("lines", F.col("at") + 1, F.lit(cap))
    stop = F.array_position(F.transform(part, lambda x: (F.trim(x) != "") & (F.length(F.regexp_extract(x, r"^(\s*)", 1)) <= own)), True)
    return F.when(stop > 0, F.col("at") + stop - 1).otherwise(F.least(F.col("at") + cap, F.size("lines")))


def imports(lines: DataFrame) -> DataFrame:
    """path, names, source, line."""
    m = _matched(lines, _IMPORTS)
    python = F.col("m.family") == "python"
    source, names = F.when(python, F.col("m.one")).otherwise(F.col("m.two")), F.when(python, F.col("m.two")).otherwise(F.col("m.one"))
    words = F.regexp_extract_all(names, F.lit(r"([A-Za-z_$][\w$]*)"), 1)
    return m.select("path", F.array_except(words, F.array(F.lit("as"), F.lit("type"))).alias("names"), source.alias("source"), F.col("line_no").alias("line"))


def classes(lines: DataFrame) -> DataFrame:
    p = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s*(?:extends\s+|\()([\w$.]+))?"
    return lines.where(F.col("line").rlike(p)).select("path", F.regexp_extract("line", p, 1).alias("name"), F.nullif(F.regexp_extract("line", p, 2), F.lit("")).alias("parent"), F.col("line_no").alias("line"))


def exports(lines: DataFrame) -> DataFrame:
    p = r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type)\s+([A-Za-z_$][\w$]*)"
    return lines.where(F.col("line").rlike(p)).select("path", F.regexp_extract("line", p, 1).alias("name"), F.col("line_no").alias("line"))


def routes(lines: DataFrame) -> DataFrame:
    """path, method, route, handlers (the rest of the line), line."""
    p = f"(?i){_ROUTE}"
    return lines.where(F.col("line").rlike(p)).select("path", F.upper(F.regexp_extract("line", p, 1)).alias("method"), F.regexp_extract("line", p, 2).alias("route"), F.regexp_extract("line", p, 3).alias("handlers"), F.col("line_no").alias("line"))


def calls(funcs: DataFrame, lines: DataFrame) -> DataFrame:
    """caller (path:name), file, line, callee: words before a bracket in bodies; a declaration is a call of itself."""
    body = funcs.alias("f").join(lines.alias("l"), (F.col("f.path") == F.col("l.path")) & F.col("l.line_no").between(F.col("f.line"), F.col("f.end_line")))
    names = F.array_except(F.regexp_extract_all("l.line", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1), F.array(*map(F.lit, NOT_CALLS)))
    return body.select(F.concat_ws(":", "f.path", "f.name").alias("caller"), F.col("f.path").alias("file"), F.col("l.line_no").alias("line"), F.explode(names).alias("callee"))


def resolve_calls(found: DataFrame, funcs: DataFrame, imported: DataFrame) -> DataFrame:
    """Edges: a callee is what is imported by its name, else a function of the same file, else the only one of its name
    anywhere, else external:name."""
    defined = funcs.select("path", "name").distinct()
    only = defined.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select(F.col("name").alias("callee"), F.concat_ws(":", "path", "name").alias("global"))
    local = defined.select(F.col("path").alias("file"), F.col("name").alias("callee"), F.concat_ws(":", "path", "name").alias("local"))
    stem = F.regexp_replace(F.element_at(F.split("source", r"[/.]"), -1), r"\W", "")
    named = imported.select(F.col("path").alias("file"), F.explode("names").alias("callee"), stem.alias("stem"))
    homes = defined.select(F.col("path").alias("home"), F.col("name").alias("callee"), F.regexp_extract("path", r"([^/.]+)(?:\.[^/]*)?$", 1).alias("stem"))
    via = named.join(homes, ["callee", "stem"]).groupBy("file", "callee").agg(F.concat_ws(":", F.min("home"), F.col("callee")).alias("via"))
    out = found.join(via, ["file", "callee"], "left").join(local, ["file", "callee"], "left").join(only, "callee", "left")
    return out.select("caller", F.coalesce("via", "local", "global", F.concat(F.lit("external:"), "callee")).alias("callee"), "file", "line")


def callers(edges: DataFrame, target: str) -> DataFrame:
    """Edges to a node, or to any node of the name where no file is given."""
    hit = F.col("callee") == target if ":" in target else F.endswith(F.col("callee"), F.lit(":" + target))
    return edges.where(hit)


def callees(edges: DataFrame, source: str) -> DataFrame:
    hit = F.col("caller") == source if ":" in source else F.endswith(F.col("caller"), F.lit(":" + source))
    return edges.where(hit)


def trace_paths(edges: DataFrame, source: str, target: str, depth: int = 10, limit: int | None = None) -> DataFrame:
    """(path array): all simple paths of up to `depth` edges; parallel edges repeat a path. Each step is one join on the
    frontier, so a path costs its edges."""
    narrow = edges.select("caller", "callee")
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "at string, path array<string>")
    done = front.where(F.lit(source == target))
    for _ in range(depth):
        front = front.where(F.col("at") != target).join(narrow, F.col("at") == F.col("caller")).where(~F.array_contains("path", F.col("callee"))).select(F.col("callee").alias("at"), F.concat("path", F.array("callee")).alias("path"))
        done = done.unionByName(front.where(F.col("at") == target))
    out = done.select("path")
    return out.orderBy(F.size("path"), "path").limit(limit) if limit else out


#: Where input enters, by kind; a line gives a source for each pattern that it matches.
TAINT_SOURCES = (
    *(("http-param", p) for p in (r"req\.query\.\w+", r"req\.params\.\w+", r"req\.body\.\w+", r"req\.body$", r"req\.headers\.\w+", r"req\.cookies\.\w+", r"request\.args", r"request\.form", r"request\.json", r"request\.GET", r"request\.POST", r"r\.URL\.Query\(\)", r"r\.FormValue\(", r"\$_GET\[", r"\$_POST\[", r"\$_REQUEST\[", r"\$_COOKIE\[")),
    *(("url-input", p) for p in (r"window\.location", r"document\.location", r"document\.URL", r"document\.referrer")),
    *(("user-input", p) for p in (r"process\.argv", r"process\.stdin", r"readline", r"sys\.argv", r"os\.Args")),
    *(("file-input", p) for p in (r"fs\.readFileSync\(", r"fs\.readFile\(", r"open\(\s*(?:req|request|params|input)")),
)
#: What input must not reach unchecked: kind, severity, weakness, title, pattern.
TAINT_SINKS = (
    ("sql-injection", "critical", 89, "SQL Injection Sink", r"\.query\s*\("), ("sql-injection", "critical", 89, "SQL Execution Sink", r"\.execute\s*\("), ("sql-injection", "critical", 89, "Raw SQL Sink", r"\.raw\s*\("),
    ("command-injection", "critical", 78, "Command Execution Sink", r"exec\s*\("), ("command-injection", "critical", 78, "Sync Command Execution Sink", r"execSync\s*\("), ("command-injection", "high", 78, "Process Spawn Sink", r"spawn\s*\("), ("command-injection", "critical", 78, "Child Process Sink", r"child_process"), ("command-injection", "critical", 78, "OS System Call Sink", r"os\.system\s*\("), ("command-injection", "critical", 78, "Subprocess Sink", r"subprocess"),
    ("xss", "high", 79, "innerHTML Assignment Sink", r"innerHTML\s*="), ("xss", "high", 79, "React Unsafe HTML Sink", r"dangerouslySetInnerHTML"), ("xss", "high", 79, "Document Write Sink", r"document\.write\s*\("), ("xss", "medium", 79, "HTML Render Sink", r"\.html\s*\("),
    ("path-traversal", "high", 22, "File Read Sink", r"readFileSync\s*\("), ("path-traversal", "high", 22, "File Write Sink", r"writeFileSync\s*\("), ("path-traversal", "high", 22, "Read Stream Sink", r"createReadStream\s*\("), ("path-traversal", "medium", 22, "Path Join (potential sink)", r"path\.join\s*\("),
    ("ssrf", "high", 918, "HTTP Fetch Sink", r"fetch\s*\("), ("ssrf", "high", 918, "Axios Request Sink", r"axios\s*[.(]"), ("ssrf", "high", 918, "HTTP Get Sink", r"http\.get\s*\("), ("ssrf", "high", 918, "Python Requests Sink", r"requests\.get\s*\("),
    ("eval", "critical", 95, "Eval Sink", r"\beval\s*\("), ("eval", "critical", 95, "Dynamic Function Sink", r"new\s+Function\s*\("),
    ("redirect", "medium", 601, "Redirect Sink", r"\.redirect\s*\("), ("redirect", "medium", 601, "Location Assignment Sink", r"location\s*="),
)
#: Fixed values, in order: what checks input, whatever the case; the first one that holds is named.
SANITIZERS = (r"escape\w*", r"sanitize\w*", r"encode\w*", "htmlspecialchars", "htmlentities", "encodeURI", "encodeURIComponent", "DOMPurify", r"validator\.\w+", r"parseInt\s*\(", r"Number\s*\(", "parameterized", "prepared", "placeholder")
#: Names of parameters that carry input.
PARAM_WORDS = "(?i)req|request|input|data|body|query|params"


def _sources(line: Column) -> Column:
    return F.array_compact(F.array(*(F.when(line.rlike(p), F.lit(k)) for k, p in TAINT_SOURCES)))


def _sinks(line: Column) -> Column:
    def one(kind: str, severity: str, cwe: int, title: str) -> Column:
        return F.struct(F.lit(kind).alias("sink"), F.lit(severity).alias("severity"), F.lit(f"CWE-{cwe}").alias("cwe"), F.lit(title).alias("title"))

    return F.array_compact(F.array(*(F.when(line.rlike(p), one(*row)) for *row, p in TAINT_SINKS)))


def _sanitizer(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(f"(?i){s}"), F.lit(s)) for s in SANITIZERS))


def taint_in_handlers(files: DataFrame) -> DataFrame:
    """Flows in route handlers: each source with each later sink of the handler, and the first sanitizer between them."""
    rows = files.select("path", F.split("content", "\n").alias("lines"))
    starts = rows.select("path", "lines", F.posexplode("lines").alias("pos", "line")).where(F.col("line").rlike(f"(?i){_ROUTE}")).withColumn("at", F.col("pos") + 1)
    spans = starts.select("path", "lines", "at", F.regexp_extract("line", f"(?i){_ROUTE}", 2).alias("route"), brace_end(1000, F.col("at") + 200).cast("int").alias("end"))
    lines = spans.select("path", "lines", "route", "at", F.posexplode(F.slice("lines", F.col("at"), F.col("end") - F.col("at") + 1)).alias("n", "text")).withColumn("line", F.col("at") + F.col("n"))
    source = lines.select("path", "at", "route", "lines", F.col("line").alias("source_line"), F.explode(_sources(F.col("text"))).alias("source"))
    sink = lines.select(F.col("path").alias("p2"), F.col("at").alias("a2"), F.col("line").alias("sink_line"), F.explode(_sinks(F.col("text"))).alias("s"))
    flows = source.join(sink, (F.col("path") == F.col("p2")) & (F.col("at") == F.col("a2")) & (F.col("sink_line") > F.col("source_line")))
    between = F.array_join(F.slice("lines", F.col("source_line"), F.col("sink_line") - F.col("source_line") + 1), "\n")
    return flows.withColumn("sanitizer", _sanitizer(between)).select("path", "route", "source", "source_line", "s.*", "sink_line", "sanitizer", F.col("sanitizer").isNotNull().alias("sanitized"))


def taint_across(funcs: DataFrame, lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with a telling parameter and a sink, for each of their callers; sanitizers count anywhere in the body."""
    telling = funcs.where(F.exists("params", lambda p: p.rlike(PARAM_WORDS)))
    body = telling.alias("f").join(lines.alias("l"), (F.col("f.path") == F.col("l.path")) & F.col("l.line_no").between(F.col("f.line"), F.col("f.end_line")))
    per = body.groupBy("f.path", "f.name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l.line_no", "l.line"))), lambda x: x["line"]), "\n").alias("text"))
    sinks = body.select(F.col("f.path").alias("path"), F.concat_ws(":", "f.path", "f.name").alias("callee"), F.col("l.line_no").alias("sink_line"), F.explode(_sinks(F.col("l.line"))).alias("s")).select("path", "callee", "sink_line", "s.*")
    clean = per.select(F.concat_ws(":", "path", "name").alias("callee"), _sanitizer(F.col("text")).alias("sanitizer"))
    return edges.where("caller <> callee").select("caller", "callee", F.col("line").alias("call_line")).join(sinks, "callee").join(clean, "callee").withColumn("source", F.lit("function-param")).withColumn("sanitized", F.col("sanitizer").isNotNull())


def taint_findings(flows: DataFrame) -> DataFrame:
    """Findings of flows that nothing checks, with the sink's severity, weakness and title."""
    title = F.concat("title", F.lit(": "), "source", F.lit(" → "), "sink")
    return flows.where("not sanitized").select(F.concat(F.lit("taint:"), "sink").alias("rule"), title.alias("title"), "severity", F.split("sink", "-")[0].alias("category"), "cwe", F.col("path").alias("file"), F.col("sink_line").alias("line"), F.lit("high").alias("confidence"))


#: Words of middleware that authenticates, whatever their case.
AUTH = ("auth", "authenticate", "authorize", "requireAuth", "ensureAuth", "verifyToken", "checkToken", "requireLogin", "isAuthenticated", "passport", "jwt", "session", "apiKey", "bearer", "login_required", "permission_required")
#: The kind of authentication, by the first of these words.
AUTH_TYPES = (("jwt", "JWT"), ("bearer", "JWT"), ("session", "Session"), ("apikey", "API Key"), ("api_key", "API Key"), ("passport", "Passport"), ("oauth", "OAuth"))
#: Paths that need no authentication, with all below them.
PUBLIC = ("/health", "/healthz", "/ready", "/readyz", "/ping", "/status", "/version", "/login", "/signup", "/register", "/auth", "/public", "/static", "/assets", "/docs", "/swagger", "/openapi", "/favicon", "/robots.txt", "/sitemap", "/", "/index")
#: What a sensitive path holds.
SENSITIVE = ("admin", "user", "account", "payment", "billing", "password", "token", "secret", r"api/v\d", "internal", "delete", "export", "import", "upload", "download", "config", "setting", "role", "permission")
#: Ports that should not be public; images and passwords of data stores.
SENSITIVE_PORTS = (22, 3306, 5432, 6379, 27017)
STORES, WEAK = "postgres|mysql|mongo|redis|mariadb", "password|123|admin|root|default"


def is_public(route: Column) -> Column:
    """Equal to a public path, or below it, whatever the case. / is public, so a path that starts with // is too."""
    low = F.lower(route)
    return reduce(lambda a, p: a | (low == p) | F.startswith(low, F.lit(p + "/")), PUBLIC, F.lit(False))


def endpoints(found: DataFrame) -> DataFrame:
    """routes with auth, its kind, and a risk with its reason: the first that holds of a write or a sensitive path
    without auth, an admin or internal path, and no auth."""
    low, route, method = F.lower(F.coalesce("handlers", F.lit(""))), F.col("route"), F.col("method")
    has_auth = F.col("has_auth")
    kind = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(k)) for w, k in AUTH_TYPES), F.lit("Unknown"))
    out = found.withColumn("has_auth", reduce(lambda a, w: a | F.contains(low, F.lit(w.lower())), AUTH, F.lit(False)))
    out = out.withColumn("auth_type", F.when(has_auth, kind)).withColumn("public", is_public(route)).withColumn("sensitive", F.lower(route).rlike("|".join(SENSITIVE)))
    write = ~has_auth & method.isin("POST", "PUT", "PATCH", "DELETE")
    admin = F.lower(route).rlike("admin|internal")
    risk = F.when(write | (~has_auth & F.col("sensitive")), "high").when(admin, "medium").when(~has_auth, "medium").otherwise("low")
    why = F.when(write, F.concat(method, F.lit(" endpoint without authentication"))).when(~has_auth & F.col("sensitive"), F.concat(F.lit("Sensitive path '"), route, F.lit("' without authentication"))).when(admin, "Admin endpoint — verify authorization checks")
    return out.withColumn("risk", risk).withColumn("risk_reason", why)


def unprotected(mapped: DataFrame) -> DataFrame:
    return mapped.where(~F.col("has_auth") & ~F.col("public") & F.col("sensitive"))


def endpoint_assessment(mapped: DataFrame) -> DataFrame:
    return mapped.agg(F.count("*").alias("total"), F.count_if("has_auth").alias("with_auth"), F.count_if(~F.col("has_auth")).alias("without_auth"), F.count_if(F.col("risk") == "high").alias("high_risk")).withColumn("auth_percent", F.coalesce(F.round(F.try_divide(F.col("with_auth") * 100, F.col("total"))).cast("int"), F.lit(100)))


def endpoint_findings(mapped: DataFrame, found: DataFrame) -> DataFrame:
    n = found.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("findings"))
    return mapped.join(n, "path", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def threat_model(mapped: DataFrame) -> DataFrame:
    """Spoofing for open high-risk endpoints, tampering for those that write."""
    s = mapped.where(~F.col("has_auth") & (F.col("risk") == "high")).select(F.lit("spoofing").alias("threat"), "method", "route")
    t = mapped.where(F.col("method").isin("POST", "PUT")).select(F.lit("tampering").alias("threat"), "method", "route")
    return s.unionByName(t)


def service_edges(services: DataFrame) -> DataFrame:
    """Connections: what a service depends on, and services or outside hosts that its environment's values name.

    Services of a project are few; the search for names in values broadcasts the names."""
    depends = services.select(F.col("name").alias("source"), F.explode("depends_on").alias("target"), F.lit("depends").alias("kind"))
    values = services.select(F.col("name").alias("source"), F.explode("environment").alias("key", "value"))
    names = F.broadcast(services.select(F.col("name").alias("target")).distinct())
    inside = values.join(names, F.contains("value", F.col("target")) & (F.col("source") != F.col("target"))).select("source", "target", F.lit("environment").alias("kind")).distinct()
    host = F.regexp_extract("value", r"^[a-z][a-z0-9+.-]*://(?:[^@/]*@)?([^:/?#]+)", 1)
    outside = values.withColumn("target", host).where("target <> ''").join(services.select(F.col("name").alias("target")), "target", "left_anti").select("source", "target", F.lit("external").alias("kind")).distinct()
    return depends.unionByName(inside).unionByName(outside)


#: What an environment's key says of the protocol, and the addresses that name a host.
PROTOCOLS = (("redis", "redis"), ("mongo", "mongodb"), ("postgres", "postgresql"), ("database", "postgresql"), ("amqp", "amqp"), ("rabbit", "amqp"))
ADDRESS = r"(?:https?|postgres|mysql|mongodb|redis|amqp)://([^:/\s]+)"


def inferred_connections(services: DataFrame) -> DataFrame:
    """(project, source, target, protocol, description): what a service depends on, the services of its project that its
    environment's values name, and hosts outside that they address.

    A project's names meet its values as one array: a project is a handful of files, whatever the number of projects."""
    who = services.select("project", F.col("name").alias("source"), "depends_on", "environment")
    depends = who.select("project", "source", F.explode("depends_on").alias("target")).withColumns({"protocol": F.lit("tcp"), "description": F.concat("source", F.lit(" depends on "), "target")})
    names = services.groupBy("project").agg(F.collect_set("name").alias("names"))
    values = who.select("project", "source", F.explode("environment").alias("key", "value")).join(names, "project")
    low = F.lower("key")
    protocol = F.coalesce(*(F.when(F.contains(low, F.lit(word)), F.lit(name)) for word, name in PROTOCOLS), F.lit("tcp"))
    others = F.filter("names", lambda n: (n != F.col("source")) & F.contains(F.col("value"), n))
    inside = values.withColumn("target", F.explode(others)).select("project", "source", "target", protocol.alias("protocol"), F.concat("source", F.lit(" references "), "target", F.lit(" via "), "key").alias("description"))
    host = F.regexp_extract("value", ADDRESS, 1)
    outside = values.withColumn("target", host).where((F.col("target") != "") & ~F.array_contains("names", F.col("target")))
    outside = outside.select("project", "source", "target", F.split("value", "://")[0].alias("protocol"), F.concat("source", F.lit(" connects to external "), "target", F.lit(" via "), "key").alias("description"))
    return depends.unionByName(inside).unionByName(outside)


def trust_boundaries(services: DataFrame) -> DataFrame:
    """Services with ports (public), without (internal) and data stores by image (private, beside the other two): sorted
    names, and risks in the order of the names: sensitive ports, stores with ports, weak passwords of stores."""
    ports = F.coalesce("ports", F.array().cast("array<int>"))
    open_, store = F.size(ports) > 0, F.coalesce(F.col("image"), F.lit("")).rlike(f"(?i){STORES}")
    shown = F.when(F.exists(ports, lambda x: x.isin(*SENSITIVE_PORTS)), F.concat("name", F.lit(" exposes sensitive port(s): "), F.array_join(ports.cast("array<string>"), ", ")))
    weak = F.exists(F.map_values(F.coalesce("environment", F.create_map().cast("map<string,string>"))), lambda v: v.rlike(f"(?i){WEAK}"))
    reached = F.when(open_, F.concat("name", F.lit(" database port exposed publicly")))
    guessed = F.when(weak, F.concat("name", F.lit(" may have default/weak credentials")))

    def zone(which: Column, name: str, exposure: str, *risks: Column) -> DataFrame:
        own = services.where(which).select("name", F.array_compact(F.array(*risks)).alias("risks") if risks else F.array().cast("array<string>").alias("risks"))
        rows = own.groupBy().agg(F.array_sort(F.collect_list(F.struct("name", "risks"))).alias("x")).where(F.size("x") > 0)
        return rows.select(F.lit(name).alias("boundary"), F.lit(exposure).alias("exposure"), F.col("x.name").alias("services"), F.flatten("x.risks").alias("risks"))

    public, internal = zone(open_, "Public-facing services", "public", shown), zone(~open_, "Internal services", "internal")
    return public.unionByName(internal).unionByName(zone(store, "Data layer", "private", reached, guessed))


#: File endings of languages that are parsed.
PARSED = ("ts", "tsx", "cts", "mts", "js", "jsx", "cjs", "mjs")


def band_overlap(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets(file, first, last) with whether a match(file, start_line, end_line) overlaps them, ends included."""
    t, m = targets.alias("t"), matches.alias("m")
    hit = (F.col("t.file") == F.col("m.file")) & (F.col("m.start_line") <= F.col("t.last")) & (F.col("m.end_line") >= F.col("t.first"))
    return t.join(m, hit, "left_semi").withColumn("caught", F.lit(True)).unionByName(t.join(m, hit, "left_anti").withColumn("caught", F.lit(False)))


def calibrate(cases: DataFrame, seeds: DataFrame, matches: DataFrame, parsed: tuple[str, ...] = PARSED) -> DataFrame:
    """cases(case, alias, file, first, last; file null without a target) with total, overlapping, matched and skip_reason.

    A case is skipped without a target, without a seed pattern (seeds(case), by its own name or its alias), or if its file
    is of no language that is parsed. matches(case, start_line, end_line); ends of bands count."""
    alias = F.coalesce("alias", "case")
    known = seeds.select("case").distinct()
    seeded = cases.select("case", alias.alias("alias")).join(known.select(F.col("case").alias("a")), F.col("case") == F.col("a"), "left").join(known.select(F.col("case").alias("b")), F.col("alias") == F.col("b"), "left")
    seeded = seeded.select("case", (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("seeded")).distinct()
    out = cases.withColumn("alias", alias).join(seeded, "case")
    known_language = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)).isin(*parsed)
    reason = F.when(F.col("file").isNull(), "case has no calibration_target").when(~F.col("seeded"), F.concat(F.lit("no A1 seed pattern for "), F.col("alias"))).when(~known_language, F.concat(F.lit("unsupported language for file "), F.col("file")))
    out = out.withColumn("skip_reason", reason)
    hit = F.count_if((F.col("start_line") <= F.col("last")) & (F.col("end_line") >= F.col("first")))
    found = out.where("skip_reason is null").join(matches, "case").groupBy("case").agg(F.count("*").alias("total"), hit.alias("overlapping"))
    counted = out.join(found, "case", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("total", "overlapping")})
    return counted.select("case", "alias", "file", "first", "last", "total", "overlapping", (F.col("overlapping") > 0).alias("matched"), "skip_reason")
