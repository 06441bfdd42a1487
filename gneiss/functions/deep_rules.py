"""Families of rules beside the wired ones: one subject each, asked for by name or all together (DEEP).

Ids, severities, weaknesses, modes and file names are fixed values; the patterns are our own, written from what each rule
is for. Rules about something that is absent name the construct that asks for it; their window holds what clears them.
"""

from __future__ import annotations

from gneiss.functions.rules import _rules
from gneiss.operators.modes import Family

_JS2, _WEB, _JSPY = (".ts", ".js"), (".ts", ".tsx", ".js", ".jsx"), (".ts", ".js", ".py")
_IN = r"(req|request|ctx)\.(query|params|body|headers|url)|request\.(args|form|get|post|json)"
_SQL = r"(select\s.+\sfrom|insert\s+into|update\s+\w+\s+set|delete\s+from)"

CORS = Family("cors", "M1", _rules("cors", [
    ("cors-wildcard-origin", "high", 942, "Any origin may read responses", (r"access-control-allow-origin[\"']?\s*[:=,]\s*[\"']?\*", r"\borigin\s*:\s*(true|[\"']\*[\"'])")),
    ("cors-reflect-origin", "critical", 942, "The request's origin is sent back", (r"access-control-allow-origin.*(req|request)\.headers", r"\borigin\s*:\s*(req|request)\.")),
    ("cors-credentials-wildcard", "high", 942, "Credentials for any origin", (r"credentials\s*:\s*true.*origin\s*:\s*(true|[\"']?\*)", r"origin\s*:\s*(true|[\"']?\*).*credentials\s*:\s*true")),
    ("cors-null-origin", "medium", 942, "The null origin is allowed", (r"(origin|whitelist).*[\"']null[\"']", r"access-control-allow-origin.*\bnull\b")),
    ("cors-substring-match", "high", 942, "Origins compared by parts", (r"\borigin\.(includes|indexof|endswith|startswith)\s*\(",)),
    ("cors-preflight-cache-long", "low", 693, "Preflight answers kept for days", (r"access-control-max-age\D{0,5}\d{6,}", r"\bmaxage\s*:\s*(\d{6,}|infinity)")),
    ("cors-expose-all-headers", "medium", 200, "All response headers exposed", (r"access-control-expose-headers\W{1,6}\*", r"exposedheaders\s*:\s*\[?\s*[\"']\*")),
]), extensions=_JSPY, gate=r"cors|origin|access-control", confidence="high", wired=False, id_prefix="CORS")

SQLI = Family("sqli", "M1", _rules("sql-injection", [
    ("sqli-template-literal", "critical", 89, "Query in a template with values", (rf"`[^`]*{_SQL}[^`]*\$\{{",)),
    ("sqli-string-concat", "critical", 89, "Query put together from strings", (rf"[\"'][^\"']*{_SQL}[^\"']*[\"']\s*(\+|\.)\s*\$?\w",)),
    ("sqli-fstring-python", "critical", 89, "Query in a formatted string", (rf"\bf[\"'][^\"']*{_SQL}[^\"']*\{{", rf"[\"'][^\"']*{_SQL}[^\"']*[\"']\s*(%|\.format\()")),
    ("sqli-orm-raw", "critical", 89, "Raw query with values", (r"\.(raw|query|\$queryrawunsafe|\$executerawunsafe)\s*\(\s*(`[^`]*\$\{|f[\"'])",)),
    ("sqli-like-injection", "medium", 89, "Pattern of LIKE from input", (r"\blike\s+[\"']?%?\s*(\$\{|[\"']\s*\+|\{)",)),
    ("sqli-order-by", "high", 89, "Order from input", (rf"order\s+by\s+[\"'`]?\s*(\$\{{|[\"']?\s*\+\s*|\{{)", rf"\.orderby\s*\(\s*({_IN})")),
]), extensions=(".ts", ".js", ".py", ".go", ".java", ".php"), gate=r"select|insert|update|delete|query|execute|cursor|raw", confidence="high", wired=False, id_prefix="SQLI")

XSS = Family("xss", "M1", _rules("xss", [
    ("xss-dom-innerhtml", "high", 79, "Markup set from a value", (r"\.(inner|outer)html\s*\+?=\s*[^\"'`\s;]", r"\.(inner|outer)html\s*\+?=\s*`[^`]*\$\{")),
    ("xss-dom-document-write", "high", 79, "Markup written to the document", (r"document\.write(ln)?\s*\(", r"\.insertadjacenthtml\s*\(")),
    ("xss-react-dangerously", "high", 79, "Markup past the framework", (r"dangerouslysetinnerhtml",)),
    ("xss-href-javascript", "high", 79, "Script in an address", (r"href\s*=\s*[\"'{`]\s*javascript:", r"location(\.href)?\s*=\s*[\"'`]javascript:")),
    ("xss-eval-user", "critical", 79, "Input run as script", (rf"\b(eval|function|settimeout|setinterval)\s*\(\s*[^)]*({_IN}|location\.)",)),
    ("xss-template-unescaped", "high", 79, "Template value not escaped", (r"<%-", r"\{\{\{", r"\|\s*safe\b", r"\bv-html\s*=")),
    ("xss-json-inject", "medium", 79, "JSON inside of a script", (r"<script[^>]*>.*json\.stringify", r"window\.__\w+__\s*=\s*(json\.stringify|\$\{|<%)")),
    ("xss-postmessage", "high", 79, "Message used as markup", (r"event\.data.*innerhtml|innerhtml.*(event|e)\.data",)),
]), extensions=(*_WEB, ".html", ".ejs", ".hbs"), confidence="high", wired=False, id_prefix="XSS")

CMDI = Family("cmdi", "M1", _rules("command-injection", [
    ("cmdi-exec-template", "critical", 78, "Command in a template with values", (r"\bexec(sync)?\s*\(\s*`[^`]*\$\{",)),
    ("cmdi-exec-concat", "critical", 78, "Command put together from strings", (r"\bexec(sync)?\s*\(\s*[\"'][^\"']*[\"']\s*\+", rf"\bexec(sync)?\s*\(\s*({_IN})")),
    ("cmdi-spawn-shell", "high", 78, "Process with a shell", (r"\bspawn(sync)?\s*\(.*shell\s*:\s*true",)),
    ("cmdi-python-os-system", "critical", 78, "Command through the system call", (r"\bos\.(system|popen)\s*\(\s*(f[\"']|[\"'][^\"']*[\"']\s*(\+|%|\.format)|[a-z_]\w*)",)),
    ("cmdi-subprocess-shell", "high", 78, "Process with a shell", (r"\bsubprocess\.\w+\s*\(.*shell\s*=\s*true",)),
    ("cmdi-go-exec-command", "critical", 78, "Shell of a command", (r"\bexec\.command\s*\(\s*\"(/bin/)?(sh|bash|cmd)\"", r"\bexec\.command\s*\(\s*fmt\.sprintf")),
]), extensions=(".ts", ".js", ".py", ".go"), gate=r"exec|spawn|system|popen|subprocess", confidence="high", wired=False, id_prefix="CMDI")

SSTI = Family("ssti", "M1", _rules("ssti", [
    ("ssti-jinja2", "critical", 1336, "Template text from input", (r"render_template_string\s*\(\s*(f[\"']|request|[a-z_]\w*\s*[,)+%])", r"\b(jinja2\.)?template\s*\(\s*(request|f[\"'])")),
    ("ssti-ejs", "critical", 1336, "Template text from input", (rf"ejs\.(render|compile)\s*\(\s*({_IN}|`[^`]*\$\{{)",)),
    ("ssti-handlebars", "critical", 1336, "Template text from input", (rf"handlebars\.(compile|precompile)\s*\(\s*({_IN}|`[^`]*\$\{{)",)),
    ("ssti-pug", "critical", 1336, "Template text from input", (rf"(pug|jade)\.(render|compile)\s*\(\s*({_IN}|`[^`]*\$\{{)",)),
    ("ssti-nunjucks", "critical", 1336, "Template text from input", (rf"nunjucks\.renderstring\s*\(\s*({_IN}|`[^`]*\$\{{|\w+\s*[,)])",)),
    ("ssti-twig", "critical", 1336, "Template text from input", (r"createtemplate\s*\(\s*\$", r"twig.*\$_(get|post|request)")),
    ("ssti-go-template", "critical", 1336, "Template text from input", (r"template\.new\s*\([^)]*\)\.parse\s*\(\s*(r\.|fmt\.sprintf|[a-z]\w*\s*\))",)),
]), extensions=(".ts", ".js", ".py", ".go", ".php"), gate=r"template|render|ejs|handlebars|pug|jade|nunjucks|twig", confidence="high", wired=False, id_prefix="SSTI")

NOSQL = Family("nosql", "M1", _rules("nosql-injection", [
    ("nosql-operator-injection", "critical", 943, "Query object from input", (rf"\.(find|findone|update\w*|delete\w*|count\w*)\s*\(\s*({_IN})", rf"\.(find|findone)\s*\(\s*\{{[^}}]*:\s*({_IN})")),
    ("nosql-where-string", "critical", 943, "Condition as script", (r"\$where[\"']?\s*:\s*([\"'`]|function|\w+)",)),
    ("nosql-regex-injection", "high", 943, "Pattern from input", (rf"\$regex[\"']?\s*:\s*({_IN}|new\s+regexp)",)),
    ("nosql-mapreduce", "critical", 94, "Script of a map and reduce", (r"\.mapreduce\s*\(",)),
    ("nosql-aggregate-lookup", "high", 943, "Pipeline from input", (rf"\.aggregate\s*\(\s*({_IN})", rf"\$lookup.*({_IN})")),
]), extensions=_JS2, gate=r"mongo|collection|aggregate|find\(|findone|mapreduce", confidence="high", wired=False, id_prefix="NOSQL")

REDIRECT = Family("redirect", "M1", _rules("open-redirect", [
    ("redirect-user-input", "medium", 601, "Address from input", (rf"redirect\s*\(\s*(\d+\s*,\s*)?({_IN})", r"http\.redirect\s*\([^)]*r\.(url\.query|formvalue)", rf"location\.(href|assign|replace)\s*[=(]\s*({_IN})")),
    ("redirect-protocol-relative", "medium", 601, "Check that // passes", (r"\.startswith\s*\(\s*[\"']/[\"']\s*\)",)),
    ("redirect-header-injection", "high", 113, "Location header from input", (rf"(setheader|writehead|header)\s*\(.*location.*({_IN})",)),
    ("redirect-meta-refresh", "medium", 601, "Refresh to an address from input", (r"http-equiv\s*=\s*[\"']?refresh.*(\$\{|<%|\{\{)",)),
]), extensions=(*_WEB, ".py", ".go"), gate=r"redirect|location|refresh", wired=False, id_prefix="REDIR")

UPLOAD = Family("upload", "M3", _rules("upload", [
    ("upload-no-type-check", "high", 434, "Upload of any type", (r"\bmulter\s*\(\s*(\)|\{(?![^}]*filefilter))",)),
    ("upload-no-size-limit", "medium", 770, "Upload of any size", (r"\bmulter\s*\(\s*(\)|\{(?![^}]*limits))", r"\bformidable\s*\(\s*\)")),
    ("upload-path-traversal", "critical", 22, "Path from the upload's name", (r"(path\.join|writefile\w*|createwritestream|rename|\.mv|\.save|open)\s*\([^)]*(originalname|\.filename|file\.name)",)),
    ("upload-executable", "high", 434, "Programs among allowed types", (r"(allowed|accept)\w*\s*[:=].*\.(php|exe|sh|jsp|asp)\b",)),
    ("upload-public-dir", "high", 434, "Uploads in a public folder", (r"(dest|destination|upload_folder)\s*[:=].*(public|static|www)",)),
]), extensions=_JSPY, gate=r"upload|multer|formidable|file", wired=False, id_prefix="UPLOAD")

XXE = Family("xxe", "M3", _rules("xxe", [
    ("xxe-dom-parser", "high", 611, "Parser with entities", (r"\b(domparser|xmldom|xml2js|libxmljs)\b.*(parse|noent\s*:\s*true)", r"parsexml\w*\s*\(.*noent\s*:\s*true")),
    ("xxe-libxml", "high", 611, "Parser with entities", (r"resolve_entities\s*=\s*true", r"\b(lxml\.)?etree\.(parse|fromstring)\s*\(", r"xml\.sax\.parse")),
    ("xxe-java-sax", "high", 611, "Parser without limits", (r"\b(saxparserfactory|documentbuilderfactory|xmlinputfactory)\.(newinstance|newfactory)\s*\(",)),
    ("xxe-xslt", "critical", 611, "Style sheet from input", (rf"(transformerfactory|xslt|xslprocess)\w*.*({_IN}|newinstance)",)),
    ("xxe-svg", "medium", 611, "Vector image taken as it comes", (r"image/svg\+xml.*(upload|accept|allow)|(upload|accept|allow).*image/svg\+xml",)),
]), extensions=(".ts", ".js", ".py", ".java"), gate=r"xml|svg|xslt|parser", wired=False, id_prefix="XXE")

OAUTH = Family("oauth", "M3", _rules("oauth", [
    ("oauth-no-state", "high", 352, "Authorization without state", (r"(authorize|authorization)\w*\?(?!.*state=).*response_type=", r"response_type=code(?!.*state=)")),
    ("oauth-implicit-flow", "high", 319, "Implicit flow", (r"response_type\W{1,6}token\b",)),
    ("oauth-no-pkce", "medium", 287, "Code flow without a challenge", (r"grant_type\W{1,6}authorization_code(?!.*code_verifier)",)),
    ("oauth-token-in-url", "high", 598, "Token in an address", (r"[?&](access_token|id_token)=", r"location\.hash.*access_token")),
    ("oauth-callback-open-redirect", "critical", 601, "Redirect address from input", (rf"redirect_uri\W{{1,6}}({_IN})",)),
    ("oauth-client-secret-exposed", "critical", 798, "Client secret in source", (r"client_?secret[\"']?\s*[:=]\s*[\"'][a-z0-9_\-]{8,}[\"']",)),
    ("oauth-no-token-expiry-check", "medium", 613, "Token used without its end", (r"ignoreexpiration\s*:\s*true", r"verify_exp[\"']?\s*:\s*false")),
]), extensions=(*_WEB, ".py"), gate=r"oauth|authorize|redirect_uri|client_id|access_token|jwt", wired=False, id_prefix="OAUTH")

GRAPHQL = Family("graphql", "M3", _rules("graphql", [
    ("gql-introspection-enabled", "medium", 200, "Introspection on", (r"introspection\s*:\s*true",)),
    ("gql-no-depth-limit", "high", 770, "Queries of any depth", (r"new\s+apolloserver\s*\((?!.*depthlimit)", r"graphqlhttp\s*\((?!.*depthlimit)")),
    ("gql-no-cost-analysis", "medium", 770, "Queries of any cost", (r"new\s+apolloserver\s*\((?!.*(cost|complexity))",)),
    ("gql-no-rate-limit", "medium", 307, "Queries at any rate", (r"(app\.use|router\.use)\s*\(\s*[\"']/graphql[\"'](?!.*limit)",)),
    ("gql-batching-enabled", "low", 770, "Batches on", (r"allowbatchedhttprequests\s*:\s*true", r"batch\s*:\s*true")),
    ("gql-no-field-auth", "high", 285, "Mutation without a check", (r"(delete|update|create)\w+\s*:\s*(async\s*)?\(\s*_?\w*\s*,\s*\w+\s*\)\s*=>",)),
    ("gql-debug-mode", "medium", 209, "Debugging on", (r"(playground|graphiql|debug|includestacktraceinerrorresponses)\s*:\s*true",)),
    ("gql-sql-in-resolver", "critical", 89, "Query of values in a resolver", (rf"(args|input)\.\w+.*{_SQL}|{_SQL}.*\$\{{\s*(args|input)\.",)),
]), extensions=_JSPY, gate=r"graphql|apollo|gql|resolver|typedefs", wired=False, id_prefix="GQL")

INPUT = Family("input", "M1", _rules("input-validation", [
    ("input-no-schema", "medium", 20, "Body used as it comes", (r"=\s*req\.body\s*;?\s*$", r"(create|insert|save)\s*\(\s*req\.body\s*\)")),
    ("input-no-type-check", "medium", 20, "Parameter without a type", (r"\w+\s*=\s*req\.(query|params)\.\w+\s*;?\s*$",)),
    ("input-no-length-limit", "medium", 770, "Text of any length", (r"express\.(json|text|urlencoded)\s*\(\s*\)",)),
    ("input-no-email-validation", "low", 20, "Address not checked", (r"email\s*[:=]\s*req\.body\.email",)),
    ("input-direct-db-query", "high", 89, "Input straight to the store", (r"\.(query|execute|find\w*|where)\s*\(\s*req\.(body|query|params)",)),
    ("input-no-sanitize-html", "high", 79, "Input sent back as markup", (r"\.(send|write|end)\s*\(\s*(`[^`]*\$\{\s*)?req\.(body|query|params)",)),
    ("input-url-no-validate", "high", 20, "Address from input", (r"(fetch|axios(\.\w+)?|got|new\s+url)\s*\(\s*req\.(body|query|params)",)),
    ("input-array-no-limit", "medium", 770, "List of any length", (r"req\.body\.\w+\.(map|foreach|filter|reduce)\s*\(",)),
]), extensions=_JS2, gate=r"req\.(body|query|params)|express\.", wired=False, id_prefix="INPUT")

LOGGING = Family("log", "M1", _rules("logging", [
    ("log-injection", "medium", 117, "Input in a log line", (rf"(console|logger|log|logging)\.\w+\s*\([^)]*({_IN})",)),
    ("log-sensitive-data", "high", 532, "Secret in a log line", (r"(console|logger|log|logging)\.\w+\s*\([^)]*\b(password|secret|token|api_?key|ssn|credit_?card)\b",)),
    ("log-no-security-events", "medium", 778, "Refusal without a record", (r"return\s+res\.status\(\s*(401|403)\s*\)",)),
    ("log-error-details-exposed", "medium", 209, "Details of an error sent out", (r"res\.(send|json|status\(\d+\)\.(send|json))\s*\([^)]*(err|error)\.(stack|message)",)),
    ("log-console-in-prod", "low", 778, "Output by console", (r"\bconsole\.(log|debug)\s*\(",)),
]), extensions=_JSPY, wired=False, id_prefix="LOG")

WEBSOCKET = Family("ws", "M3", _rules("websocket", [
    ("ws-no-auth", "high", 306, "Connection without a check", (r"\.on\s*\(\s*[\"']connection[\"']\s*,\s*(async\s*)?(function\s*)?\(?\s*\w+\s*\)?",)),
    ("ws-no-origin-check", "high", 346, "Any origin may connect", (r"new\s+websocket(server|\.server)\s*\((?!.*verifyclient)", r"cors\s*:\s*\{\s*origin\s*:\s*[\"']\*")),
    ("ws-no-message-validation", "medium", 20, "Message used as it comes", (r"json\.parse\s*\(\s*(message|msg|data|event\.data)\s*\)",)),
    ("ws-no-size-limit", "medium", 770, "Messages of any size", (r"new\s+websocket(server|\.server)\s*\((?!.*maxpayload)",)),
    ("ws-no-rate-limit", "medium", 799, "Messages at any rate", (r"\.on\s*\(\s*[\"']message[\"']",)),
    ("ws-broadcast-unfiltered", "high", 79, "Message sent on to all", (r"clients\.foreach.*\.send\s*\(", r"io\.emit\s*\([^)]*(message|msg|data)")),
    ("ws-eval-message", "critical", 95, "Message run as script", (r"\beval\s*\(\s*(message|msg|data|event\.data)",)),
]), extensions=_JS2, gate=r"websocket|socket\.io|\bws\b", wired=False, id_prefix="WS")

ZERO_TRUST = Family("zt", "M1", _rules("zero-trust", [
    ("zt-implicit-trust", "high", 287, "Trust by place", (r"(is_?internal|trusted|from_?internal)\w*\s*(=|:|\(|&&|\?)", r"trust\s+proxy[\"']\s*,\s*true")),
    ("zt-no-mtls", "medium", 295, "Peers not checked", (r"rejectunauthorized\s*:\s*false", r"verify\s*=\s*false", r"insecureskipverify\s*:\s*true")),
    ("zt-overprivileged-service", "high", 250, "Service with all rights", (r"(role|permission|scope)s?\W{1,4}[\"']?(admin|root|\*)[\"']?\s*[,;}\]]?\s*$", r"cluster-admin")),
    ("zt-no-network-policy", "medium", 284, "Open to any address", (r"0\.0\.0\.0/0", r"\bhost\W{1,4}0\.0\.0\.0")),
    ("zt-ip-trust", "medium", 290, "Trust by address", (r"(req\.ip|remoteaddress|remote_addr|x-forwarded-for).*(===?|in\s|includes|startswith)",)),
    ("zt-no-service-auth", "high", 306, "Call of a service without a check", (r"(fetch|axios\.\w+|requests\.\w+|http\.get)\s*\(\s*[\"'`]http://[a-z0-9-]+(:\d+)?/",)),
    ("zt-shared-secret", "medium", 798, "One secret for all services", (r"(shared|internal|service)_?(secret|key|token)\s*[:=]\s*[\"'][^\"']+[\"']",)),
    ("zt-no-request-signing", "high", 345, "Hook without a signature", (r"(app|router)\.post\s*\(\s*[\"'`][^\"'`]*webhook",)),
]), extensions=(*_JSPY, ".go", ".java", ".yaml", ".yml", ".tf"), confidence="high", wired=False, id_prefix="ZT")

PERMISSION = Family("perm", "M1", _rules("permissions", [
    ("perm-world-writable", "high", 732, "Anyone may write", (r"chmod\w*\s*\([^)]*(0o?)?777", r"chmod\s+(-r\s+)?777", r"mode\s*[:=]\s*0?o?777")),
    ("perm-temp-file-insecure", "medium", 377, "Temporary file by a known name", (r"(open|writefile\w*|createwritestream)\s*\(\s*[\"'`]/tmp/", r"\bmktemp\s*\(")),
    ("perm-umask-zero", "high", 732, "No mask", (r"umask\s*\(?\s*0+o?0*\)?\s*;?\s*$",)),
    ("perm-private-key-readable", "high", 732, "Key that others may read", (r"\.(pem|key)\b.*(0o?)?(644|664|666|755|777)", r"chmod.*(644|755|777).*\.(pem|key)\b")),
    ("perm-directory-listing", "medium", 548, "Folder shown to all", (r"serveindex\s*\(", r"autoindex\s+on", r"directory\s*:\s*true", r"http\.fileserver\s*\(\s*http\.dir")),
]), extensions=(".ts", ".js", ".py", ".go"), gate=r"chmod|tmp|umask|mode|\.pem|\.key|serveindex|fileserver|directory|autoindex", wired=False, id_prefix="PERM")

MEMORY = Family("mem", "M3", _rules("memory-safety", [
    ("mem-buffer-overflow", "critical", 120, "Copy without a bound", (r"\b(strcpy|strcat|sprintf|vsprintf|gets)\s*\(",)),
    ("mem-format-string", "critical", 134, "Format from a value", (r"\bf?printf\s*\(\s*(stderr\s*,\s*)?[a-z_]\w*\s*\)", r"\bsyslog\s*\([^,]+,\s*[a-z_]\w*\s*\)")),
    ("mem-malloc-no-check", "medium", 252, "Allocation not checked", (r"=\s*(\([^)]*\)\s*)?(malloc|calloc|realloc)\s*\(",)),
    ("mem-use-after-free", "critical", 416, "Use after free", (r"\bfree\s*\(\s*(\w+)\s*\)\s*;.*\b\1\b\s*(->|\[|\.)",)),
    ("mem-double-free", "critical", 415, "Freed twice", (r"\bfree\s*\(\s*(\w+)\s*\)\s*;.*\bfree\s*\(\s*\1\s*\)",)),
    ("mem-integer-overflow", "high", 190, "Size from a product", (r"\b(malloc|alloca)\s*\(\s*\w+\s*\*\s*\w+",)),
]), extensions=(".c", ".h", ".cc", ".cpp", ".hpp"), wired=False, id_prefix="MEM")

MEMORY_RUST = Family("mem", "M3", _rules("memory-safety", [
    ("mem-rust-unsafe", "medium", 119, "Unsafe block", (r"\bunsafe\s*(\{|fn\b|impl\b)",)),
    ("mem-rust-raw-pointer", "high", 119, "Raw pointer", (r"\*(const|mut)\s+\w+", r"\bfrom_raw(_parts)?\s*\(")),
    ("mem-rust-transmute", "high", 704, "Transmutation", (r"\btransmute(_copy)?\s*(::<[^>]*>)?\s*\(",)),
]), extensions=(".rs",), wired=False, id_prefix="MEM")

DNS = Family("dns", "M3", _rules("dns-rebinding", [
    ("dns-localhost-only-no-host-check", "high", 350, "Local server that takes any host name", (r"\.listen\s*\([^)]*(127\.0\.0\.1|localhost)", r"\.run\s*\([^)]*host\s*=\s*[\"'](127\.0\.0\.1|localhost)")),
    ("dns-cors-localhost", "medium", 942, "Local origins allowed", (r"(origin|allow-origin)\W{1,6}.*https?://(localhost|127\.0\.0\.1)",)),
    ("dns-internal-api-no-auth", "high", 306, "Internal path without a check", (r"(app|router)\.(get|post|put|delete|use)\s*\(\s*[\"'`]/(internal|admin|debug|metrics)(?!.*auth)",)),
    ("dns-dev-server-exposed", "medium", 668, "Development server for all", (r"(devserver|vite|webpack).*host\W{1,4}(0\.0\.0\.0|true)", r"allowedhosts\W{1,4}(all|true)")),
]), extensions=_JSPY, gate=r"listen|localhost|127\.0\.0\.1|host|internal", wired=False, id_prefix="DNS")

EMAIL = Family("email", "M3", _rules("email", [
    ("email-header-injection", "high", 93, "Header from input", (rf"(to|from|cc|bcc|subject|replyto)\s*[:=]\s*({_IN})",)),
    ("email-html-no-sanitize", "medium", 79, "Markup with values", (r"\bhtml\s*[:=]\s*(`[^`]*\$\{|f[\"'])",)),
    ("email-smtp-credentials", "high", 798, "Mail password in source", (r"(smtp|mail|transport)\w*.*pass(word)?\s*[:=]\s*[\"'][^\"']+[\"']", r"auth\s*:\s*\{[^}]*pass\s*:\s*[\"'][^\"']+[\"']")),
    ("email-enumeration", "medium", 204, "Answer that tells who is known", (r"(user|email|account)\s+(not\s+found|does\s+not\s+exist|already\s+(exists|registered))",)),
]), extensions=_JSPY, gate=r"mail|smtp|sendgrid|ses\b", wired=False, id_prefix="EMAIL")

CLICKJACKING = Family("cj", "M3", _rules("clickjacking", [
    ("cj-iframe-allow", "medium", 1021, "Frames of any site", (r"x-frame-options\W{1,6}allow", r"frame-ancestors\s+\*", r"frameguard\s*:\s*false")),
    ("cj-sandbox-bypass", "low", 1021, "Sandbox that a frame can leave", (r"sandbox\s*=\s*[\"'][^\"']*allow-scripts[^\"']*allow-same-origin",)),
    ("cj-window-opener", "medium", 1022, "Window that can reach its opener", (r"target\s*=\s*[\"']_blank[\"'](?!.*noopener)", r"window\.open\s*\((?!.*noopener)")),
]), extensions=(*_WEB, ".html"), gate=r"frame|sandbox|_blank|window\.open", wired=False, id_prefix="CJ")

CACHE = Family("cache", "M3", _rules("cache", [
    ("cache-sensitive-data", "high", 524, "Secret in a cache", (r"cache\.(set|put|add)\s*\([^)]*(password|token|secret|session|ssn|card)",)),
    ("cache-no-control-header", "medium", 525, "Private answer without cache rules", (r"res\.(json|send)\s*\([^)]*(user|account|profile|token)",)),
    ("cache-poisoning-host", "high", 444, "Address from the host header", (r"(req\.headers\.host|x-forwarded-host|request\.host)\b.*(url|href|link|redirect|\+|\$\{)",)),
    ("cache-auth-data-shared", "high", 524, "Private answer in shared caches", (r"cache-control\W{1,6}public", r"s-maxage=\d+")),
    ("cache-no-vary", "medium", 524, "Answer by language or session without Vary", (r"res\.(setheader|set|header)\s*\(\s*[\"']cache-control[\"'](?!.*vary)",)),
]), extensions=_JSPY, gate=r"cache", wired=False, id_prefix="CACHE")

SUBDOMAIN = Family("sub", "M3", _rules("subdomain", [
    ("sub-wildcard-cors", "high", 942, "All subdomains trusted", (r"origin.*\*\.\w+", r"\.endswith\s*\(\s*[\"']\.?\w+\.\w+[\"']\s*\)")),
    ("sub-cookie-parent-domain", "medium", 1275, "Cookie of the parent domain", (r"\bdomain\s*[:=]\s*[\"']\.\w+\.\w+",)),
    ("sub-postmessage-no-origin", "high", 345, "Message for any origin", (r"postmessage\s*\([^)]*,\s*[\"']\*[\"']", r"addeventlistener\s*\(\s*[\"']message[\"'](?!.*origin)")),
]), extensions=_WEB, gate=r"origin|domain|postmessage|message", wired=False, id_prefix="SUB")

DEEP = (SQLI, XSS, CMDI, SSTI, NOSQL, CORS, REDIRECT, UPLOAD, XXE, OAUTH, GRAPHQL, INPUT, LOGGING, WEBSOCKET, ZERO_TRUST, PERMISSION, MEMORY, MEMORY_RUST, DNS, EMAIL, CLICKJACKING, CACHE, SUBDOMAIN)
