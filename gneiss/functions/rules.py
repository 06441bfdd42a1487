"""The rule catalogue: families of rules as data, and rules that users write.

Patterns are our own, written from what each rule is for; they stay within what Java and RE2 share wherever a plain
line test is enough.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from gneiss.operators.modes import Family, Rule
from gneiss.sources import yamlfiles

MAX_CUSTOM = 2_000

JS = (".ts", ".tsx", ".js", ".jsx")
TS_JS_PY = (".ts", ".js", ".py")


def _rules(category: str, rows: Iterable[tuple]) -> tuple[Rule, ...]:
    """(id, severity, CWE number or None, title, patterns[, more fields])."""
    return tuple(Rule(id=i, title=t, severity=s, patterns=(p,) if isinstance(p, str) else tuple(p), cwe=f"CWE-{c}" if c else None, category=category, **(more[0] if more else {})) for i, s, c, t, p, *more in rows)


#: What the driver's text tables hold: license lines, credentials, addresses, page scripts.
CORPUS = Family("", "M1", _rules("content", [
    ("license-line", "info", None, "License line", (r"licensed under", r"all rights reserved")),
    ("credential-assignment", "critical", 798, "Credential in an assignment", (r"(password|secret|token|api_?key) ?[:=] ?[\"'][A-Za-z0-9+/_.=-]{8,}",)),
    ("email-address", "medium", 359, "E-mail address", (r"[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z]{2,}",)),
    ("inline-script", "low", 79, "Inline script", (r"<script",)),
    ("ip-address", "low", 359, "IPv4 address", (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",)),
]), cap=None)

_SQL = r"(select|insert|update|delete)\b[^;]{0,80}"
_REQ = r"(req|request|ctx|params|query|body)\b[.\[]"
PATTERN = Family("", "M1", (
    *_rules("injection", [
        ("sql-injection", "critical", 89, "SQL built from input", (rf"(query|execute)\s*\(\s*[`\"']\s*{_SQL}\$\{{", rf"[\"']\s*{_SQL}[\"']\s*\+"), {"languages": ("typescript", "javascript", "python")}),
        ("command-injection", "critical", 78, "Shell command from input", (r"\bexec(sync)?\s*\(\s*`[^`]*\$\{", r"os\.system\s*\(\s*f?[\"'].*[{+%]", r"subprocess\.\w+\([^)]*shell\s*=\s*true")),
        ("nosql-injection", "high", 943, "Query object from input", (rf"\.(find|findone|updateone|deleteone)\s*\(\s*{_REQ}",), {"languages": ("typescript", "javascript")}),
        ("eval-usage", "high", 95, "Evaluation of text as code", (r"\beval\s*\(", r"new\s+function\s*\("), {"languages": ("typescript", "javascript", "python")}),
        ("go-sql-injection", "critical", 89, "SQL from Sprintf", (rf"sprintf\s*\(\s*\"\s*{_SQL}%[sv]",), {"languages": ("go",)}),
        ("go-command-injection", "critical", 78, "Shell through exec.Command", (r"exec\.command\s*\(\s*\"(sh|bash)\"",), {"languages": ("go",)}),
        ("java-sql-injection", "critical", 89, "Concatenated statement", (rf"\.(executequery|executeupdate|createquery)\s*\(\s*\"{_SQL}\"\s*\+",), {"languages": ("java",)}),
        ("php-sql-injection", "critical", 89, "SQL from request data", (rf"mysqli?_query\s*\([^)]*\$_(get|post|request)", rf"\"{_SQL}\$_(get|post|request)"), {"languages": ("php",)}),
        ("php-command-injection", "critical", 78, "Shell command from request data", (r"\b(system|exec|passthru|shell_exec)\s*\([^)]*\$_(get|post|request)",), {"languages": ("php",)}),
        ("php-eval", "high", 95, "Evaluation of text as code", (r"\beval\s*\(\s*\$",), {"languages": ("php",)}),
    ]),
    *_rules("xss", [
        ("xss-unescaped", "high", 79, "Unescaped output", (r"\.innerhtml\s*=\s*[^\"'`;]", r"dangerouslysetinnerhtml", r"document\.write\s*\("), {"languages": ("typescript", "javascript")}),
        ("php-xss", "high", 79, "Request data echoed", (r"echo\s+\$_(get|post|request)",), {"languages": ("php",)}),
    ]),
    *_rules("access", [
        ("path-traversal", "high", 22, "Path from input", (rf"(readfile|writefile|createreadstream|sendfile)(sync)?\s*\([^)]*{_REQ}", r"\bopen\s*\(\s*request\.")),
        ("ssrf", "high", 918, "Request to an address from input", (rf"(fetch|axios\.\w+|requests\.\w+|http\.get)\s*\(\s*{_REQ}",)),
        ("open-redirect", "medium", 601, "Redirect to an address from input", (rf"redirect\s*\(\s*{_REQ}",)),
        ("php-file-inclusion", "critical", 98, "Included file from request data", (r"\b(include|require)(_once)?\s*\(?\s*\$_(get|post|request)",), {"languages": ("php",)}),
    ]),
    *_rules("secrets", [
        ("hardcoded-secret", "high", 798, "Secret in source", (r"(password|secret|api_?key|access_?token)\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']",)),
        ("go-hardcoded-credential", "high", 798, "Secret in source", (r"(password|secret|apikey|token)\s*:?=\s*\"[^\"]{8,}\"",), {"languages": ("go",)}),
        ("jwt-none-alg", "critical", 345, "Unsigned tokens accepted", (r"alg(orithm)?s?[\"']?\s*[:=]\s*\[?\s*[\"']none",)),
    ]),
    *_rules("crypto", [
        ("weak-crypto", "medium", 327, "Weak hash or cipher", (r"createhash\s*\(\s*[\"'](md5|sha1)", r"hashlib\.(md5|sha1)\s*\(", r"\b(des|rc4)-")),
        ("java-weak-crypto", "medium", 327, "Weak hash or cipher", (r"getinstance\s*\(\s*\"(md5|sha-?1|des)",), {"languages": ("java",)}),
    ]),
    *_rules("config", [
        ("insecure-cookie", "medium", 614, "Cookie without protection", (r"httponly\s*:\s*false", r"secure\s*:\s*false")),
        ("java-xxe", "high", 611, "XML parser with default entities", (r"documentbuilderfactory\.newinstance\s*\(", r"saxparserfactory\.newinstance\s*\("), {"languages": ("java",)}),
        ("java-deserialization", "critical", 502, "Object stream from outside", (r"new\s+objectinputstream\s*\(",), {"languages": ("java",)}),
    ]),
), id_prefix="SPX")

FRAMEWORK = Family("", "M1", _rules("framework", [
    ("react-href-injection", "high", 79, "Link target from data", (r"href\s*=\s*\{\s*(props|user|data|params)\b",)),
    ("next-exposed-env", "high", 200, "Secret in a public variable", (r"next_public_\w*(secret|key|token|password)",)),
    ("next-unsafe-redirect", "medium", 601, "Redirect from the query", (r"router\.(push|replace)\s*\(\s*(router\.)?query",)),
    ("react-ref-dom-xss", "high", 79, "HTML through a ref", (r"\.current\.innerhtml\s*=",)),
    ("express-session-insecure", "medium", 614, "Session cookie without protection", (r"session\s*\(\s*\{[^}]*secure\s*:\s*false",)),
    ("express-cors-wildcard", "medium", 942, "Any origin allowed", (r"cors\s*\(\s*\)", r"cors\s*\(\s*\{[^}]*origin\s*:\s*[\"']\*")),
    ("express-body-limit", "low", 770, "Body without a limit", (r"express\.json\s*\(\s*\)", r"bodyparser\.json\s*\(\s*\)")),
    ("django-raw-sql", "critical", 89, "Raw query with formatting", (r"\.raw\s*\(\s*f[\"']", r"\.extra\s*\(", r"cursor\.execute\s*\(\s*f[\"']")),
    ("django-debug-true", "high", 215, "Debug mode on", (r"^\s*debug\s*=\s*true",)),
    ("django-csrf-exempt", "medium", 352, "Request forgery protection off", (r"@csrf_exempt",)),
    ("django-mark-safe", "high", 79, "Escaping off", (r"mark_safe\s*\(", r"\|\s*safe\b")),
    ("django-secret-key-exposed", "high", 798, "Secret key in settings", (r"^\s*secret_key\s*=\s*[\"'][^\"']+",)),
    ("flask-debug-mode", "critical", 215, "Debug mode on", (r"app\.run\s*\([^)]*debug\s*=\s*true",)),
    ("flask-render-string", "critical", 1336, "Template from text", (r"render_template_string\s*\(",)),
    ("flask-open-redirect", "medium", 601, "Redirect to request data", (r"redirect\s*\(\s*request\.(args|form)",)),
    ("spring-sqli", "critical", 89, "Concatenated query", (r"@query\s*\(\s*\"[^\"]*\"\s*\+", r"jdbctemplate\.\w+\s*\(\s*\"[^\"]*\"\s*\+")),
    ("spring-el-injection", "critical", 917, "Expression from input", (r"parseexpression\s*\(",)),
    ("spring-csrf-disabled", "medium", 352, "Request forgery protection off", (r"csrf\s*\(\s*\)\s*\.\s*disable", r"csrf\.disable")),
    ("spring-cors-allow-all", "medium", 942, "Any origin allowed", (r"@crossorigin\s*(\(\s*\"\*\"|$)", r"allowedorigins\s*\(\s*\"\*\"")),
    ("go-template-injection", "critical", 1336, "Unescaped template text", (r"template\.html\s*\(",)),
    ("go-insecure-tls", "high", 295, "Certificates not checked", (r"insecureskipverify\s*:\s*true",)),
    ("prototype-pollution", "high", 1321, "Merge of input into an object", (r"object\.assign\s*\(\s*\{\s*\}\s*,\s*req\.", r"__proto__")),
    ("mass-assignment", "high", 915, "Record made of the whole body", (r"\.(create|update)\s*\(\s*req\.body\s*\)",)),
    ("timing-attack", "medium", 208, "Secrets compared by ==", (r"(token|secret|hash|signature)\s*={2,3}\s*\w",)),
    ("unhandled-promise", "low", 755, "Promise without a handler", (r"\.then\s*\([^)]*\)\s*;?\s*$",)),
]))

API = Family("api", "M1", _rules("api-security", [
    ("api-bola-idor", "critical", 639, "Record by id from input, without owner", (r"findbyid\s*\(\s*req\.params", r"get_object_or_404\s*\([^)]*id\s*=")),
    ("api-broken-auth", "high", 287, "Route without authentication", (r"(app|router)\.(post|put|delete)\s*\(\s*[\"'][^\"']*(admin|user|account)[^\"']*[\"']\s*,\s*(async\s*)?\(",)),
    ("api-data-exposure", "high", 213, "Whole record in a reply", (r"res\.json\s*\(\s*user\s*\)",)),
    ("api-mass-assignment", "high", 915, "Record made of the whole body", (r"\.(create|update|findbyidandupdate)\s*\([^)]*req\.body\s*\)",)),
    ("api-no-rate-limit", "medium", 307, "Login without a rate limit", (r"\.post\s*\(\s*[\"'][^\"']*(login|signin|reset)",)),
    ("api-no-validation", "medium", 20, "Body used without validation", (r"(const|let|var)\s*\{[^}]+\}\s*=\s*req\.body",)),
    ("api-ssrf", "high", 918, "Request to an address from input", (r"(fetch|axios(\.\w+)?)\s*\(\s*req\.(body|query|params)",)),
    ("api-log-sensitive", "medium", 532, "Secret in a log", (r"(console\.\w+|logger?\.\w+)\s*\([^)]*(password|token|secret)",)),
    ("api-no-pagination", "medium", 770, "List without a limit", (r"\.find\s*\(\s*\{?\s*\}?\s*\)\s*;?\s*$",)),
    ("api-cors-wildcard", "medium", 942, "Any origin allowed", (r"access-control-allow-origin[\"']?\s*[,:]\s*[\"']\*",)),
    ("api-broken-function-auth", "high", 285, "Administration without a role check", (r"\.(get|post|put|delete)\s*\(\s*[\"']/(admin|manage|internal|system|config)(?!.*(role|admin\b|permission|authori[sz]e|rbac)\w*\s*[(,])",)),
    ("api-missing-headers", "low", 693, "Bodies parsed, no header guard in use", (r"\.use\s*\(\s*express\.json\s*\((?!.*helmet)",)),
]), extensions=(*JS, ".py", ".go", ".java"), gate=r"(app|router)\.|@(get|post|request)mapping|def \w+\(request|res\.json|fetch", confidence="high", id_prefix="API")

CRYPTO = Family("crypto", "M1", _rules("crypto", [
    ("crypto-weak-hash", "high", 328, "Weak hash", (r"createhash\s*\(\s*[\"'](md5|sha1|md4)", r"hashlib\.(md5|sha1)", r"messagedigest\.getinstance\s*\(\s*\"(md5|sha-?1)")),
    ("crypto-weak-cipher", "high", 327, "Weak cipher", (r"createcipher(iv)?\s*\(\s*[\"'](des|rc4|rc2|bf)", r"cipher\.getinstance\s*\(\s*\"(des|rc4)")),
    ("crypto-ecb-mode", "high", 327, "ECB mode", (r"aes-\d+-ecb", r"mode_ecb", r"aes/ecb")),
    ("crypto-hardcoded-iv", "high", 329, "Fixed initial vector", (r"\biv\s*[:=]\s*(buffer\.from\s*\(\s*)?b?[\"']",)),
    ("crypto-hardcoded-key", "critical", 321, "Fixed key", (r"(encryption_?key|secret_?key|aes_?key)\s*[:=]\s*[\"'][^\"']{8,}",)),
    ("crypto-weak-random", "high", 330, "Predictable random value", (r"math\.random\s*\(\s*\).*(token|secret|key|password|session)", r"(token|secret|key|session)\w*\s*=.*math\.random", r"random\.(random|randint)\s*\(.*(token|secret)")),
    ("crypto-timing-attack", "medium", 208, "Secrets compared by ==", (r"(hmac|signature|digest)\s*={2,3}",)),
    ("crypto-no-padding", "medium", 327, "Padding off", (r"setautopadding\s*\(\s*false", r"/nopadding")),
    ("crypto-deprecated-tls", "high", 326, "Old protocol version", (r"tlsv1(\.[01])?[\"'_]", r"sslv[23]")),
    ("crypto-insecure-key-derivation", "high", 916, "Few iterations", (r"pbkdf2\w*\s*\([^)]*,\s*[0-9]{1,4}\s*,",)),
    ("crypto-small-key-size", "medium", 326, "Short key", (r"moduluslength\s*:\s*(512|1024)\b", r"generate_private_key\s*\([^)]*(512|1024)")),
]), extensions=(".ts", ".js", ".py", ".go", ".java", ".rb", ".php"), gate=r"crypt|hash|cipher|tls|ssl|random|pbkdf|hmac", confidence="high", id_prefix="CRYPTO")

PRIVACY = Family("privacy", "M1", _rules("privacy", [
    ("privacy-pii-logging", "high", 532, "Personal data in a log", (r"(console\.\w+|log(ger)?\.\w+|print)\s*\([^)]*(email|ssn|phone|address|birth)",)),
    ("privacy-pii-unencrypted", "high", 311, "Personal data in plain text", (r"(ssn|passport|credit_?card)\s*[:=]\s*(string|varchar|text)\b",)),
    ("privacy-third-party-data", "medium", 359, "Personal data sent on", (r"(analytics|segment|mixpanel)\.\w+\s*\([^)]*(email|phone|name)",)),
    ("privacy-cookie-no-consent", "medium", 359, "Tracking without consent", (r"document\.cookie\s*=", r"gtag\s*\(\s*[\"']config")),
    ("privacy-password-plaintext", "critical", 256, "Password kept in plain text", (r"password\s*[:=]\s*req\.body\.password",)),
    ("privacy-no-consent", "medium", 359, "Tracking that asks for no consent", (r"\b(analytics|tracking|telemetry)\.\w+\s*\((?!.*(consent|gdpr|opt_?in))", r"\b(gtag|fbq|ga|mixpanel|segment)\s*\(\s*[\"'](event|track|identify)")),
    ("privacy-no-deletion", "medium", 359, "Account routes, none that deletes", (r"\.(get|post)\s*\(\s*[\"']/(api/)?(user|account|profile)s?[\"'](?!.*(delete|destroy|remove|erase|purge))",)),
    ("privacy-excessive-collection", "low", 359, "Sensitive traits asked for", (r"\b(required|validate)\w*\b.*\b(gender|race|ethnicity|religion|political\w*|sexual_?orientation|marital_?status)\b",)),
    ("privacy-data-retention", "low", 359, "Data kept without an end", (r"\b(session|token|log|cache)s?\b.*\b(ttl|max_?age|expires?)\s*[:=]\s*(0\b|null|undefined|infinity)",)),
]), extensions=(*JS, ".py"), id_prefix="PRIV")

LLM_SECURITY = Family("llm", "M1", _rules("llm-security", [
    ("llm-prompt-injection", "critical", 77, "Input inside a prompt", (r"(prompt|content)\s*[:=]\s*`[^`]*\$\{\s*(req|user|input|message)", r"prompt\s*=\s*f[\"'][^\"']*\{(user|request|input)")),
    ("llm-unsafe-eval", "critical", 95, "Model output evaluated", (r"(eval|exec)\s*\(\s*(response|completion|output|result)\b",)),
    ("llm-client-api-key", "critical", 798, "Model key in a browser", (r"dangerouslyallowbrowser\s*:\s*true",)),
    ("llm-xss-output", "high", 79, "Model output as HTML", (r"innerhtml\s*=\s*(response|completion|message|output)",)),
    ("llm-system-prompt-leak", "medium", 200, "System prompt in a reply", (r"res\.(json|send)\s*\([^)]*system_?prompt",)),
    ("llm-response-injection", "critical", 89, "Model output in a query", (r"query\s*\(\s*(response|completion|output)\b",)),
    ("llm-no-token-limit", "medium", 770, "Completion without a limit of tokens", (r"\b(openai|anthropic|client)[\w.]*\.create\s*\(\s*\{(?!.*max_?(output_?)?tokens).*\}\s*\)",)),
    ("llm-pii-exposure", "high", 359, "Personal data sent to a model", (r"\b(openai|anthropic)\b.*\b(e_?mail|ssn|password|credit_?card|phone_?number)\b", r"\b(prompt|messages)\b.*\b(e_?mail|ssn|password|credit_?card|phone_?number)\b.*\b(openai|anthropic|api)\b")),
    ("llm-insecure-tool-use", "critical", 78, "Tool of a model that runs commands", (r"\b(tools|functions)\s*[:=].*\b(exec(sync)?|spawn|child_process|os\.system|subprocess)\b", r"\btool\w*\b.*\b(run_shell|execute_code|delete_file|file_write)\b", r"function_call.*\b(exec|shell|run_command|execute)\b")),
    ("llm-no-content-filter", "medium", 20, "Model output used without a filter", (r"\b(completion|response|result)\.(text|content|message)\b(?!.*(filter|moderat|saniti[sz]))",)),
    ("llm-hardcoded-endpoint", "low", 547, "Address of a model provider in source", (r"[\"']https://api\.(openai|anthropic)\.com/v1/[a-z/]+[\"']",)),
    ("llm-model-exposure", "low", 200, "Model named in a reply", (r"res\.(send|json)\s*\(.*\bmodel(_?name|_?version)?\b",)),
    ("llm-training-data-risk", "high", 359, "Data of users used for training", (r"\b(fine.?tun\w*|train(ing)?)\b.*\b(user_?data|customers?\w*|input_?data)\b", r"\b(create|upload)\w*\b.*\b(training.?file|fine.?tun\w*)\b.*\b(users?|customers?|inputs?)\b")),
]), extensions=(*JS, ".py"), gate=r"openai|completion|prompt|llm|chat|model", confidence="high", id_prefix="LLM")

CLOUD = Family("cloud", "M1", _rules("cloud", [
    ("aws-s3-public", "critical", 284, "Public bucket", (r"acl[\"']?\s*[:=]\s*[\"']public-read", r"block_public_acls\s*=\s*false")),
    ("aws-iam-wildcard", "critical", 250, "All actions allowed", (r"\"?action\"?\s*[:=]\s*\[?\s*\"\*\"",)),
    ("aws-sg-open", "high", 284, "Open to any address", (r"cidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0", r"cidrip:\s*\"?0\.0\.0\.0/0")),
    ("aws-rds-no-encryption", "high", 311, "Storage not encrypted", (r"storage_encrypted\s*=\s*false", r"storageencrypted:\s*false")),
    ("azure-storage-public", "critical", 284, "Public container", (r"allow_blob_public_access\s*=\s*true", r"container_access_type\s*=\s*\"(blob|container)\"")),
    ("azure-app-no-https", "medium", 319, "Plain HTTP", (r"https_only\s*=\s*false",)),
    ("gcp-bucket-public", "critical", 284, "Public bucket", (r"member\s*=\s*\"all(authenticated)?users\"",)),
    ("gcp-sql-no-ssl", "high", 319, "Plain connections", (r"require_ssl\s*=\s*false",)),
    ("aws-lambda-secrets", "high", 798, "Secret in a function's environment", (r"\benvironment\s*[:=]?\s*\{.*(password|secret|api_?key|token|private_key)\w*[\"']?\s*[:=]\s*[\"'][^\"']+[\"']",)),
    ("azure-nsg-any", "high", 284, "Any source or any port", (r"(source_address_prefix|destination_port_range)\s*=\s*[\"']\*[\"']",)),
    ("gcp-firewall-open", "high", 284, "Open to any address", (r"source_ranges\s*[:=]\s*\[\s*[\"']0\.0\.0\.0/0",)),
    ("cloud-secrets-in-config", "critical", 798, "Secret in a configuration", (r"\b(password|secret_key|access_key|api_key|private_key)\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']",)),
    ("cloud-no-encryption", "high", 311, "Storage not encrypted", (r"\bencrypted\s*[:=]\s*false", r"server_side_encryption\s*[:=]\s*[\"'](none|disabled)")),
    ("cloud-overprivileged", "high", 250, "Role with all rights", (r"administratoraccess|(full|poweruser)access\b|admin(access|policy)", r"\brole\b.*\b(admin|root|superuser)\b")),
]), extensions=(".tf", ".yml", ".yaml", ".json", ".ts"), confidence="high", id_prefix="CLOUD")

PATH = Family("path", "M2", _rules("path-traversal", [
    ("path-traversal-join", "high", 22, "Joined path from input", (rf"path\.join\s*\([^)]*{_REQ}",), {"window": (0, 4), "mitigation": r"startswith|normalize|path\.resolve|includes\([\"']\.\."}),
    ("path-traversal-resolve", "high", 22, "Resolved path from input", (rf"path\.resolve\s*\([^)]*{_REQ}",), {"window": (0, 4), "mitigation": r"startswith|indexof\("}),
    ("path-dot-dot", "high", 22, "Parent folder in a path", (r"[\"'`]\.\./[^\"'`]*\$\{",), {"window": (0, 4), "mitigation": r"startswith|realpath"}),
    ("path-null-byte", "medium", 626, "Null byte in a path", (r"%00|\\x00|\\0",), {"window": (0, 4), "mitigation": r"replace|reject|includes"}),
    ("path-symlink", "medium", 59, "Followed link", (r"\b(readlink|symlink)(sync)?\s*\(",), {"window": (0, 4), "mitigation": r"lstat|realpath"}),
]), extensions=TS_JS_PY, gate=r"path|file|\.\./|readlink|symlink", wired=False, id_prefix="PATH")

DESERIALIZATION = Family("deser", "M2", _rules("deserialization", [
    ("deser-json-parse-untrusted", "medium", 502, "JSON from outside without a guard", (rf"json\.parse\s*\(\s*{_REQ}",), {"window": (-2, 2), "mitigation": r"\btry\b|catch|schema|validate"}),
    ("deser-pickle-loads", "critical", 502, "Pickle from outside", (r"pickle\.loads?\s*\(",)),
    ("deser-yaml-unsafe", "critical", 502, "Unsafe YAML loader", (r"yaml\.load\s*\((?!.*safeloader)",)),
    ("deser-java-objectinput", "critical", 502, "Object stream from outside", (r"\.readobject\s*\(",)),
    ("deser-proto-pollution", "high", 1321, "Merge of input into an object", (r"(merge|extend|defaultsdeep)\s*\([^)]*req\.",)),
    ("deser-eval-json", "critical", 95, "JSON read by eval", (r"eval\s*\(\s*[\"']?\(?.*json",)),
    ("deser-xml-xxe", "high", 611, "XML read with outside entities", (r"\b(xml2js\.)?parse(string|xml)\s*\(|\betree\.parse\s*\(|\b(dom|sax)parser\b|\bxmlreader\b",), {"window": (0, 5), "mitigation": r"disallow|external|noent|resolve_entities\s*=\s*false"}),
]), extensions=(*TS_JS_PY, ".java"), wired=False, confidence="high", id_prefix="DESER")

SESSION = Family("session", "M3", _rules("session", [
    ("session-no-expiry", "high", 613, "Session without an end", (r"session\s*\(\s*\{(?![^}]*maxage)[^}]*\}",)),
    ("session-fixation", "high", 384, "Session kept over login", (r"req\.session\.user\s*=(?![\s\S]{0,300}regenerate)",)),
    ("session-insecure-cookie", "high", 614, "Cookie without protection", (r"cookie\s*:\s*\{[^}]*secure\s*:\s*false", r"cookie\s*:\s*\{[^}]*httponly\s*:\s*false")),
    ("session-predictable-id", "critical", 330, "Predictable session id", (r"session_?id\s*=\s*(date\.now|math\.random|\+\+)",)),
    ("session-stored-client", "high", 922, "Session kept in the browser", (r"localstorage\.setitem\s*\(\s*[\"'](session|sid)",)),
    ("session-no-logout-invalidation", "medium", 613, "Logout that keeps the session", (r"(log|sign)_?out\b(?![\s\S]{0,500}(destroy|invalidate|delete|clear|remove))[\s\S]{0,300}res\.(redirect|json|send)",)),
    ("session-no-rotation-on-privilege", "medium", 384, "Rights changed, session kept", (r"\b(role|permission|privilege|admin)s?\s*[:=](?![\s\S]{0,200}(regenerate|newsession|destroy))",)),
]), extensions=JS, gate=r"session|cookie", id_prefix="SESS")

BUSINESS = Family("biz", "M3", _rules("business-logic", [
    ("biz-negative-amount", "high", 20, "Amount from input without a lower bound", (r"(amount|price|quantity)\s*=\s*(number|parse(int|float))?\(?\s*req\.body",)),
    ("biz-coupon-no-limit", "medium", 799, "Coupon without a limit", (r"apply_?coupon\s*\(",)),
    ("biz-race-purchase", "high", 362, "Stock tested and then lowered", (r"if\s*\([^)]*(stock|balance)[^)]*[<>][^)]*\)[\s\S]{0,200}(stock|balance)\s*-=",)),
    ("biz-role-escalation", "critical", 269, "Role from input", (r"role\s*[:=]\s*req\.body", r"is_?admin\s*[:=]\s*req\.body")),
    ("biz-email-verify-skip", "medium", 863, "Verification from input", (r"(email)?verified\s*[:=]\s*(true|req\.body)",)),
    ("biz-rate-limit-bypass", "medium", 799, "Rate limit by a header that clients set", (r"x-forwarded-for[\s\S]{0,100}(limit|rate)",)),
]), extensions=(".ts", ".js"), id_prefix="BIZ")

RACE = Family("race", "M4", _rules("race-condition", [
    ("race-toctou-fs", "medium", 367, "File tested and then used", (r"exists(sync)?\s*\(", r"os\.path\.exists\s*\("), {"window": (0, 7), "mitigation": r"lock|o_excl|wx"}),
    ("race-read-modify-write", "high", 362, "Read, changed and written", (r"findone\s*\([\s\S]{0,200}\.save\s*\(",), {"window": (0, 19), "mitigation": r"transaction|\$inc|lock"}),
    ("race-no-transaction", "high", 362, "Several writes without a transaction", (r"await\s+\w+\.(update|save|create)[\s\S]{0,200}await\s+\w+\.(update|save|create)",), {"window": (0, 19), "mitigation": r"transaction"}),
    ("race-shared-state", "medium", 362, "Counter shared by requests", (r"^(let|var)\s+\w*(count|total|balance)\w*\s*=\s*0",)),
    ("race-double-spend", "high", 362, "Balance tested and then lowered", (r"balance\s*(>=|>|<)\s*\w+",), {"window": (0, 11), "mitigation": r"transaction|for update|lock"}),
    ("race-fire-forget", "medium", 362, "Write that nobody waits for", (r"^\s*\w+\.(save|update|delete)\s*\(",), {"window": (0, 7), "mitigation": r"\.catch|await"}),
    ("race-go-goroutine", "high", 362, "Goroutine on shared data", (r"go\s+func\s*\(",), {"window": (0, 19), "mitigation": r"mutex|sync\.|chan\b|<-"}),
]), extensions=(*TS_JS_PY, ".go", ".java"), id_prefix="RACE")

ERRORS = Family("error", "M4", _rules("error-handling", [
    ("error-empty-catch", "medium", 390, "Errors dropped", (r"catch\s*(\([^)]*\))?\s*\{\s*\}", r"except[^:\n]*:\s*\n?\s*pass\b")),
    ("error-stack-exposure", "high", 209, "Stack in a reply", (r"res\.(json|send)\s*\([^)]*\.stack",)),
    ("error-verbose-message", "medium", 209, "Error text in a reply", (r"res\.(json|send)\s*\([^)]*(err|error)\.message",)),
    ("error-generic-catch", "low", 396, "All errors caught", (r"except\s*:", r"except\s+exception\b")),
    ("error-debug-in-prod", "high", 215, "Debug mode on", (r"debug\s*[:=]\s*true",)),
    ("error-no-error-handler", "medium", 755, "Server without a handler of errors", (r"\bapp\.listen\s*\((?![\s\S]{0,500}(app\.use\s*\(\s*\(\s*err|uncaughtexception))",)),
    ("error-unhandled-rejection", "medium", 755, "Server without a handler of rejections", (r"\bapp\.listen\s*\((?![\s\S]{0,500}unhandledrejection)",)),
    ("error-info-leak-header", "low", 200, "Server's version in a header", (r"setheader\s*\(\s*[\"']x-powered-by[\"']", r"setheader\s*\(\s*[\"']server[\"'].*(express|nginx|apache|node)")),
]), extensions=(*JS, ".py"), wired=False, id_prefix="ERR")

JWT = Family("jwt", "M5", _rules("jwt", [
    ("jwt-none-algorithm", "critical", 345, "Unsigned tokens accepted", (r"algorithms?\s*:\s*\[?\s*[\"']none",)),
    ("jwt-decode-without-verify", "critical", 345, "Token read without a check", (r"jwt\.decode\s*\(", r"jwt_decode\s*\("), {"window": (0, 9), "mitigation": r"\.verify\s*\("}),
    ("jwt-weak-secret", "critical", 326, "Short secret", (r"jwt\.sign\s*\([^,]+,\s*[\"'][^\"']{1,16}[\"']",)),
    ("jwt-no-expiry", "high", 613, "Token without an end", (r"jwt\.sign\s*\(",), {"window": (0, 9), "mitigation": r"expiresin|\bexp\b"}),
    ("jwt-stored-localstorage", "high", 922, "Token kept in the browser", (r"localstorage\.setitem\s*\([^)]*token",)),
    ("jwt-no-audience", "medium", 287, "Audience not checked", (r"jwt\.verify\s*\(",), {"window": (0, 9), "mitigation": r"audience"}),
    ("jwt-no-issuer", "medium", 287, "Issuer not checked", (r"jwt\.verify\s*\(",), {"window": (0, 9), "mitigation": r"issuer"}),
    ("jwt-secret-in-code", "high", 798, "Secret in source", (r"jwt_?secret\s*[:=]\s*[\"'][^\"']+",)),
    ("jwt-no-revocation", "medium", 613, "Logout that keeps tokens", (r"logout",), {"window": (0, 19), "mitigation": r"blacklist|revoke|denylist|delete"}),
]), extensions=(".ts", ".js"), gate=r"jwt|jsonwebtoken", id_prefix="JWT")

HEADERS = Family("headers", "M6", _rules("headers", [
    ("header-no-csp", "high", 693, "No content policy", (r"content-security-policy",), {"check": "missing"}),
    ("header-csp-unsafe", "high", 693, "Unsafe content policy", (r"unsafe-(inline|eval)",), {"check": "present"}),
    ("header-no-hsts", "medium", 319, "No strict transport", (r"strict-transport-security",), {"check": "missing"}),
    ("header-no-xframe", "medium", 1021, "Framing allowed", (r"x-frame-options|frame-ancestors",), {"check": "missing"}),
    ("header-no-xcontent-type", "medium", 693, "Type sniffing allowed", (r"x-content-type-options",), {"check": "missing"}),
    ("header-no-referrer-policy", "low", 200, "No referrer policy", (r"referrer-policy",), {"check": "missing"}),
    ("header-no-permissions-policy", "low", 693, "No permissions policy", (r"permissions-policy",), {"check": "missing"}),
    ("header-x-powered-by", "low", 200, "Server names itself", (r"x-powered-by",), {"check": "present"}),
]), extensions=TS_JS_PY, gate=r"express\(|createserver|flask\(|fastify\(", confidence="high", id_prefix="HDR")

IAC = Family("iac", "M7", _rules("iac", [
    ("docker-root-user", "high", 250, "Container runs as root", (), {"path_contains": "Dockerfile", "has": ("FROM",), "lacks": ("USER ",)}),
    ("docker-latest-tag", "medium", None, "Image without a version", (r"^from\s+\S+:latest", r"^from\s+[^:@\s]+(\s+as\s+\w+)?\s*$"), {"path_contains": "Dockerfile"}),
    ("docker-add-instead-of-copy", "low", None, "ADD where COPY would do", (r"^add\s+(?!https?:)\S",), {"path_contains": "Dockerfile"}),
    ("docker-secret-in-env", "high", 798, "Secret in the image", (r"^(env|arg)\s+\w*(password|secret|token|key)\w*\s*=\s*\S+",), {"path_contains": "Dockerfile"}),
    ("docker-expose-all", "medium", None, "Port of a remote shell", (r"^expose\s+.*\b(22|23|3389)\b",), {"path_contains": "Dockerfile"}),
    ("tf-public-access", "high", 284, "Public access", (r"publicly_accessible\s*=\s*true", r"acl\s*=\s*\"public"), {"path_contains": ".tf"}),
    ("tf-hardcoded-secret", "critical", 798, "Secret in source", (r"(password|secret|token)\s*=\s*\"[^\"$]{6,}\"",), {"path_contains": ".tf"}),
    ("tf-unencrypted-storage", "high", None, "Storage not encrypted", (r"resource\s+\"aws_(ebs_volume|db_instance)\"",), {"path_contains": ".tf", "lacks": ("encrypted",)}),
    ("tf-open-security-group", "critical", 284, "Open to any address", (r"cidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0",), {"path_contains": ".tf"}),
    ("k8s-privileged", "critical", 250, "Privileged container", (r"privileged:\s*true",), {"path_contains": ".y", "has": ("kind:",)}),
    ("k8s-run-as-root", "high", 250, "Container runs as root", (r"runasuser:\s*0\b",), {"path_contains": ".y", "has": ("kind:",)}),
    ("k8s-no-resource-limits", "medium", None, "No limits", (r"^\s*containers:",), {"path_contains": ".y", "has": ("kind:", "containers:"), "lacks": ("limits:",)}),
    ("k8s-host-network", "high", None, "Network of the host", (r"hostnetwork:\s*true",), {"path_contains": ".y", "has": ("kind:",)}),
]), cap=None, confidence="high", id_prefix="IAC")

SECRETS = Family("secret", "M1", _rules("secrets", [
    ("aws-access-key", "critical", 798, "Cloud access key", (r"\bakia[0-9a-z]{16}\b",)),
    ("github-pat", "critical", 798, "Repository token", (r"\bgh[pousr]_[a-z0-9]{36}\b",)),
    ("llm-provider-key", "critical", 798, "Model provider key", (r"\bsk-[a-z0-9_-]{20,}\b",)),
    ("stripe-key", "critical", 798, "Payment key", (r"\b[sr]k_live_[a-z0-9]{20,}\b",)),
    ("stripe-publishable", "medium", 798, "Payment key of the browser", (r"\bpk_live_[a-z0-9]{20,}\b",)),
    ("slack-token", "high", 798, "Chat token", (r"\bxox[abps]-[a-z0-9-]{10,}", r"hooks\.slack\.com/services/[a-z0-9/]+")),
    ("private-key", "critical", 798, "Private key", (r"-----begin ([a-z]+ )?private key-----",)),
    ("google-key", "high", 798, "Search provider key", (r"\baiza[0-9a-z_-]{35}\b",)),
    ("npm-token", "high", 798, "Registry token", (r"\bnpm_[a-z0-9]{36}\b",)),
    ("mail-key", "high", 798, "Mail provider key", (r"\bsg\.[a-z0-9_-]{16,}\.[a-z0-9_-]{16,}",)),
    ("database-url", "high", 798, "Database address with a password", (r"\b(postgres(ql)?|mysql|mongodb(\+srv)?|redis)://[^\s:@/]+:[^\s:@/]+@",)),
    ("jwt", "medium", 798, "Token in source", (r"\beyj[a-z0-9_-]{10,}\.eyj[a-z0-9_-]{10,}\.",)),
    ("generic-api-key", "high", 798, "Key in an assignment", (r"(api_?key|secret|token|password)[\"']?\s*[:=]\s*[\"'][a-z0-9+/_.=-]{16,}[\"']",)),
]), cap=None, confidence="high", id_prefix="SEC")

WIRED = (PATTERN, FRAMEWORK, SECRETS, IAC, LLM_SECURITY, API, CLOUD, HEADERS, JWT, SESSION, BUSINESS, CRYPTO, PRIVACY, RACE)
EXPERIMENTAL = (PATH, DESERIALIZATION, ERRORS)


def normalise(raw: object) -> list[Rule]:
    """Rules from parsed YAML or JSON: a list, {rules: [...]} or a single rule, with defaults."""
    if isinstance(raw, dict):
        raw = raw.get("rules", [raw])
    out = []
    for r in raw if isinstance(raw, list) else []:
        if not isinstance(r, dict) or not r.get("id"):
            continue
        patterns = [p.get("pattern") if isinstance(p, dict) else p for p in r.get("patterns") or [] if not isinstance(p, dict) or p.get("type", "regex") == "regex"]
        out.append(Rule(id=str(r["id"]), title=str(r.get("title") or r["id"]), severity=r.get("severity") or "medium", category=r.get("category") or "custom", cwe=r.get("cwe"), languages=tuple(r.get("languages") or ["*"]), patterns=tuple(str(p) for p in patterns if p)))
    if len(out) > MAX_CUSTOM:
        raise ValueError(f"{len(out)} custom rules; at most {MAX_CUSTOM} are folded into a scan")
    return [r for r in out if r.patterns]


def load_custom(text: str) -> list[Rule]:
    """Rules from a JSON or YAML text; none from one that is neither, or holds several documents."""
    try:
        return normalise(json.loads(text))
    except ValueError:
        pass
    try:
        found = yamlfiles.parse(text)
    except ValueError:
        return []
    return normalise(yamlfiles.plain(found[0])) if len(found) == 1 else []
