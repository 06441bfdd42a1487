"""Rules of the wired families that look for what is absent, or for a place: a file that each finds and one that it doesn't."""

from gneiss.functions import rules as R
from gneiss.operators import findings

CASES = {
    "api-broken-function-auth": ("a.ts", "app.get('/admin/x', (req, res) => go())", "app.get('/admin/x', requireRole('a'), go)"),
    "api-missing-headers": ("a.ts", "app.use(express.json())", "app.use(express.json()); app.use(helmet())"),
    "aws-lambda-secrets": ("a.tf", 'environment { API_KEY = "abc" }', 'environment { STAGE = "abc" }'),
    "azure-nsg-any": ("a.tf", 'source_address_prefix = "*"', 'source_address_prefix = "10.0.0.0/8"'),
    "gcp-firewall-open": ("a.tf", 'source_ranges = ["0.0.0.0/0"]', 'source_ranges = ["10.0.0.0/8"]'),
    "cloud-secrets-in-config": ("a.tf", 'secret_key = "abcdefgh1"', "secret_key = var.key"),
    "cloud-no-encryption": ("a.tf", "encrypted = false", "encrypted = true"),
    "cloud-overprivileged": ("a.tf", 'arn = "aws:policy/AdministratorAccess"', 'arn = "aws:policy/ReadOnly"'),
    "deser-xml-xxe": ("a.py", "etree.parse(f)", "etree.parse(f, XMLParser(resolve_entities=False))"),
    "session-no-logout-invalidation": ("a.ts", "session\nfunction logout(req, res) { res.redirect('/') }", "session\nfunction logout(req, res) { req.session.destroy(); res.redirect('/') }"),
    "session-no-rotation-on-privilege": ("a.ts", "req.session.role = 'x'", "req.session.role = 'x'; req.session.regenerate()"),
    "error-no-error-handler": ("a.ts", "app.listen(80)", "app.listen(80)\napp.use((err, req, res, n) => {})"),
    "error-unhandled-rejection": ("a.ts", "app.listen(80)", "app.listen(80)\nprocess.on('unhandledRejection', f)"),
    "error-info-leak-header": ("a.ts", "res.setHeader('X-Powered-By', 'x')", "res.setHeader('X-Frame', 'x')"),
    "privacy-no-consent": ("a.ts", "analytics.track('x')", "analytics.track('x', { consent })"),
    "privacy-no-deletion": ("a.ts", "app.get('/api/user', f)", "app.get('/api/user', f); app.delete('/api/user', g)"),
    "privacy-excessive-collection": ("a.ts", "required: ['religion']", "required: ['name']"),
    "privacy-data-retention": ("a.ts", "cache({ ttl: 0 })", "cache({ ttl: 60 })"),
    "llm-no-token-limit": ("a.ts", "openai.chat.completions.create({ model: 'x' })", "openai.chat.completions.create({ model: 'x', max_tokens: 5 })"),
    "llm-pii-exposure": ("a.ts", "openai(user.email)", "openai(user.id)"),
    "llm-insecure-tool-use": ("a.ts", "llm.tools = [{ run: child_process }]", "llm.tools = [{ run: add }]"),
    "llm-no-content-filter": ("a.ts", "show(completion.text)", "show(moderate(x)) // llm"),
    "llm-hardcoded-endpoint": ("a.ts", "fetch('https://api.openai.com/v1/embeddings')", "fetch(openai.url)"),
    "llm-model-exposure": ("a.ts", "res.json({ model })", "res.json({ x }) // llm"),
    "llm-training-data-risk": ("a.ts", "finetune(llm, userData)", "finetune(llm, openData)"),
}


def test_each_finds_its_case_and_spares_the_other(files):
    tree = {}
    for rule, (name, bad, good) in CASES.items():
        tree[f"{rule}/bad/{name}"], tree[f"{rule}/good/{name}"] = bad, good
    found = {(r["rule"].split(":")[-1], r["file"]) for r in findings.scan(files(tree), (*R.WIRED, *R.EXPERIMENTAL)).collect()}
    for rule, (name, *_) in CASES.items():
        assert (rule, f"{rule}/bad/{name}") in found, rule
        assert (rule, f"{rule}/good/{name}") not in found, rule
