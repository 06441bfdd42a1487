"""Operator 6, secret scans: assignment-aware lexing.

`scan` finds the base patterns, and reads assignments in source and configuration syntax:

    name = "literal"    name: literal    "name": "literal"    name := `literal`    NAME=literal    a.b["name"] = 'x' + y

Each gives a target name and the parts of its value, by position. Constants propagate in the order of the text: a bare
name on the right links to what was last assigned to it, also in sums, which go on over line breaks around a plus sign.
A literal is scored by the target names that it reaches (password, api key, token ... as words of the name) and by its
own shape: length, kinds of characters, entropy, against placeholders and references. A score of THRESHOLD or more makes
a span of kind `named`. Links are resolved once, at the end, from the last assignment to the first; none are cut.

Names, blanks and sums have no upper limits. Regular expressions start at an assignment sign and don't go back.
Texts are whole; a text without `=` or `:` has no assignment, one without a base word no assign span.

Defined results: null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, table

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "named")
_HEX_BYTES = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256))
THRESHOLD = 5

#: Words of a target name and what they say of its value.
NAMES = {
    "password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "pass": 2, "secret": 4, "token": 3, "apikey": 4, "api_key": 4, "access_key": 4, "private_key": 4, "secret_key": 4, "client_secret": 4, "signing_key": 4,
    "encryption_key": 4, "credential": 3, "credentials": 3, "auth": 2, "bearer": 3, "authorization": 3, "key": 1, "dsn": 2, "connection_string": 3, "webhook": 2, "salt": 1, "signature": 1,
}
HARMLESS = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|yes|no|on|off|todo|fixme|changeme|change_me|example|sample|test|dummy|placeholder|redacted|your.*|xxx+|\*+|\.+|<.*>|\$\{.*\}|\$\(.*\)|\{\{.*\}\}|%\(?\w+\)?s?)$")

NAME = r"[A-Za-z_$][A-Za-z0-9_$-]*+"
_NAME_END = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$-")
_SIGN = re.compile(r":=|=>|[:=]")
_TERM = re.compile(rf"[\x20\t]*+(?:[rbuf]{{0,2}}\"((?:\\.|[^\"\\\n])*+)\"|[rbuf]{{0,2}}'((?:\\.|[^'\\\n])*+)'|`([^`\n]*+)`|({NAME}(?:\.{NAME})*+)(?=[\x20\t]*+(?:[;,)}}\]+\r\n#]|$))|([^\x20\t\n;,\"'`#+(){{}}\[\]]++))")
_PLUS = re.compile(r"[\x20\t\r\n]*+\+[\x20\t\r\n]*+")


@dataclass(frozen=True)
class Literal:
    start: int
    end: int
    text: str
    name_score: int


def name_parts(name: str) -> list[str]:
    """Lower-case words of a name: camel case, snake case, dots and dashes."""
    return [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def name_score(name: str) -> int:
    parts = name_parts(name)
    pairs = ["_".join(p) for p in zip(parts, parts[1:], strict=False)]
    return max([0, *(NAMES.get(x, 0) for x in (*parts, *pairs))])


def literal_score(text: str) -> int:
    """From -9 (a placeholder or reference) to 4."""
    if len(text) < 6 or HARMLESS.match(text) or text.isspace():
        return -9
    kinds = sum(bool(re.search(x, text)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    counts = Counter(text)
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    return (len(text) >= 12) + (kinds >= 2) + (entropy >= 3.0) + (entropy >= 3.7) - 2 * (text.count(" ") > 2) - 2 * (len(counts) < 4)


def _target(text: str, end: int) -> str | None:
    """The name that stands before end: bare, or in quotes, also in brackets."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] == "]":
        end -= 1
    if not end:
        return None
    quote = text[end - 1]
    if quote in "\"'":
        start = text.rfind(quote, 0, end - 1) + 1
        return text[start : end - 1] if 0 < start < end - 1 and "\n" not in text[start : end - 1] else None
    start = end
    while start and text[start - 1] in _NAME_END:
        start -= 1
    return text[start:end].lstrip("0123456789-") or None


def assignments(text: str) -> list[Literal]:
    """Literals by position, each with the best score of all target names that it reaches."""
    known: dict[str, int] = {}
    scores: list[int] = []
    parts: list[list[int | tuple[int, int]]] = []  # of each assignment: earlier ones, and spans of literals
    at = 0
    for sign in _SIGN.finditer(text):
        if sign.start() < at or text[sign.end() : sign.end() + 1] == "=":
            continue
        name = _target(text, sign.start())
        if not name:
            continue
        place, found, plus = sign.end(), [], None
        while term := _TERM.match(text, place):
            kind = term.lastindex
            if plus and kind == 5 and "\n" in plus[0]:
                break  # a new statement, or a line of a patch
            if kind == 4 and (term[4] in known or term[4].split(".")[-1] in known):
                found.append(known[term[4] if term[4] in known else term[4].split(".")[-1]])
            else:
                found.append(term.span(kind))
            place = term.end()
            if kind < 4:
                at = place  # what a quoted literal holds is not code
            plus = _PLUS.match(text, place)
            if not plus:
                break
            place = plus.end()
        if found:
            known[name] = len(parts)
            scores.append(name_score(name))
            parts.append(found)
    reached: dict[tuple[int, int], int] = {}
    for i in range(len(parts) - 1, -1, -1):
        for x in parts[i]:
            if isinstance(x, int):
                scores[x] = max(scores[x], scores[i])
            else:
                reached[x] = max(reached.get(x, 0), scores[i])
    return [Literal(a, b, text[a:b], n) for (a, b), n in sorted(reached.items())]


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then as KINDS lists them."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        for x in assignments(text):
            if x.name_score + literal_score(x.text) >= THRESHOLD:
                spans.append((x.start, x.end, "named"))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py() or "") for x in batch["text"]]
            if digest:
                base = [[s for s in spans if s[2] != "named"] for spans in found]
                counts = [pa.array([sum(s[2] == kind for s in spans) for spans in found], type=pa.int64()) for kind in KINDS[:3]]
                columns = [*counts, pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], type=pa.string()), pa.array(list(map(_joined, found)), type=pa.string())]
                names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            else:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
                columns, names = [pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in spans] for spans in found], type=kind)], ["spans"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *names])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of its text."""
    docs = documents(docs)
    return docs.mapInArrow(_scan(False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, counts of the base kinds, base_sha256 and spans. Null and empty texts have no spans
    (the digest of an empty text, an empty list); repeated rows are rows of their own."""
    docs = documents(table(spark, sf_dir, "documents"))
    return docs.mapInArrow(_scan(True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
