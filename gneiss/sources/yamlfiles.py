"""YAML files as rows: one for each scalar (and each empty map or list) of each document, with the keys that lead to it.

A file is read once, from front to back: block maps, lists and scalars, flow forms, quotes, anchors, aliases, merged maps and
several documents. What is built on the rows (policies, rules, services) is DataFrame work. Tags and explicit (`?`) keys
aren't read; a file with one, or that is no YAML, gives no rows, as do null and empty ones. So does a file whose aliases
would make more scalars than it has characters, and a thousand besides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=\S))(?:[^:#]|:(?=\S)|(?<=\S)#)*?)\s*:(?=\s|$)""")
QUOTED = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""", re.S)
COMMENT = re.compile(rf"({QUOTED.pattern})|(?:^|(?<=\s))#.*")
PLAIN = re.compile(r"(?:[^,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)+")
ANCHOR = re.compile(r"&(\S+)(?:\s+|$)")
BLOCK = re.compile(r"([|>])([+-]?)(\d?)([+-]?)\s*(#.*)?$")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "e": "\x1b", "a": "\a", "v": "\v"}
WORDS = {**dict.fromkeys(("~", "null", "Null", "NULL", ""), "null"), **dict.fromkeys(("true", "True", "TRUE", "false", "False", "FALSE"), "bool")}
NUMBERS = (("int", r"[-+]?[0-9]+|0x[0-9a-fA-F]+|0o[0-7]+"), ("float", r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)"))
NUMBERS = tuple((kind, re.compile(pattern)) for kind, pattern in NUMBERS)
SPACE = re.compile(r"\s*")
REMARK = re.compile(r"\s#")
LINES = re.compile(r"\s*\n\s*")

#: A scalar is (kind, text); maps and lists are Python's.
Node = Any


def _plain(text: str) -> Node:
    kind = WORDS.get(text)
    if kind is None:
        kind = next((k for k, pattern in NUMBERS if pattern.fullmatch(text)), "str") if text[0] in "+-.0123456789" else "str"
    return kind, None if kind == "null" else text


def _unquoted(text: str) -> str:
    folded = text[1:-1]
    if "\n" in folded:
        folded = re.sub(r"[ \t]*\n[ \t]*", " ", folded)
    if text[0] == "'":
        return folded.replace("''", "'")
    return folded if "\\" not in folded else re.sub(r"\\(?:x(..)|u(....)|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), folded)


def _is_item(text: str) -> bool:
    return text == "-" or text.startswith("- ")


class Reader:
    """One document's lines, read from front to back."""

    def __init__(self, lines: list[str]):
        self.lines, self.at, self.anchors = lines, 0, {}

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line with content."""
        while self.at < len(self.lines):
            body = self.lines[self.at].lstrip(" ")
            if body.strip() and not body.startswith("#"):
                if body.startswith("\t"):
                    raise ValueError("a tab indents a line")
                return len(self.lines[self.at]) - len(body), body.rstrip()
            self.at += 1
        return None

    def node(self, least: int) -> Node:
        found = self.peek()
        if not found or found[0] < least:
            return _plain("")
        indent, text = found
        if m := ANCHOR.match(text):
            rest = text[m.end() :]
            if rest and not rest.startswith("#"):
                self.lines[self.at] = " " * (indent + m.end()) + rest
                return self._named(m[1], self.node(least))
            self.at += 1
            return self._named(m[1], self.node(least))
        if _is_item(text):
            return self.sequence(indent)
        if KEY.match(text):
            return self.mapping(indent)
        self.at += 1
        return self.value(text, least - 1)

    def _named(self, name: str, node: Node) -> Node:
        self.anchors[name] = node
        return node

    def mapping(self, indent: int) -> dict:
        out, merged = {}, []
        while (found := self.peek()) and found[0] == indent and (m := KEY.match(found[1])):
            key = _unquoted(m[1]) if m[1][0] in "\"'" else m[1]
            self.at += 1
            value = self.value(found[1][m.end() :].strip(), indent)
            if key == "<<":
                merged += value if isinstance(value, list) else [value]
            elif key in out:
                raise ValueError(f"{key} stands twice")
            else:
                out[key] = value
        if found and found[0] >= indent:
            raise ValueError(f"no key: {found[1]}")
        for other in merged:
            out |= {k: v for k, v in other.items() if k not in out}
        return out

    def sequence(self, indent: int) -> list:
        out = []
        while (found := self.peek()) and found[0] == indent and _is_item(found[1]):
            rest = found[1][1:].lstrip(" ")
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1))
            else:  # what stands behind the dash is a line of its own
                place = indent + len(found[1]) - len(rest)
                self.lines[self.at] = " " * place + rest
                out.append(self.node(place))
        if found and found[0] > indent:
            raise ValueError(f"no item: {found[1]}")
        return out

    def value(self, rest: str, indent: int) -> Node:
        """What follows a key or stands alone: on this line, or below it, deeper than indent."""
        if m := ANCHOR.match(rest):
            return self._named(m[1], self.value(rest[m.end() :], indent))
        if not rest or rest.startswith("#"):
            found = self.peek()
            below = found and found[0] == indent and _is_item(found[1])
            return self.sequence(indent) if below else self.node(indent + 1)
        if rest[0] == "*":
            return self.anchors[rest[1:].split()[0]]
        if rest[0] in "|>":
            return self.block(rest, indent)
        if rest[0] in "[{":
            return self.flowing(rest)
        if rest[0] in "\"'":
            while not (m := QUOTED.match(rest)):
                rest += "\n" + self.lines[self.at]
                self.at += 1
            if not re.fullmatch(r"\s*(#.*)?", rest[m.end() :]):
                raise ValueError(f"behind a quote: {rest[m.end() :]}")
            return "str", _unquoted(m[0])
        if rest[0] in "!%@`&?":
            raise ValueError(f"not read: {rest}")
        text = REMARK.split(rest, maxsplit=1)[0].strip()
        while (found := self.peek()) and found[0] > indent:
            text += " " + REMARK.split(found[1], maxsplit=1)[0].strip()
            self.at += 1
        if re.search(r":(\s|$)", text):
            raise ValueError(f"a key inside a scalar: {text}")
        return _plain(text)

    def block(self, head: str, indent: int) -> Node:
        m = BLOCK.match(head)
        if not m:
            raise ValueError(f"no block: {head}")
        first = next((x for x in self.lines[self.at :] if x.strip()), "")
        own = max(indent, 0) + int(m[3]) if m[3] else max(indent + 1, len(first) - len(first.lstrip(" ")))
        lines = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) >= own):
            lines.append(self.lines[self.at][own:])
            self.at += 1
        kept = len(lines)
        while kept and not lines[kept - 1].strip():
            kept -= 1
        blank, lines = len(lines) - kept, lines[:kept]
        text = "\n".join(lines)
        if m[1] == ">":  # lines are joined by a space, n empty ones by n breaks; indented ones stay
            text = re.sub(r"(?<=[^\n])\n(\n*)(?=[^\n])", lambda b: b[0] if text[b.end()] in " \t" or text[text.rfind("\n", 0, b.start()) + 1] in " \t" else b[1] or " ", text)
        chomp = m[2] or m[4]
        return "str", text + ("" if chomp == "-" or not lines else "\n" * (1 + blank) if chomp == "+" else "\n")

    def flowing(self, text: str) -> Node:
        text = COMMENT.sub(lambda m: m[1] or "", text) if "#" in text else text
        depth = self._depth(text)
        while depth > 0:
            more = COMMENT.sub(lambda m: m[1] or "", self.lines[self.at]) if "#" in self.lines[self.at] else self.lines[self.at]
            self.at += 1
            depth += self._depth(more)
            text += "\n" + more
        node, end = self.flow(text, 0)
        if text[end:].strip():
            raise ValueError(f"behind a bracket: {text[end:]}")
        return node

    @staticmethod
    def _depth(line: str) -> int:
        bare = QUOTED.sub("", line) if '"' in line or "'" in line else line
        return bare.count("[") + bare.count("{") - bare.count("]") - bare.count("}")

    def flow(self, s: str, i: int) -> tuple[Node, int]:
        """A flow node of s from i on, and the end of it."""
        i = SPACE.match(s, i).end()
        if s[i] in "[{":
            close, items, pairs = ("]", [], None) if s[i] == "[" else ("}", None, {})
            i += 1
            while True:
                i = SPACE.match(s, i).end()
                if s[i] == close:
                    return (items if pairs is None else pairs), i + 1
                node, i = self.flow(s, i)
                i = SPACE.match(s, i).end()
                value = _plain("")
                paired = s[i] == ":"
                if paired:
                    i = SPACE.match(s, i + 1).end()
                    if s[i] not in ",]}":
                        value, i = self.flow(s, i)
                        i = SPACE.match(s, i).end()
                if pairs is None:
                    items.append({node[1] or "null": value} if paired else node)
                elif (key := node[1] or "null") in pairs:
                    raise ValueError(f"{key} stands twice")
                else:
                    pairs[key] = value
                if s[i] == ",":
                    i += 1
                elif s[i] != close:
                    raise ValueError(f"no comma: {s[i:]}")
        if m := QUOTED.match(s, i):
            return ("str", _unquoted(m[0])), m.end()
        m = PLAIN.match(s, i)
        if not m:
            raise ValueError(f"no scalar: {s[i:]}")
        text = (LINES.sub(" ", m[0]) if "\n" in m[0] else m[0]).strip()
        return (self.anchors[text[1:]] if text[0] == "*" else _plain(text)), m.end()


def parse(text: str) -> list[Node]:
    """The documents of a text; ValueError if it is no YAML or uses what isn't read."""
    parts: list[tuple[bool, list[str]]] = [(False, [])]
    for line in text.removeprefix("\ufeff").replace("\r\n", "\n").split("\n"):
        if line.startswith("---") and re.match(r"---(\s|$)", line):
            parts.append((True, [line[4:]]))
        elif line.startswith("...") and re.match(r"\.\.\.(\s|$)", line):
            parts.append((False, []))
        elif not line.startswith("%"):
            parts[-1][1].append(line)
    out = []
    for opened, lines in parts:
        reader = Reader(lines)
        try:
            if reader.peek() is None:
                out += [_plain("")] if opened else []
                continue
            out.append(reader.node(0))
            rest = reader.peek()
        except (IndexError, KeyError, AttributeError, TypeError, RecursionError) as e:
            raise ValueError("no YAML") from e
        if rest:
            raise ValueError(f"behind the document: {rest[1]}")
    return out


def plain(node: Node) -> Any:
    """A node as Python values."""
    if isinstance(node, dict):
        return {k: plain(v) for k, v in node.items()}
    if isinstance(node, list):
        return [plain(v) for v in node]
    kind, text = node
    return {"int": lambda: int(text, 0) if text[:2] in ("0x", "0o") else int(text), "float": lambda: float(text.replace(".inf", "inf").replace(".nan", "nan")), "bool": lambda: text.lower() == "true"}.get(kind, lambda: text)()


def _flat(node: Node, keys: tuple[str, ...], room: list[int]) -> Iterator[tuple[tuple[str, ...], str, str | None]]:
    room[0] -= 1
    if room[0] < 0:
        raise ValueError("aliases make more than the file has")
    if isinstance(node, tuple):
        yield keys, *node
    elif not node:
        yield keys, "map" if isinstance(node, dict) else "list", None
    else:
        for k, v in node.items() if isinstance(node, dict) else ((f"[{i}]", v) for i, v in enumerate(node)):
            yield from _flat(v, (*keys, k), room)


#: A document of a file: its place, that of the file's last one, and a row for each scalar.
DOCUMENT = "path string, document int, last int, rows array<struct<ordinal:int,keys:array<string>,kind:string,value:string>>"
#: Scalars of a written batch: what a task holds is bounded by this and by one file.
ROWS = 20_000


def _batch(files: list[tuple[str | None, int, int, list[tuple]]]) -> pa.RecordBatch:
    """files: path, document, the last document, and (ordinal, keys, kind, value) of each scalar."""
    rows = [r for f in files for r in f[3]]
    keys = [r[1] for r in rows]
    listed = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, keys))], type=pa.int32()), pa.array([k for own in keys for k in own], type=pa.string()))
    fields = [pa.array([r[0] for r in rows], type=pa.int32()), listed, pa.array([r[2] for r in rows], type=pa.string()), pa.array([r[3] for r in rows], type=pa.string())]
    nested = pa.ListArray.from_arrays(pa.array([0, *accumulate(len(f[3]) for f in files)], type=pa.int32()), pa.StructArray.from_arrays(fields, names=["ordinal", "keys", "kind", "value"]))
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], type=pa.string()), *(pa.array([f[i] for f in files], type=pa.int32()) for i in (1, 2)), nested], names=["path", "document", "last", "rows"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for path, content in zip(batch["path"], batch["content"], strict=True):
            text = content.as_py() or ""
            try:
                nodes, room, first, own = parse(text), [len(text) + 1000], 0, []
                for n, node in enumerate(nodes):
                    rows = [(i, *x) for i, x in enumerate(_flat(node, (), room), first)]
                    first += len(rows)
                    own.append((path.as_py(), n, len(nodes) - 1, rows))
            except (ValueError, RecursionError):
                own = []
            out.extend(own)
            held += sum(len(f[3]) for f in own)
            if held >= ROWS:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)


def documents(files: DataFrame) -> DataFrame:
    """files(path, content) as DOCUMENT: a row for each document, with its scalars in order."""
    return files.select("path", "content").mapInArrow(_documents, DOCUMENT)


def scalars(files: DataFrame) -> DataFrame:
    """files(path, content) as path, document (from 0), ordinal (in the file), keys, kind and value. keys are a map's keys and
    `[i]` for a list's item; kind is null, bool, int, float, str, and map or list where that is empty."""
    return documents(files).select("path", "document", F.inline("rows"))


def text_of(*keys: str) -> Column:
    """The value under just these keys of a document, out of its `rows`."""
    return F.get(F.filter("rows", lambda r: at(*keys, of=r["keys"])), F.lit(0))["value"]


def at(*keys: str | None, of: Column | None = None) -> Column:
    """Whether a row's keys (or those of `of`) are just these; None stands for any key."""
    own = F.col("keys") if of is None else of
    return (F.size(own) == len(keys)) & under(*keys, of=own)


def under(*keys: str | None, of: Column | None = None) -> Column:
    """Whether a row's keys (or those of `of`) start with these."""
    own = F.col("keys") if of is None else of
    out = F.size(own) >= len(keys)
    for i, k in enumerate(keys):
        if k is not None:
            out &= F.get(own, F.lit(i)) == k
    return out


def text_at(*keys: str | None) -> Column:
    """Aggregate: the value under just these keys."""
    return F.max(F.when(at(*keys), F.col("value")))


def list_at(*keys: str | None) -> Column:
    """Aggregate: the scalars of the list under these keys, in order."""
    own = F.when(at(*keys, None) & F.get("keys", F.lit(len(keys))).startswith("["), F.struct("ordinal", "value"))
    return F.transform(F.array_sort(F.collect_list(own)), lambda x: x["value"])
