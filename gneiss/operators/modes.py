"""The seven ways in which rules are evaluated over files: native expressions, rules folded in as literals.

Every mode returns hits: path, rule_ord, pattern_ord, line, snippet (and matched text's rule by number). `findings`
turns hits of a rule list into findings. A family's gate is a filter on whole files, below the split into lines.
Windows of lines are slices of the file's own array, so they need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache, reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import js_trim, match_line
from gneiss.sources.corpus import with_lines

CHUNK, SLICE = 50, 20
#: What makes M6's missing rules hold their peace wherever it occurs.
SILENCER = "helmet"


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    severity: str
    patterns: tuple[str, ...]
    cwe: str | None = None
    category: str = "custom"
    languages: tuple[str, ...] = ("*",)
    confidence: str = "medium"
    #: M2, M4, M5: lines from the match (first, last) in which `mitigation` clears it.
    window: tuple[int, int] | None = None
    mitigation: str | None = None
    #: M6: "missing" or "present".
    check: str | None = None
    #: M7: what the path must contain, and what the whole file must and must not contain.
    path_contains: str | None = None
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Family:
    """Rules that share a mode, file names and a gate."""

    prefix: str
    mode: str
    rules: tuple[Rule, ...]
    extensions: tuple[str, ...] = ()
    gate: str | None = None
    confidence: str = "medium"
    wired: bool = True
    #: Files over so many bytes aren't looked at; by default all are.
    cap: int | None = None
    id_prefix: str = "SPX"
    extra: dict = field(default_factory=dict)


def regex(pattern: str) -> str:
    """Case never matters; ^ and $ are ends of the text that is tested."""
    return f"(?i){pattern}"


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Words in lower case of which every text that the pattern matches holds one; none where that can't be told."""

    def of(parts) -> set[str] | None:
        sets, run = [], ""
        for op, arg in [*parts, (None, None)]:
            if op is C.LITERAL and 32 < arg < 127:
                run += chr(arg).lower()
                continue
            sets, run = (sets + [{run}] if run else sets), ""
            if op is C.SUBPATTERN:
                sets.append(of(arg[3]))
            elif op is C.BRANCH:
                each = [of(x) for x in arg[1]]
                sets.append(None if None in each else set().union(*each))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
                sets.append(of(arg[2]))
        # the words that are hardest to find: the longest ones, and few of them
        return max(filter(None, sets), key=lambda x: (min(map(len, x)), -len(x)), default=None)

    # a class inside a class, which Python reads otherwise
    if re.search(r"\[\^?\]?[^\]]*(\[|&&)", re.sub(r"\\.", "_", pattern, flags=re.S)):
        return ()
    try:
        return tuple(sorted(of(_parser.parse(pattern)) or ()))
    except (re.error, OverflowError, RecursionError):
        return ()


def holds(low: Column, pattern: str) -> Column:
    """Whether a text, given in lower case, holds a word that the pattern needs: far cheaper than the pattern, and false for
    most texts and patterns."""
    words = needed(pattern)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)) if words else F.lit(True)


def gated(files: DataFrame, family: Family) -> DataFrame:
    files = files.where("content is not null")
    if family.cap is not None:
        files = files.where(F.col("length") <= family.cap)
    if family.extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).isin(*family.extensions))
    if family.gate:
        files = files.where(F.col("content").rlike(regex(family.gate)))
    return files


def _numbered(rules: Sequence[Rule]) -> Iterator[list[tuple[int, int, Rule, str]]]:
    every = [(i, j, r, p) for i, r in enumerate(rules) for j, p in enumerate(r.patterns)]
    for k in range(0, len(every), CHUNK):
        yield every[k : k + CHUNK]


def _applies(rule: Rule) -> Column:
    """Files of no known language are looked at by every rule."""
    if "*" in rule.languages:
        return F.lit(True)
    return F.col("lang").isNull() | F.col("lang").isin(*rule.languages)


def _one(i: int, j: int) -> Column:
    return F.struct(F.lit(i).alias("rule_ord"), F.lit(j).alias("pattern_ord"))


def _exploded(df: DataFrame, tests: list[Column], *keep: Column | str) -> DataFrame:
    hits = F.array_compact(F.array(*tests))
    return df.select(*keep, F.explode(hits).alias("_h"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def line_any(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """M1: a hit for each line and pattern that matches it."""
    lines = files.select("path", "lang", F.posexplode(F.split("content", "\n")).alias("pos", "text")).withColumn("low", F.lower("text"))
    parts = []
    for chunk in _numbered(rules):
        tests = [F.when(_applies(r) & holds(F.col("low"), p) & F.col("text").rlike(regex(p)), _one(i, j)) for i, j, r, p in chunk]
        parts.append(_exploded(lines, tests, "path", (F.col("pos") + 1).alias("line"), "text"))
    return _union(parts).select("path", "_h.rule_ord", "_h.pattern_ord", "line", js_trim("text").alias("snippet"))


def rule_join(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """M1 for rules that are data: rules(rule, regex), a nested-loop join that broadcasts the rules.

    Rules are written by people; callers that load them check their number (see functions.rules.MAX_CUSTOM)."""
    return lines.join(F.broadcast(rules), F.expr("line rlike concat('(?i)', regex)"))


def window_text(lo: int, hi: int, line: Column | str = "line") -> Column:
    """The text of lines line+lo to line+hi of the column `lines`."""
    line = F.col(line) if isinstance(line, str) else line
    start = F.greatest(F.lit(1), line + lo)
    return F.array_join(F.slice("lines", start, F.greatest(F.lit(0), line + hi - start + 1)), "\n")


def line_unmitigated(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """M2: as M1, without hits whose window of lines holds the rule's mitigation."""
    split = with_lines(files)
    parts = []
    lines = split.select("path", "lang", "lines", F.posexplode("lines").alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    for chunk in _numbered(rules):
        tests = []
        for i, j, r, p in chunk:
            test = _applies(r) & F.col("text").rlike(regex(p))
            if r.mitigation:
                test = test & ~window_text(*r.window).rlike(regex(r.mitigation))
            tests.append(F.when(test, _one(i, j)))
        parts.append(_exploded(lines, tests, "path", "line", "text"))
    return _union(parts).select("path", "_h.rule_ord", "_h.pattern_ord", "line", js_trim("text").alias("snippet"))


def _line_of(line: Column) -> Column:
    return js_trim(F.get("lines", line - 1))


def file_first(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """M3: a hit for each file and rule, of the first pattern in the list that matches the whole text."""
    split = with_lines(files)
    parts = []
    for k in range(0, len(rules), CHUNK):
        tests = []
        for i, r in enumerate(rules[k : k + CHUNK], k):
            first = F.coalesce(*(F.when(F.col("content").rlike(regex(p)), F.struct(F.lit(j).alias("pattern_ord"), match_line(F.col("content"), regex(p)).alias("line"))) for j, p in enumerate(r.patterns)))
            tests.append(F.when(_applies(r) & first.isNotNull(), F.struct(F.lit(i).alias("rule_ord"), first["pattern_ord"].alias("pattern_ord"), first["line"].alias("line"))))
        parts.append(_exploded(split, tests, "path", "lines"))
    return _union(parts).select("path", "_h.rule_ord", "_h.pattern_ord", F.col("_h.line").alias("line"), _line_of(F.col("_h.line")).alias("snippet"))


def _firsts(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The first match of each pattern, and whether its window mitigates it."""
    split = with_lines(files)
    parts = []
    for chunk in _numbered(rules):
        tests = []
        for i, j, r, p in chunk:
            line = match_line(F.col("content"), regex(p))
            clear = window_text(*r.window, line).rlike(regex(r.mitigation)) if r.mitigation else F.lit(False)
            tests.append(F.when(_applies(r) & line.isNotNull(), F.struct(F.lit(i).alias("rule_ord"), F.lit(j).alias("pattern_ord"), line.alias("line"), clear.alias("clear"))))
        parts.append(_exploded(split, tests, "path", "lines"))
    return _union(parts).where("not _h.clear").select("path", "_h.rule_ord", "_h.pattern_ord", F.col("_h.line").alias("line"), _line_of(F.col("_h.line")).alias("snippet"))


def pattern_first(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """M4: the first match of each pattern; a mitigated first match hides later ones of the pattern."""
    return _firsts(files, rules)


def first_unmitigated(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """M5: for each file and rule the first pattern whose first match isn't mitigated."""
    best = _firsts(files, rules).groupBy("path", "rule_ord").agg(F.min_by(F.struct("pattern_ord", "line", "snippet"), "pattern_ord").alias("b"))
    return best.select("path", "rule_ord", "b.pattern_ord", "b.line", "b.snippet")


def corpus_presence(files: DataFrame, rules: Sequence[Rule], silencer: str = SILENCER) -> DataFrame:
    """M6: over all files together. A `missing` rule hits once, at line 0 of the first file, if neither its patterns nor
    the silencer occur anywhere; a `present` rule hits at its first matching line of each file."""
    missing = [(i, r) for i, r in enumerate(rules) if r.check == "missing"]
    present = [(i, r) for i, r in enumerate(rules) if r.check == "present"]
    parts = []
    if missing:
        seen = [F.bool_or(F.col("content").rlike(regex("|".join((*r.patterns, silencer))))).alias(f"r{i}") for i, r in missing]
        one = files.agg(F.min("path").alias("path"), *seen).where("path is not null")
        tests = [F.when(~F.col(f"r{i}"), _one(i, 0)) for i, _ in missing]
        parts.append(_exploded(one, tests, "path").select("path", "_h.rule_ord", "_h.pattern_ord", F.lit(0).alias("line"), F.lit("").alias("snippet")))
    if present:
        hits = line_any(files, [r for _, r in present])
        number = F.element_at(F.array(*(F.lit(i) for i, _ in present)), F.col("rule_ord") + 1)
        first = hits.groupBy("path", number.alias("rule_ord")).agg(F.min(F.struct("line", "pattern_ord", "snippet")).alias("b"))
        parts.append(first.select("path", "rule_ord", "b.pattern_ord", "b.line", "b.snippet"))
    return _union(parts)


def structural(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """M7: conditions on the path and the whole file, then matching lines, or line 1 for a rule without patterns."""
    parts = []
    for i, r in enumerate(rules):
        own = files.where(F.contains("path", F.lit(r.path_contains))) if r.path_contains else files
        for text in r.has:
            own = own.where(F.contains("content", F.lit(text)))
        for text in r.lacks:
            own = own.where(~F.contains("content", F.lit(text)))
        if r.patterns:
            parts.append(line_any(own, [r]).withColumn("rule_ord", F.lit(i)))
        else:
            parts.append(own.select("path", F.lit(i).alias("rule_ord"), F.lit(0).alias("pattern_ord"), F.lit(1).alias("line"), js_trim(F.get(F.split("content", "\n"), F.lit(0))).alias("snippet")))
    return _union(parts)


MODES = {"M1": line_any, "M2": line_unmitigated, "M3": file_first, "M4": pattern_first, "M5": first_unmitigated, "M6": corpus_presence, "M7": structural}


def hits(files: DataFrame, family: Family) -> DataFrame:
    return MODES[family.mode](gated(files, family), family.rules)


def findings(files: DataFrame, family: Family, ordinal: int = 0) -> DataFrame:
    """The family's findings without ids; `ordinal` is the family's place among those that are scanned together."""
    rules = family.rules

    def pick(values: Sequence[str | None]) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("rule_ord") + 1)

    prefix = f"{family.prefix}:" if family.prefix else ""
    return hits(files, family).select(
        pick([prefix + r.id for r in rules]).alias("rule"),
        pick([r.title for r in rules]).alias("title"),
        pick([r.severity for r in rules]).alias("severity"),
        pick([r.category for r in rules]).alias("category"),
        F.col("path").alias("file"),
        "line",
        F.substring("snippet", 1, 300).alias("snippet"),
        pick([r.cwe for r in rules]).cast("string").alias("cwe"),
        F.lit(family.confidence).alias("confidence"),
        F.lit(ordinal).alias("scanner_ord"),
        "rule_ord",
        "pattern_ord",
    )


def _gate(family: Family) -> Column:
    """What `gated` filters by, as a test of a file and its text in lower case."""
    tests = [F.col("content").isNotNull()]
    if family.cap is not None:
        tests.append(F.col("length") <= family.cap)
    if family.extensions:
        tests.append(F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).isin(*family.extensions))
    if family.gate:
        tests.append(holds(F.col("low"), family.gate) & F.col("content").rlike(regex(family.gate)))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _shape(rule: Rule) -> Column:
    """What M7 asks of a file's path and text."""
    tests = [F.contains("path", F.lit(rule.path_contains))] if rule.path_contains else []
    tests += [F.contains("content", F.lit(t)) for t in rule.has] + [~F.contains("content", F.lit(t)) for t in rule.lacks]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(True)


def _hit(k: int, i: int, j: int | Column, line: Column) -> Column:
    return F.struct(F.lit(k).alias("scanner_ord"), F.lit(i).alias("rule_ord"), (F.lit(j) if isinstance(j, int) else j).alias("pattern_ord"), line.cast("int").alias("line"))


def _flat(tests: list[tuple[Column, list[Column]]]) -> Column:
    """Hits of groups of tests as one array. A group is looked at only where its condition holds, and is cut into slices, so
    that no expression is one of hundreds."""
    slices = [F.when(on, F.array_compact(F.array(*own[k : k + SLICE]))) for on, own in tests for k in range(0, len(own), SLICE)]
    return F.flatten(F.array_compact(F.array(*slices)))


def _line_tests(k: int, family: Family) -> tuple[list[tuple[Column, list[Column]]], list[tuple[str, Column]]]:
    """Tests of single lines (M1, and M7 with patterns), and the conditions on whole files that they name."""
    needs, groups = [(f"g{k}", _gate(family))], []
    tests = {i: [F.when(_applies(r) & holds(F.col("low"), p) & F.col("text").rlike(regex(p)), _hit(k, i, j, F.col("pos") + 1)) for j, p in enumerate(r.patterns)] for i, r in enumerate(family.rules)}
    if family.mode != "M7":
        return [(F.col(f"g{k}"), [t for own in tests.values() for t in own])], needs
    for i, r in enumerate(family.rules):
        if r.patterns:
            needs.append((f"s{k}_{i}", _gate(family) & _shape(r)))
            groups.append((F.col(f"s{k}_{i}"), tests[i]))
    return groups, needs


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(regex(pattern))


def _file_tests(k: int, family: Family) -> list[Column]:
    """Tests of whole files: M3, M4, M5, M6 of what is present, M7 without patterns."""
    content, out = F.col("content"), []
    for i, r in enumerate(family.rules):
        firsts = []
        for j, p in enumerate(r.patterns):
            if family.mode == "M6":
                line = F.nullif(F.array_position(F.transform("lines", _like(p)), True), F.lit(0))
            else:
                line = match_line(content, regex(p))
            ok = line.isNotNull()
            if r.mitigation and family.mode in ("M4", "M5"):
                ok = ok & ~window_text(*r.window, line).rlike(regex(r.mitigation))
            firsts.append(F.when(holds(F.col("low"), p), F.when(ok, _hit(k, i, j, line))))
        if family.mode == "M4":
            out += [F.when(_applies(r), x) for x in firsts]
        elif family.mode in ("M3", "M5"):
            out.append(F.when(_applies(r), F.coalesce(*firsts)))
        elif family.mode == "M6" and r.check == "present":
            least = F.array_min(F.array_compact(F.array(*(F.when(x.isNotNull(), F.struct(x["line"].alias("line"), F.lit(j).alias("j"))) for j, x in enumerate(firsts)))))
            out.append(F.when(least.isNotNull(), _hit(k, i, least["j"], least["line"])))
        elif family.mode == "M7" and not r.patterns:
            out.append(F.when(_shape(r), _hit(k, i, 0, F.lit(1))))
    return out


def _window_tests(k: int, family: Family, text: Column, line: Column) -> list[Column]:
    """M2's tests of one line among the file's lines. What a pattern needs is looked for in the line: in the whole text that
    would cost the text's length for each of its lines."""
    low, out = F.lower(text), []
    for i, r in enumerate(family.rules):
        for j, p in enumerate(r.patterns):
            test = _applies(r) & holds(low, p) & text.rlike(regex(p))
            if r.mitigation:
                test = test & ~window_text(*r.window, line).rlike(regex(r.mitigation))
            out.append(F.when(test, _hit(k, i, j, line)))
    return out


def hits_together(files: DataFrame, families: Sequence[Family]) -> DataFrame:
    """Hits of many families in at most three passes over the files: scanner_ord, path, rule_ord, pattern_ord, line, snippet.

    One pass tests single lines (M1, and M7 with patterns), one whole files and windows of their own lines (M2 to M5, what M6
    looks for, and M7 without patterns), one what M6 finds nowhere. Gates are columns of the file, computed once."""
    every = list(enumerate(families))
    files = files.withColumn("low", F.lower("content"))
    parts = []
    by_line = [(k, f) for k, f in every if f.mode == "M1" or f.mode == "M7" and any(r.patterns for r in f.rules)]
    if by_line:
        tests, needs = [], []
        for k, f in by_line:
            own, more = _line_tests(k, f)
            tests, needs = tests + own, needs + more
        some = reduce(lambda a, b: a | b, (F.col(f"g{k}") for k, _ in by_line))
        gated_files = files.select("path", "lang", "content", *(c.alias(n) for n, c in needs)).where(some)
        lines = gated_files.select("path", "lang", *(n for n, _ in needs), F.posexplode(F.split("content", "\n")).alias("pos", "text")).withColumn("low", F.lower("text"))
        parts.append(lines.select("path", "text", F.explode(_flat(tests)).alias("h")).select("path", "h.*", js_trim("text").alias("snippet")))
    by_file = [(k, f) for k, f in every if f.mode in ("M2", "M3", "M4", "M5", "M6", "M7")]
    by_file = [(k, f) for k, f in by_file if f.mode != "M7" or not all(r.patterns for r in f.rules)]
    by_file = [(k, f) for k, f in by_file if f.mode != "M6" or any(r.check == "present" for r in f.rules)]
    if by_file:
        own = with_lines(files.select("*", *(_gate(f).alias(f"g{k}") for k, f in by_file)).where(reduce(lambda a, b: a | b, (F.col(f"g{k}") for k, _ in by_file))))
        whole = [(F.col(f"g{k}"), _file_tests(k, f)) for k, f in by_file if f.mode != "M2"]
        windows = [(k, f) for k, f in by_file if f.mode == "M2"]
        found = [_flat(whole)] if whole else []
        if windows:
            found.append(F.flatten(F.transform("lines", lambda x, n: _flat([(F.col(f"g{k}"), _window_tests(k, f, x, n + 1)) for k, f in windows]))))
        # a hit takes its own line along, not all lines of its file
        said = F.transform(F.concat(*found), lambda h: F.struct(h.alias("h"), _line_of(h["line"]).alias("snippet")))
        parts.append(own.select("path", F.explode(said).alias("x")).select("path", "x.h.*", "x.snippet"))
    nowhere = [(k, f) for k, f in every if f.mode == "M6" and any(r.check == "missing" for r in f.rules)]
    if nowhere:
        # one row: whether a rule's patterns, or what silences it, occur in any of its family's files
        absent = [(k, i, r) for k, f in nowhere for i, r in enumerate(f.rules) if r.check == "missing"]
        gates = files.select("path", "content", "low", *(_gate(f).alias(f"g{k}") for k, f in nowhere))
        seen = [F.bool_or(F.col(f"g{k}") & holds(F.col("low"), "|".join((*r.patterns, SILENCER))) & F.col("content").rlike(regex("|".join((*r.patterns, SILENCER))))).alias(f"r{k}_{i}") for k, i, r in absent]
        one = gates.agg(*(F.min(F.when(F.col(f"g{k}"), F.col("path"))).alias(f"p{k}") for k, _ in nowhere), *seen)
        tests = [F.when(F.col(f"p{k}").isNotNull() & ~F.col(f"r{k}_{i}"), F.struct(F.col(f"p{k}").alias("path"), _hit(k, i, 0, F.lit(0)).alias("h"))) for k, i, _ in absent]
        parts.append(one.select(F.explode(_flat([(F.lit(True), tests)])).alias("x")).select("x.path", "x.h.*", F.lit("").alias("snippet")))
    return _union(parts)


def findings_together(files: DataFrame, families: Sequence[Family]) -> DataFrame:
    """As `findings` of each family, all together."""

    def about(f: Family, r: Rule) -> Column:
        prefix = f"{f.prefix}:" if f.prefix else ""
        said = {"rule": prefix + r.id, "title": r.title, "severity": r.severity, "category": r.category, "cwe": r.cwe, "confidence": f.confidence}
        return F.struct(*(F.lit(v).cast("string").alias(n) for n, v in said.items()))

    known = F.array(*(F.array(*(about(f, r) for r in f.rules)) for f in families))
    out = hits_together(files, families).withColumn("r", F.element_at(F.element_at(known, F.col("scanner_ord") + 1), F.col("rule_ord") + 1))
    return out.select("r.rule", "r.title", "r.severity", "r.category", F.col("path").alias("file"), "line", F.substring("snippet", 1, 300).alias("snippet"), "r.cwe", "r.confidence", "scanner_ord", "rule_ord", "pattern_ord")
