"""Classes with their methods, and routes with what stands before their handlers, out of source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines after a class in which its methods are looked for.
CLASS_LINES = 199
#: Lines and characters from a route's call on in which its bracket closes.
CALL_LINES, CALL_CHARS = 40, 4000
SCRIPT = r"\.[cm]?[jt]sx?$"


def _lines(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.split("content", "\n").alias("lines"))
    return rows.select("path", "lines", F.posexplode("lines").alias("pos", "text")).withColumn("line", F.col("pos") + 1)


def _until(part: Column, stop: str, first: int = 1) -> Column:
    """The array up to the first element, from the `first` one on, that matches; all without one."""
    at = F.array_position(F.transform(part, lambda x, i: x.rlike(stop) & (i + 1 >= first)), True)
    return F.when(at > 0, F.slice(part, F.lit(1), (at - 1).cast("int"))).otherwise(part)


def class_definitions(files: DataFrame) -> DataFrame:
    """path, name, parent, line, methods. A script's class ends at a line that starts with a closing brace, a Python class
    before the next line that isn't indented; methods are looked for in 199 lines at most. What is written as a method is
    one: words before a bracket at the start of an indented line, constructors aside."""
    script, python = F.col("path").rlike(SCRIPT), F.endswith("path", F.lit(".py"))
    ps, pp = r"^(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?", r"^class\s+(\w+)(?:\((\w+)\))?"
    found = _lines(files).where((script & F.col("text").rlike(ps)) | (python & F.col("text").rlike(pp)))
    part = F.slice("lines", F.col("line") + 1, F.lit(CLASS_LINES))
    of = lambda lines, p: F.filter(F.transform(lines, lambda x: F.regexp_extract(x, p, 1)), lambda m: (m != "") & (m != "constructor"))
    methods = F.when(script, of(_until(part, r"^\}"), r"^\s+(?:async\s+)?(\w+)\s*\(")).otherwise(of(_until(part, r"^\S", 2), r"^\s+(?:async\s+)?def\s+(\w+)"))
    group = lambda n: F.when(script, F.regexp_extract("text", ps, n)).otherwise(F.regexp_extract("text", pp, n))
    return found.select("path", group(1).alias("name"), F.nullif(group(2), F.lit("")).alias("parent"), F.col("line").cast("int").alias("line"), methods.alias("methods"))


def call_arguments(text: Column) -> Column:
    """The arguments of the call whose opening bracket is the text's first character, trimmed; null if it doesn't close.

    A fold over characters with the depth of brackets and the open quote; commas at depth one cut. Only cuts are kept."""
    chars = F.split(text, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("skip"), F.array(F.lit(0)).alias("cuts"), F.lit(False).alias("done"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        inside, here = s["quote"] != "", ~s["done"]
        opens, closes = ~inside & c.isin("(", "[", "{"), ~inside & c.isin(")", "]", "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        ends = closes & (depth == 0)
        cut = ends | (~inside & (c == ",") & (s["depth"] == 1))
        quote = F.when(s["skip"], s["quote"]).when(inside & (c == s["quote"]), "").when(~inside & c.isin("'", '"', "`"), c).otherwise(s["quote"])
        return F.struct(
            F.when(here, depth).otherwise(s["depth"]).alias("depth"), F.when(here, quote).otherwise(s["quote"]).alias("quote"), (inside & ~s["skip"] & (c == "\\")).alias("skip"),
            F.when(here & cut & ~s["skip"], F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"]).alias("cuts"), (s["done"] | (ends & ~s["skip"])).alias("done"), (s["i"] + 1).alias("i"),
        )

    def arguments(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(s["cuts"]) - 1), lambda k: F.btrim(F.substring(text, F.get(s["cuts"], k - 1) + 2, F.get(s["cuts"], k) - F.get(s["cuts"], k - 1) - 1), F.lit(" \t\r\n")))
        return F.when(s["done"], F.filter(parts, lambda p: p != ""))

    return F.aggregate(chars, start, step, arguments)


def _listed(argument: Column) -> Column:
    """What an argument gives to a chain: the items of a list, or itself."""
    return F.when(F.startswith(argument, F.lit("[")), F.coalesce(call_arguments(argument), F.array(argument))).otherwise(F.array(argument))


def route_definitions(files: DataFrame) -> DataFrame:
    """path, method, route, handler, line, middleware, chain, handlers.

    middleware: words between two commas of the route's own line. chain: what stands between the route's path and its last
    argument, over as many lines as the call takes, with lists taken apart; empty where the call doesn't close within
    CALL_LINES. handlers, which graph.endpoints looks at, is both joined: a handler's body isn't part of it. Functions named
    as methods are routes of their file; decorators and registrations of Python and Go have no middleware."""
    lines = _lines(files)
    script, python, go = F.col("path").rlike(SCRIPT), F.endswith("path", F.lit(".py")), F.endswith("path", F.lit(".go"))
    express = r"(?:app|router|server)\.(get|post|put|patch|delete|all|use)\s*\(\s*['\"]([^'\"]*)['\"]"
    named = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\("
    flask = r"@(?:app|router|api)\.(get|post|put|patch|delete|route)\s*\(\s*['\"]([^'\"]*)['\"]"
    served = r"(?:Handle|HandleFunc|Get|Post|Put|Delete|Patch)\s*\(\s*['\"]([^'\"]*)['\"]"
    none = F.array().cast("array<string>")
    get = lambda p, n: F.regexp_extract("text", p, n)
    called = F.substring(F.array_join(F.slice("lines", F.col("line"), F.lit(CALL_LINES)), "\n"), F.regexp_instr("text", F.lit(express)), F.lit(CALL_CHARS))
    given = call_arguments(F.substring(called, F.instr(called, "("), F.lit(CALL_CHARS)))
    own = lines.where(script & F.col("text").rlike(express)).withColumn("given", given)
    between = F.when(F.size("given") > 2, F.flatten(F.transform(F.slice("given", F.lit(2), F.size("given") - 2), _listed))).otherwise(none)
    parts = [
        own.select("path", F.upper(get(express, 1)).alias("method"), get(express, 2).alias("route"), F.lit("").alias("handler"), "line", F.regexp_extract_all("text", F.lit(r",\s*(\w+)\s*,"), 1).alias("middleware"), between.alias("chain")),
        lines.where(script & F.col("text").rlike(named)).select("path", get(named, 1).alias("method"), F.col("path").alias("route"), get(named, 1).alias("handler"), "line", none.alias("middleware"), none.alias("chain")),
        lines.where(python & F.col("text").rlike(flask)).select("path", F.upper(get(flask, 1)).alias("method"), get(flask, 2).alias("route"), F.lit("").alias("handler"), "line", none.alias("middleware"), none.alias("chain")),
        lines.where(go & F.col("text").rlike(served)).select("path", F.when(F.contains("text", F.lit("Get")), "GET").when(F.contains("text", F.lit("Post")), "POST").otherwise("ALL").alias("method"), get(served, 1).alias("route"), F.lit("").alias("handler"), "line", none.alias("middleware"), none.alias("chain")),
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("line", F.col("line").cast("int")).withColumn("handlers", F.array_join(F.array_distinct(F.concat("middleware", "chain")), " "))
