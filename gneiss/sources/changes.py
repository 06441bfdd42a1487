"""Changed files and history, from the text that version control prints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_files(lines: DataFrame) -> DataFrame:
    """lines(ordinal, line) of name-status output: path, status. The first mention of a path counts; deleted ones go."""
    parts = F.split("line", "\t")
    code = F.substring(F.element_at(parts, 1), 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "deleted").otherwise("modified")
    seen = lines.where(F.size(parts) > 1).select("ordinal", F.element_at(parts, -1).alias("path"), status.alias("status"))
    first = seen.groupBy("path").agg(F.min_by("status", "ordinal").alias("status"))
    return first.where("status <> 'deleted'")


def valid_ref(ref: str) -> bool:
    """Whether a base reference has only harmless characters."""
    import re

    return bool(re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_./~^@{}-]*", ref))


def changed_only(files: DataFrame, changes: DataFrame) -> DataFrame:
    return files.join(changes.select("path"), "path", "left_semi")


def parse_commits(lines: DataFrame) -> DataFrame:
    """lines(ordinal, line) as hash|author|date|subject; the subject may hold more bars."""
    parts = F.split("line", "\\|", 4)
    return lines.where(F.size(parts) == 4).select("ordinal", *(parts[i].alias(k) for i, k in enumerate(("hash", "author", "date", "subject"))))


def added_lines(diff: DataFrame) -> DataFrame:
    """diff(hash, ordinal, line): the added lines and the file they are in, carried forward within a commit."""
    name = F.when(F.col("line").startswith("+++ b/"), F.expr("substring(line, 7)"))
    window = Window.partitionBy("hash").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    held = diff.withColumn("file", F.last(name, ignorenulls=True).over(window))
    return held.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++")).select("hash", "ordinal", "file", F.expr("substring(line, 2)").alias("line"))
