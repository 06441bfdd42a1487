"""Operations on findings. An `ordinal` column carries the order of the input wherever the first or last row counts."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.rules import WIRED
from gneiss.functions.scalars import fingerprint, fnv1a, line_bucket, rank_of, severity_rank
from gneiss.operators import modes
from gneiss.sources.stores import Store, staged


def spread(files: DataFrame) -> DataFrame:
    """files, dealt out anew where they stand in fewer stored files than the session has cores: a stored file may be one task,
    and scanning costs far more than moving. A corpus in many files stays where it is."""
    spark = files.sparkSession
    cores = spark.sparkContext.defaultParallelism
    stored = len(files.inputFiles())
    return files.repartition(4 * cores, "path") if 0 < stored < cores else files


def scan(files: DataFrame, families: tuple[modes.Family, ...] = WIRED, custom: tuple[modes.Rule, ...] = ()) -> DataFrame:
    """Findings of all families, in at most three passes over the files; scanner_ord is a family's place. custom: rules that users wrote
    (functions.rules.load_custom), looked for like the wired patterns, after all others."""
    families = (*families, modes.Family("", "M1", tuple(custom))) if custom else families
    return modes.findings_together(spread(files), families)


def running_totals(sizes: DataFrame, key: str, count: str = "count") -> DataFrame:
    """(key, before): the sum of `count` over all smaller keys, for distinct keys, with no task that sees all of them.

    Keys are dealt into ranges and written with their range's number; ranges have sums, of which there are as many as
    partitions, and a range's keys are summed up from there."""
    ranged = staged(sizes.select(key, count).repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted(ranged.groupBy("_range").agg(F.sum(count)).collect())
    offsets = [(r, sum(n for _, n in sums[:i])) for i, (r, _) in enumerate(sums)]
    base = F.broadcast(sizes.sparkSession.createDataFrame(offsets, "_range int, _base bigint"))
    inside = F.sum(count).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(base, "_range").select(key, (F.col("_base") + F.col("_inside")).alias("before"))


def with_ids(found: DataFrame, prefix: str = "SPX", order: tuple[str, ...] = ("file", "rule_ord", "pattern_ord", "line")) -> DataFrame:
    """PREFIX-0001 and so on in a total order.

    Rows are ranked among those of their first order column, and offset by the sizes of the smaller ones (running_totals).
    They are staged, so that they are found once."""
    first, rest = order[0], order[1:]
    found = staged(found, "found")
    before = running_totals(found.groupBy(first).count(), first).withColumnRenamed("before", "_before")
    own = F.row_number().over(Window.partitionBy(first).orderBy(*rest))
    ranked = found.withColumn("_own", own).join(before, found[first].eqNullSafe(before[first])).drop(before[first])
    return ranked.withColumn("id", F.format_string(f"{prefix}-%04d", F.col("_before") + F.col("_own"))).drop("_own", "_before")


def at_least(found: DataFrame, threshold: str, severity: str = "severity") -> DataFrame:
    """Findings as severe as the threshold or more. Unknown severities pass; an unknown threshold passes only these."""
    return found.where(severity_rank(severity) <= rank_of(threshold))


def dedup(found: DataFrame, keys: tuple[str, ...] = ("file", "line", "category"), order: str = "ordinal") -> DataFrame:
    """One finding for each key: the most severe, the first of equals, at the place of the key's first finding."""
    best = F.min_by(F.struct(*found.columns), F.struct(severity_rank("severity"), F.col(order)))
    out = found.groupBy(*keys).agg(best.alias("_best"), F.min(order).alias("position"))
    return out.select("_best.*", "position")


def with_fingerprint(found: DataFrame) -> DataFrame:
    return found.withColumn("fingerprint", fingerprint())


def baseline_of(found: DataFrame) -> DataFrame:
    return found.select("rule", "file", "line", "severity", "title", fingerprint().alias("fingerprint"))


def current_by_fingerprint(found: DataFrame) -> DataFrame:
    """One finding a fingerprint: the last one, at the place of the first."""
    rows = with_fingerprint(found)
    return rows.groupBy("fingerprint").agg(F.max_by(F.struct(*found.columns), "ordinal").alias("_last"), F.min("ordinal").alias("position")).select("fingerprint", "position", "_last.*")


def baseline_new(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return current_by_fingerprint(found).join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def baseline_fixed(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline rows, with their repeats, that nothing matches any more."""
    return baseline.join(with_fingerprint(found).select("fingerprint"), "fingerprint", "left_anti")


def baseline_unchanged(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(unchanged): how many distinct fingerprints are on both sides."""
    return current_by_fingerprint(found).join(baseline.select("fingerprint"), "fingerprint", "left_semi").agg(F.count("*").alias("unchanged"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings of a, with repeats, whose fingerprint b doesn't have."""
    return with_fingerprint(a).join(with_fingerprint(b).select("fingerprint"), "fingerprint", "left_anti")


def _stored(found: DataFrame, suppressions: DataFrame, how: str) -> DataFrame:
    keys = suppressions.select("rule", "file", line_bucket("line").alias("_bucket")).distinct()
    return found.withColumn("_bucket", line_bucket("line")).join(keys, ["rule", "file", "_bucket"], how).drop("_bucket")


def filter_suppressed(found: DataFrame, suppressions: DataFrame) -> DataFrame:
    return _stored(found, suppressions, "left_anti")


def suppressed(found: DataFrame, suppressions: DataFrame) -> DataFrame:
    return _stored(found, suppressions, "left_semi")


MARKER = "gneiss-ignore"


def filter_inline(found: DataFrame, lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """Drops findings whose line has the marker, or whose line before has it with the rule's name or without a colon.

    lines(path, line_no, line): only marked lines take part in the join."""
    marked = lines.where(F.contains("line", F.lit(marker))).select(F.col("path").alias("file"), F.col("line_no").alias("_at"), F.col("line").alias("_text"))
    same = marked.select("file", F.col("_at").alias("line"))
    before = marked.select("file", (F.col("_at") + 1).alias("line"), "_text")
    left = found.join(same, ["file", "line"], "left_anti")
    a, b = left.alias("a"), before.alias("b")
    clears = (F.col("a.file") == F.col("b.file")) & (F.col("a.line") == F.col("b.line")) & (F.contains("b._text", F.col("a.rule")) | ~F.contains("b._text", F.lit(":")))
    return a.join(b, clears, "left_anti")


def parse_ignores(lines: list[str]) -> list[tuple[str, str]]:
    """(kind, value) of an ignore file: rule:, category:, severity: or a path without * and **. Blank and # lines go."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        kind, _, value = line.partition(":")
        out.append((kind, value.strip()) if kind in ("rule", "category", "severity") else ("path", line.replace("**", "").replace("*", "")))
    return out


def filter_ignored(found: DataFrame, ignores: list[tuple[str, str]], empty_path_matches: bool = True) -> DataFrame:
    """Drops findings by an ignore file's patterns: a rule or path that contains the text, an equal category or severity.

    A bare * or ** leaves an empty text, which every path contains; empty_path_matches=False skips such patterns."""
    drop = F.lit(False)
    for kind, value in ignores:
        if kind == "path" and not value and not empty_path_matches:
            continue
        column = F.col({"path": "file"}.get(kind, kind))
        drop = drop | (F.contains(column, F.lit(value)) if kind in ("rule", "path") else column == value)
    return found.where(~F.coalesce(drop, F.lit(False)))


def merge_verdicts(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with verdicts(original_id, is_real, adjusted_severity, ordinal): real ones take the severity and high
    confidence, others go, those without a verdict stay as they are. The last verdict of an id counts."""
    last = verdicts.groupBy(F.col("original_id").alias("id")).agg(F.max_by(F.struct("is_real", "adjusted_severity"), "ordinal").alias("v"))
    real = F.col("v.is_real")
    return (
        found.join(last, "id", "left")
        .where(F.col("v").isNull() | real)
        .withColumn("severity", F.when(real, F.coalesce("v.adjusted_severity", "severity")).otherwise(F.col("severity")))
        .withColumn("confidence", F.when(real, "high").otherwise(F.col("confidence")))
        .drop("v")
    )


def dismissed(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(dismissed): how many findings a verdict calls not real."""
    last = verdicts.groupBy(F.col("original_id").alias("id")).agg(F.max_by("is_real", "ordinal").alias("is_real"))
    return found.join(last, "id").agg(F.count_if(~F.col("is_real")).alias("dismissed"))


def resolve_chains(chains: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """chains(position, title, severity, ...) with at least two members that are findings; members(position, pos,
    finding_id) keep their order and repeats. Ids number the chains before the test, so they have holes."""
    held = members.join(found.select(F.col("id").alias("finding_id")), "finding_id")
    kept = held.groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "finding_id"))), lambda x: x["finding_id"]).alias("members")).where(F.size("members") >= 2)
    return chains.join(kept, "position").withColumn("id", F.format_string("CHAIN-%03d", F.col("position") + 1))


def rule_config_hash(enabled: Column, disabled: Column) -> Column:
    """What a cache of scans is keyed by beside a file: FNV-1a of the sorted rule lists as JSON."""
    return fnv1a(F.to_json(F.struct(F.array_sort(enabled).alias("enabled"), F.array_sort(disabled).alias("disabled"))))


def merge_scanners(scanners: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str | None]]:
    """Findings of several scanners of one schema, with the scanner's name, and what each failed with (None: it didn't).

    All run at the same time; one that fails, when it is built or when it runs, takes none of the others' findings away.
    Each is written to the shared folder first, as a lazy plan would fail later and as a whole."""

    def run(name: str) -> DataFrame | str:
        try:
            found = scanners[name]().withColumn("scanner", F.lit(name))
            return staged(found, f"scanner-{name}")
        except Exception as failure:  # whatever a scanner throws is its own
            return f"{type(failure).__name__}: {str(failure)[:200]}"

    with ThreadPoolExecutor(max_workers=max(1, len(scanners))) as pool:
        done = dict(zip(scanners, pool.map(run, scanners), strict=True))
    kept = [x for x in done.values() if isinstance(x, DataFrame)]
    if not kept:
        raise RuntimeError(f"all scanners failed: {done}")
    return reduce(DataFrame.unionByName, kept), {k: None if isinstance(x, DataFrame) else x for k, x in done.items()}


def cached_scan(files: DataFrame, stored: DataFrame, rule_hash: str, families: tuple[modes.Family, ...] = WIRED) -> DataFrame:
    """Findings of files that changed, and the stored ones of files that didn't.

    stored: findings with content_hash and rule_hash. Files of another hash, and all if the rules changed, are scanned."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    known = stored.where(F.col("rule_hash") == rule_hash)
    clean = known.select(F.col("file").alias("path"), "content_hash").distinct()
    fresh = scan(hashed.join(clean, ["path", "content_hash"], "left_anti"), families)
    same = hashed.select(F.col("path").alias("file"), "content_hash")
    return fresh.unionByName(known.join(same, ["file", "content_hash"], "left_semi").select(*fresh.columns))


#: Tables of a scan's store: files that were scanned, with or without findings, and the findings.
SCAN_STORE = {
    "scanned": "path string, content_hash string, rule_hash string",
    "findings": "rule string, title string, severity string, category string, file string, line int, snippet string, cwe string, confidence string, scanner_ord int, rule_ord int, pattern_ord int",
}


def incremental_scan(files: DataFrame, store: Store, rule_hash: str, families: tuple[modes.Family, ...] = WIRED) -> tuple[DataFrame, DataFrame]:
    """(findings, scanned again): findings of all files, of which only those that are new or changed since the store's version,
    or all if the rules changed, are scanned; the store then holds the new version. Files that are gone leave it. Families
    that look at all files together (M6) have to be scanned apart.

    The scanned table names clean files too, so that they aren't scanned each time."""
    if any(f.mode == "M6" for f in families):
        raise ValueError("a family over all files together has no findings of one file")
    now = files.withColumn("content_hash", F.sha2("content", 256))
    known = store.load("scanned").where(F.col("rule_hash") == rule_hash).select("path", "content_hash").distinct()
    again = staged(now.join(known, ["path", "content_hash"], "left_anti").select(*files.columns), "again")
    fresh = scan(again, families)
    same = now.join(known, ["path", "content_hash"], "left_semi").select(F.col("path").alias("file")).distinct()
    kept = store.load("findings").join(same, "file", "left_semi")
    store.save({"scanned": now.select("path", "content_hash", F.lit(rule_hash).alias("rule_hash")).distinct(), "findings": fresh.unionByName(kept.select(*fresh.columns))})
    return store.load("findings"), again


def order_by_severity(found: DataFrame) -> list[Column]:
    return [severity_rank("severity"), F.col("ordinal")]


def top(found: DataFrame, n: int = 5, severe_only: bool = False) -> DataFrame:
    """The n most severe in input order; severe_only: the first n critical or high ones as they come."""
    if severe_only:
        return found.where(F.col("severity").isin("critical", "high")).orderBy("ordinal").limit(n)
    return found.orderBy(*order_by_severity(found)).limit(n)


def plan_phases(found: DataFrame, limits: tuple[tuple[str, int | None], ...] = (("critical", None), ("high", 10), ("medium", 10))) -> DataFrame:
    """All critical findings, then the first ten high and the first ten medium ones, with their phase."""
    number = F.row_number().over(Window.partitionBy("severity").orderBy("ordinal"))
    limited = [found.where(F.col("severity") == s).withColumn("phase", F.lit(i + 1)) if n is None else found.where(F.col("severity") == s).withColumn("_n", number).where(F.col("_n") <= n).drop("_n").withColumn("phase", F.lit(i + 1)) for i, (s, n) in enumerate(limits)]
    return reduce(DataFrame.unionByName, limited)
