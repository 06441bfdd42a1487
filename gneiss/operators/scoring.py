"""Counts, scores and trends. Scores are sums of integer tenths, so that order can't change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.scalars import severity_rank
from gneiss.schemas import SEVERITIES

#: Tenths of a point that a finding and a chain cost.
FINDING_COST = {"critical": 20, "high": 10, "medium": 5, "low": 2, "info": 0}
CHAIN_COST = {"critical": 15, "high": 10, "medium": 5, "low": 0, "info": 0}
MARKDOWN_CHAIN_COST = CHAIN_COST | {"low": 5, "info": 5}


def severity_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def cost(severity: Column, table: dict[str, int]) -> Column:
    out = F.when(F.lit(False), 0)
    for s, n in table.items():
        out = out.when(severity == s, n)
    return out.otherwise(0)


def from_tenths(cost_tenths: Column) -> Column:
    return (F.least(F.greatest(F.lit(100) - cost_tenths, F.lit(0)), F.lit(100)) / 10).cast("double")


def trust_score(found: DataFrame, chains: DataFrame | None = None, chain_cost: dict[str, int] = CHAIN_COST) -> DataFrame:
    """(trust_score): 10 less what findings and chains cost, from 0 to 10. Chains are left out where there are none."""
    costs = found.select(cost(F.col("severity"), FINDING_COST).alias("c"))
    if chains is not None:
        costs = costs.unionByName(chains.select(cost(F.col("severity"), chain_cost).alias("c")))
    return costs.agg(from_tenths(F.coalesce(F.sum("c"), F.lit(0))).alias("trust_score"))


def category_top(found: DataFrame) -> DataFrame:
    """Count and top severity of each category; most first, ties by first appearance."""
    out = found.groupBy("category").agg(F.count("*").alias("n"), F.min(severity_rank("severity")).alias("rank"), F.min("ordinal").alias("first_seen"))
    names = F.array(*map(F.lit, SEVERITIES))
    return out.select("category", "n", F.get(names, "rank").alias("top_severity"), "first_seen").orderBy(F.desc("n"), "first_seen")


def _grade(total: Column) -> Column:
    return F.when(total >= 90, "A+").when(total >= 80, "A").when(total >= 70, "B").when(total >= 60, "C").when(total >= 50, "D").otherwise("F")


def scorecard(found: DataFrame, has_lockfile: bool, tooling: int) -> DataFrame:
    """Points for code (all findings, by severity), secrets, dependencies, infrastructure and tooling (0 to 15, given),
    their total and grade."""
    kind = F.col("category")
    n = found.agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES[:4]),
        *(F.count_if(kind == c).alias(c) for c in ("secrets", "dependency", "iac")),
    )

    def floor(x: Column) -> Column:
        return F.round(F.greatest(x, F.lit(0.0))).cast("int")

    code = floor(F.lit(30.0) - 10 * F.col("critical") - 5 * F.col("high") - 2 * F.col("medium") - 0.5 * F.col("low"))
    parts = n.select(code.alias("code"), floor(F.lit(20.0) - 10 * F.col("secrets")).alias("secret_points"), (floor(F.lit(20.0) - 3 * F.col("dependency")) if has_lockfile else F.lit(10)).alias("dependency_points"), floor(F.lit(15.0) - 3 * F.col("iac")).alias("iac_points"), F.lit(min(15, tooling)).alias("tooling"))
    total = F.col("code") + F.col("secret_points") + F.col("dependency_points") + F.col("iac_points") + F.col("tooling")
    return parts.withColumn("total", total).withColumn("grade", _grade(F.col("total")))


def history_rows(found: DataFrame, by: str = "scan_id") -> DataFrame:
    """A row a scan: counts and trust score."""
    return found.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES[:4]), from_tenths(F.sum(cost(F.col("severity"), FINDING_COST))).alias("trust_score"))


def changelog(history: DataFrame, order: str = "scan_id") -> DataFrame:
    """Each scan with how total and score changed since the one before. One row a scan of one project."""
    w = Window.orderBy(order)
    return history.select(order, "total", "trust_score", (F.col("total") - F.lag("total").over(w)).alias("total_delta"), (F.round((F.col("trust_score") - F.lag("trust_score").over(w)) * 10) / 10).alias("score_delta"))


def first_and_latest(history: DataFrame, order: str = "scan_id") -> DataFrame:
    return history.agg(F.min_by("total", order).alias("first_total"), F.max_by("total", order).alias("latest_total"), F.min_by("trust_score", order).alias("first_score"), F.max_by("trust_score", order).alias("latest_score"))


def last_scans(history: DataFrame, n: int, order: str = "scan_id") -> DataFrame:
    """The last n scans, oldest first."""
    return history.orderBy(F.desc(order)).limit(n).orderBy(order)


def confidence_tiers(found: DataFrame) -> DataFrame:
    """confirmed (high and real), likely (high), possible and dismissed."""
    real, high = F.coalesce("ai_verified", F.lit(False)), F.col("confidence") == "high"
    false = F.coalesce("false_positive", F.lit(False))
    return found.agg(F.count_if(~false & real & high).alias("confirmed"), F.count_if(~false & ~real & high).alias("likely"), F.count_if(~false & ~high).alias("possible"), F.count_if(false).alias("dismissed"))


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.min("cached_at").alias("oldest"))


def distinct_values(found: DataFrame, *columns: str) -> DataFrame:
    return found.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def replay_scoreboard(cases: DataFrame) -> DataFrame:
    """cases(caught, clean_at_fix, require_catch)."""
    return cases.agg(F.count("*").alias("total"), F.count_if("caught").alias("caught"), F.count_if("clean_at_fix").alias("fix_clean"), F.count_if(F.col("require_catch") & ~F.col("caught")).alias("gated_failures"))


def expected_found(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected(case, file_hint, rule_class) with caught: a finding's file ends with the hint and its rule contains the
    class. Distinct files, rules, hints and classes meet, not cases and findings."""
    one = found.select("file", "rule").distinct()
    hints, classes = expected.select("file_hint").distinct(), expected.select("rule_class").distinct()
    files = one.select("file").distinct().join(hints, F.endswith("file", "file_hint"))
    rules = one.select("rule").distinct().join(classes, F.contains("rule", "rule_class"))
    caught = one.join(files, "file").join(rules, "rule").select("file_hint", "rule_class").distinct().withColumn("caught", F.lit(True))
    return expected.join(caught, ["file_hint", "rule_class"], "left").select("case", "file_hint", "rule_class", F.coalesce("caught", F.lit(False)).alias("caught"))
