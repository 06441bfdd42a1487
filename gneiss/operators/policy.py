"""Policies and compliance over findings. Policies, controls and maps are small tables written by people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import severity_rank
from gneiss.operators.scoring import trust_score
from gneiss.schemas import SEVERITIES


def _rank(column: str):
    return severity_rank(column)


def policy_matches(found: DataFrame, rules: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Findings that match a policy rule: policy, rule_id, action, and the finding's id, rule and severity.

    Conditions: severity_threshold, category_match, rule_match (equal or a prefix), count_threshold (more than max_count,
    0 where unset: all findings match), trust_score (below min_score, 7 where unset: all findings match). The last two
    need one number for all findings; an empty table matches nothing."""
    r = rules.select("policy", F.col("id").alias("rule_id"), "action", "cond_type", "severity", "categories", "rules", "max_count", "min_score").alias("r")
    f = found.select(F.col("id").alias("finding_id"), F.col("rule").alias("finding_rule"), F.col("severity").alias("finding_severity"), F.col("category").alias("finding_category"))
    out = ("policy", "rule_id", "action", "finding_id", "finding_rule", "finding_severity")
    threshold = f.join(F.broadcast(r.where("cond_type = 'severity_threshold'")), _rank("finding_severity") <= _rank("r.severity"))
    by_category = f.join(F.broadcast(r.where("cond_type = 'category_match'").withColumn("finding_category", F.explode(F.array_distinct("categories")))), "finding_category")
    named = r.where("cond_type = 'rule_match'").withColumn("_rule", F.explode("rules"))
    by_rule = f.join(F.broadcast(named), F.startswith(F.col("finding_rule"), F.col("_rule"))).dropDuplicates(list(out))
    one = found.agg(F.count("*").alias("_n")).crossJoin(trust_score(found, chains))  # one row
    counted = r.where("cond_type in ('count_threshold', 'trust_score')").crossJoin(one).where("(cond_type = 'count_threshold' and _n > coalesce(max_count, 0)) or (cond_type = 'trust_score' and trust_score < coalesce(min_score, 7.0))")
    by_count = f.join(F.broadcast(counted), F.lit(True))
    return reduce(DataFrame.unionByName, [x.select(*out) for x in (threshold, by_category, by_rule, by_count)])


def policy_verdict(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """(policy, passed, blocked, warned): passed if no block rule has a match."""
    n = matches.groupBy("policy", "rule_id", "action").agg(F.count("*").alias("n"))
    held = rules.select("policy", F.col("id").alias("rule_id"), "action").join(n, ["policy", "rule_id", "action"], "left")
    some = F.coalesce("n", F.lit(0)) > 0
    return held.groupBy("policy").agg(F.count_if(some & (F.col("action") == "block")).alias("blocked"), F.count_if(some & (F.col("action") == "warn")).alias("warned")).withColumn("passed", F.col("blocked") == 0)


def compliance_controls(found: DataFrame, controls: DataFrame) -> DataFrame:
    """Each control with its findings and status: pass without any, fail with a critical or high one, else partial."""
    sums = found.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe"))
    wide = controls.withColumn("category", F.explode_outer(F.array_distinct("categories")))
    out = wide.join(sums, "category", "left").groupBy("framework", "control_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.coalesce(F.sum("severe"), F.lit(0)).alias("severe"))
    return out.withColumn("status", F.when(F.col("findings") == 0, "pass").when(F.col("severe") > 0, "fail").otherwise("partial"))


def compliance_rate(controls: DataFrame) -> DataFrame:
    """Pass rate of each framework in whole percent, over compliance_controls."""
    return controls.groupBy("framework").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passed")).withColumn("rate", F.round(F.col("passed") * 100 / F.col("total")).cast("int"))


def compliance_map(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Findings by (framework, control) of a map by category, another table than the controls of the report."""
    return found.join(F.broadcast(mapping), "category").groupBy("framework", "control").agg(F.count("*").alias("n"))


def first_of_failed(found: DataFrame, controls: DataFrame, status: DataFrame, n: int = 5) -> DataFrame:
    """The first n findings of each failed control."""
    from pyspark.sql import Window

    failed = controls.join(status.where("status = 'fail'").select("framework", "control_id"), ["framework", "control_id"], "left_semi").withColumn("category", F.explode(F.array_distinct("categories")))
    place = F.row_number().over(Window.partitionBy("framework", "control_id").orderBy("ordinal"))
    return found.join(F.broadcast(failed.select("framework", "control_id", "category")), "category").withColumn("place", place).where(F.col("place") <= n)


#: Severities a policy can name.
KNOWN = SEVERITIES
