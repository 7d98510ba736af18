"""Compliance profiles: lists of rules over one row a model; a profile's violations are one pass, whatever its length.

A governance row has model_hash, tier, owner, validator, description, intended_purpose, boundaries, training_data,
monitoring_frequency, monitoring_status (strings), next_validation_due, risk_rating (null without one), developers,
populations, harms, restrictions, limitations, stakeholders (arrays of strings), documents (doc_type, title), evidence
(evidence_type) and tree (depth, name, node_type; the root has depth 0).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    rule_id: str
    violated: Callable[[], Column]
    severity: str = "error"
    #: The severity is error for models of the high tier.
    strict: bool = False


def blank(column: str) -> Callable[[], Column]:
    return lambda: F.coalesce(column, F.lit("")) == ""


def empty(column: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.size(column), F.lit(0)) <= 0


def high() -> Column:
    return F.coalesce(F.col("tier") == "high", F.lit(False))


def any_of(column: str, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(column, test), F.lit(False))


def says(value: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit(w))
    return found


# Rule names and severities, sections, node, evidence and document types, and words looked for.
SECTIONS = ("Inputs", "Processing", "Outputs")
METRICS = ("metric", "metrics", "performance")
PLANS = ("incident_response", "runbook", "escalation_plan")


def sections_missing() -> Column:
    top = F.transform(F.filter("tree", lambda n: n["depth"] == 1), lambda n: n["name"])
    return ~F.coalesce(F.forall(F.array(*[F.lit(x) for x in SECTIONS]), lambda x: F.array_contains(top, x)), F.lit(False))


def has_metrics() -> Column:
    return any_of("tree", lambda n: n["node_type"].isin(*METRICS))


def no_fairness() -> Column:
    evidence = any_of("evidence", lambda e: says(e["evidence_type"], "bias", "fairness"))
    return ~evidence & ~any_of("documents", lambda d: says(d["title"], "bias", "fairness") | says(d["doc_type"], "fair_lending"))


PROFILES: dict[str, list[Rule]] = {
    "sr_11_7": [
        Rule("has_developers", empty("developers")),
        Rule("has_validator", blank("validator")),
        Rule("validator_independence", lambda: (F.col("validator") != "") & any_of("developers", lambda d: d == F.col("validator"))),
        Rule("has_ipo_structure", sections_missing),
        Rule("has_governance_document", empty("documents")),
        Rule("has_validation_schedule", lambda: F.col("next_validation_due").isNull(), "warning", True),
    ],
    "eu_ai_act": [
        Rule("eu_intended_purpose", lambda: F.length(F.coalesce("intended_purpose", F.lit(""))) < 20),
        Rule("eu_risk_assessment", lambda: F.col("risk_rating").isNull()),
        Rule("eu_affected_populations", empty("populations"), "warning", True),
        Rule("eu_data_governance", blank("training_data")),
        Rule("eu_transparency_docs", empty("documents")),
        Rule("eu_transparency_description", blank("description"), "warning"),
        Rule("eu_human_oversight", empty("stakeholders"), "warning"),
        Rule("eu_accuracy_metrics", lambda: ~has_metrics() & ~any_of("evidence", lambda e: e["evidence_type"] == "performance_report"), "warning"),
        Rule("eu_limitations", empty("limitations"), "warning"),
        Rule("eu_operating_boundaries", blank("boundaries"), "warning"),
    ],
    "nist_ai_rmf": [
        Rule("nist_govern_accountability", blank("owner")),
        Rule("nist_govern_developers", empty("developers")),
        Rule("nist_govern_documentation", empty("documents")),
        Rule("nist_map_intended_use", blank("intended_purpose")),
        Rule("nist_map_restrictions", empty("restrictions"), "warning"),
        Rule("nist_map_risk_id", lambda: F.col("risk_rating").isNull() & high()),
        Rule("nist_map_harms", empty("harms"), "warning"),
        Rule("nist_map_stakeholders", empty("populations"), "warning"),
        Rule("nist_measure_performance", lambda: empty("evidence")() & ~has_metrics()),
        Rule("nist_measure_bias", lambda: high() & no_fairness(), "warning"),
        Rule("nist_manage_monitoring", lambda: blank("monitoring_frequency")() & blank("monitoring_status")(), "warning"),
        Rule("nist_manage_validation_schedule", lambda: F.col("next_validation_due").isNull(), "warning"),
        Rule("nist_manage_incident_response", lambda: high() & ~any_of("documents", lambda d: d["doc_type"].isin(*PLANS)), "warning"),
    ],
}


def register_profile(name: str, rules: list[Rule]) -> None:
    """Add a profile, or replace one."""
    PROFILES[name] = rules


def violations(governed: DataFrame, profile: str) -> DataFrame:
    """model_hash, rule_id, severity for each rule of the profile that a row violates; ValueError for an unknown profile."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}; there are {', '.join(sorted(PROFILES))}")

    def one(r: Rule) -> Column:
        severity = F.when(high(), "error").otherwise(r.severity) if r.strict else F.lit(r.severity)
        return F.when(r.violated(), F.struct(F.lit(r.rule_id).alias("rule_id"), severity.alias("severity")))

    return governed.select("model_hash", F.explode(F.array_compact(F.array(*[one(r) for r in PROFILES[profile]]))).alias("v")).select("model_hash", "v.*")


def verdicts(governed: DataFrame, profile: str) -> DataFrame:
    """model_hash, errors, warnings, passed: passed means no errors. One row a model, without a join."""
    rules = PROFILES[profile]
    error = [F.coalesce(r.violated(), F.lit(False)) & (high() if r.strict and r.severity != "error" else F.lit(r.severity == "error")) for r in rules]
    warning = [F.coalesce(r.violated(), F.lit(False)) & (~high() if r.strict else F.lit(True)) & F.lit(r.severity == "warning") for r in rules]
    total = lambda tests: sum((t.cast("long") for t in tests), F.lit(0).cast("long"))
    return governed.select("model_hash", total(error).alias("errors"), total(warning).alias("warnings")).withColumn("passed", F.col("errors") == 0)


#: The test projection: fields of a governance row from models as texts, lists comma-joined. The same for both engines.
FIELDS = """SELECT model_hash, tier, CASE WHEN i % 13 > 0 THEN owner END AS owner, CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN 'ann' ELSE 'ann,bob' END AS developers,
  CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN 'ann' WHEN 2 THEN 'bob' ELSE 'val' END AS validator,
  CASE i % 6 WHEN 0 THEN 'Inputs,Processing,Outputs' WHEN 1 THEN 'Inputs,Processing,Outputs,Notes' WHEN 2 THEN 'Inputs,Outputs,Notes' WHEN 3 THEN 'Outputs,Inputs,Processing' WHEN 4 THEN 'inputs,Processing,Outputs' ELSE '' END AS sections,
  CASE i % 7 WHEN 0 THEN 'metric' WHEN 1 THEN 'metrics' WHEN 2 THEN 'performance' ELSE 'dataset' END AS leaf,
  CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN 'system_design:Design' WHEN 2 THEN 'runbook:On call' WHEN 3 THEN 'FAIR_LENDING_memo:Memo,system_design:Design' ELSE 'memo:Notes on Bias,escalation_plan:Who' END AS documents,
  CASE i % 6 WHEN 0 THEN '' WHEN 1 THEN 'performance_report' WHEN 2 THEN 'Bias_test' WHEN 3 THEN 'fairness_audit,survey' ELSE 'survey' END AS evidence,
  CASE WHEN i % 3 > 0 THEN created_at END AS next_validation_due, CASE i % 6 WHEN 0 THEN '' WHEN 1 THEN 'nineteen characters' WHEN 2 THEN 'twenty characters ok' ELSE purpose END AS intended_purpose,
  CASE WHEN i % 7 > 0 THEN 'rated' END AS risk_rating, CASE WHEN i % 2 > 0 THEN 'consumers' ELSE '' END AS populations, CASE WHEN i % 8 > 2 THEN 'internal' WHEN i % 8 > 1 THEN '' END AS training_data,
  CASE WHEN i % 9 > 3 THEN name END AS description, CASE WHEN i % 4 > 0 THEN 'owner,reviewer' ELSE '' END AS stakeholders, CASE WHEN i % 5 > 1 THEN 'some' ELSE '' END AS limitations,
  CASE WHEN i % 6 > 2 THEN 'some' END AS boundaries, CASE WHEN i % 7 > 3 THEN 'none' ELSE '' END AS restrictions, CASE WHEN i % 8 > 4 THEN 'some' ELSE '' END AS harms,
  CASE WHEN i % 3 > 1 THEN 'weekly' END AS monitoring_frequency, CASE WHEN i % 4 > 2 THEN 'on' WHEN i % 4 > 1 THEN '' END AS monitoring_status
  FROM (SELECT *, CAST(substr(model_hash, 2) AS BIGINT) AS i FROM m) AS numbered"""


def governed(m: DataFrame) -> DataFrame:
    """Governance rows from the test projection."""
    rows = m.sparkSession.sql(FIELDS.replace("FROM m)", "FROM {m})"), m=m)
    items = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    nodes = F.transform(items("sections"), lambda x: F.struct(F.lit(1).alias("depth"), x.alias("name"), F.lit("section").alias("node_type")))
    leaf = F.array(F.struct(F.lit(0).alias("depth"), F.lit("root").alias("name"), F.lit("root").alias("node_type")), F.struct(F.lit(2).alias("depth"), F.lit("Processing").alias("name"), F.col("leaf").alias("node_type")))
    return rows.withColumns({
        **{c: items(c) for c in ("developers", "populations", "stakeholders", "limitations", "restrictions", "harms")},
        "documents": F.transform(items("documents"), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("doc_type"), F.split_part(x, F.lit(":"), F.lit(2)).alias("title"))),
        "evidence": F.transform(items("evidence"), lambda x: F.struct(x.alias("evidence_type"))), "tree": F.concat(leaf, nodes),
    })


# Levels and bands.
LEVELS = {"low": 1, "medium": 2, "high": 3}


def banded(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def rating(df: DataFrame, exposure: Column, reliance: Column, complexity: Column, uncertainty: Column) -> DataFrame:
    """df with score, impact, likelihood and overall: four factors of low, medium or high, whatever their case."""

    def level(c: Column) -> Column:
        out = F.lit(None).cast("long")
        for name, value in LEVELS.items():
            out = F.when(F.lower(c) == name, F.lit(value).cast("long")).otherwise(out)
        return out

    impact, likelihood = level(exposure) + level(reliance), level(complexity) + level(uncertainty)
    return df.withColumns({"score": impact + likelihood, "impact": banded(impact, 5, 3), "likelihood": banded(likelihood, 5, 3), "overall": banded(impact + likelihood, 10, 6)})
