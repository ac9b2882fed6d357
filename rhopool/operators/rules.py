"""Weighted rules whose conditions are SQL expressions over the pair row."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rhopool.operators.clean import same_pair


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str
    weight: float
    description: str = ""
    enabled: bool = True

    def __post_init__(self):
        if not self.name.strip() or not self.condition.strip():
            raise ValueError("a rule needs a name and a condition")
        if not 0.0 <= self.weight <= 1.0:
            raise ValueError(f"weight of {self.name!r} is outside [0, 1]")


# The shipped rule sets.
AGENT_RULES = [
    Rule("Statistical Significance", "(p_ss < 0.1) and (p_soth < 0.01)", 0.25,
         "Strong statistical significance in both conditions"),
    Rule("Effect Size Strength", "(abs_dz_ss > 0.3) and (abs_dz_soth > 1.0)", 0.30,
         "Substantial effect sizes indicating biological relevance"),
    Rule("Z-Score Strength", "(abs(dz_ss_z) > 1.5) and (abs(dz_soth_z) > 3.0)", 0.20,
         "Strong standardized effect sizes"),
    Rule("FDR Correction", "(q_ss < 0.2) and (q_soth < 0.01)", 0.15, "False discovery rate controlled results"),
    Rule("Consistency", "(dz_ss_I2 < 50) or (dz_soth_I2 < 75)", 0.10,
         "Low heterogeneity indicating consistent effects"),
]
PROJECT_RULES = [
    Rule("statistical_significance", "(p_ss < 0.05) and (p_soth < 0.01)", 0.25,
         "Both conditions show statistical significance"),
    Rule("effect_size", "(abs_dz_ss > 0.3) and (abs_dz_soth > 1.0)", 0.30, "Large effect sizes in both conditions"),
    Rule("z_score_strength", "(abs(dz_ss_z) > 1.5) and (abs(dz_soth_z) > 3.0)", 0.20,
         "Strong z-scores across conditions"),
    Rule("fdr_correction", "(q_ss is not None and q_ss < 0.2) and (q_soth is not None and q_soth < 0.01)", 0.15,
         "Survives FDR correction"),
    Rule("consistency", "((dz_ss_I2 is not None and dz_ss_I2 < 50) or (dz_soth_I2 is not None and dz_soth_I2 < 75))",
         0.10, "Low heterogeneity across studies"),
]
CORRELATION_RULES = [
    Rule("differential_correlation_rule", "abs(control_weighted_r - disease_weighted_r) > 0.5", 0.30,
         "Strong correlation change between control and disease"),
    Rule("statistical_significance_rule", "(combined_p_value < 0.01) AND (n_significant_studies >= 3)", 0.25,
         "Statistically significant across multiple studies"),
    Rule("effect_size_rule", "combined_effect_size > 0.5", 0.20, "Large effect size magnitude"),
    Rule("consistency_rule", "mean_I_squared < 60", 0.15, "Low heterogeneity - consistent results across studies"),
    Rule("expression_asymmetry_rule", "max(abs(geneA_log2fc), abs(geneB_log2fc)) > 1.0", 0.10,
         "At least one gene shows substantial expression change"),
]
SAMPLE_RULES = [
    Rule("High Significance", "p_ss < 0.01 and p_soth < 0.001", 0.4, "Very high statistical significance"),
    Rule("Large Negative Effect", "dz_ss_mean < -0.5 and dz_soth_mean < -1.0", 0.3,
         "Large negative effect sizes (common in sepsis)"),
]
FUNCTIONS = {"abs": "abs", "min": "least", "max": "greatest", "log": "ln", "sqrt": "sqrt", "exp": "exp",
             "least": "least", "greatest": "greatest", "ln": "ln", "try_divide": "try_divide"}
WORDS = {"and", "or", "not", "is", "null", "none", "true", "false"}

_TOKEN = re.compile(r"'[^']*'|[A-Za-z_]\w*|\d+\.?\d*(?:[eE][+-]?\d+)?|.", re.S)


def problems(condition: str, columns: list[str] | None = None) -> list[str]:
    """Why a condition is not acceptable: foreign functions, statement characters, unknown columns."""
    found, tokens = [], [t for t in _TOKEN.findall(condition) if not t.isspace()]
    for i, t in enumerate(tokens):
        if t in ";`\\{}[]":
            found.append(f"character {t!r}")
        if re.match(r"[A-Za-z_]", t):
            called = i + 1 < len(tokens) and tokens[i + 1] == "("
            if t.lower() in WORDS:
                continue
            if called and t.lower() not in FUNCTIONS:
                found.append(f"function {t!r}")
            elif not called and columns is not None and t not in columns:
                found.append(f"column {t!r}")
    return found


def to_sql(condition: str, columns: list[str]) -> str:
    """Condition text as Spark SQL: function names mapped, None as NULL, absent columns as NULL."""
    known = {c.lower() for c in columns}
    raw, out = _TOKEN.findall(condition), []
    for i, t in enumerate(raw):
        rest = next((x for x in raw[i + 1:] if not x.isspace()), "")
        low = t.lower()
        if not re.match(r"[A-Za-z_]", t):
            out.append(t)
        elif low == "none":
            out.append("NULL")
        elif low in WORDS:
            out.append(t)
        elif rest == "(":
            out.append(FUNCTIONS.get(low, t))
        elif low in known:
            out.append(t)
        else:
            out.append("CAST(NULL AS DOUBLE)")
    return "".join(out)


def satisfied(rule: Rule, columns: list[str]) -> Column:
    """True where the condition holds; NULL, an absent column or a rejected condition is false."""
    if [p for p in problems(rule.condition) if not p.startswith("column")]:
        return F.lit(False)
    return F.coalesce(F.expr(f"({to_sql(rule.condition, columns)})").cast("boolean"), F.lit(False))


def enabled(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.enabled]


def rule_score(rules: list[Rule], columns: list[str], normalise: str = "weight") -> Column:
    """Sum of satisfied weights over the total weight (``weight``) or the number of enabled rules (``count``)."""
    active = enabled(rules)
    base = sum(r.weight for r in active) if normalise == "weight" else len(active)
    if not active or base <= 0:
        return F.lit(0.0)
    total = sum((F.when(satisfied(r, columns), F.lit(float(r.weight))).otherwise(F.lit(0.0)) for r in active),
                F.lit(0.0))
    return F.least(F.greatest(total / F.lit(float(base)), F.lit(0.0)), F.lit(1.0))


# The wording of explanations.
def explanations(rules: list[Rule], columns: list[str]) -> Column:
    """One text per enabled rule, satisfied or not."""
    return F.array(*[
        F.when(satisfied(r, columns), F.lit(f"Rule '{r.name}' satisfied (+{r.weight:.2f}): {r.description}"))
         .otherwise(F.lit(f"Rule '{r.name}' not satisfied (+0.00): {r.description}")) for r in enabled(rules)])


def apply_rules(df: DataFrame, rules: list[Rule], normalise: str = "weight", explain: bool = False) -> DataFrame:
    out = df.withColumn("rules_score", rule_score(rules, df.columns, normalise))
    return out.withColumn("rule_explanations", explanations(rules, df.columns)) if explain else out


def rank_by_rules(df: DataFrame, rules: list[Rule] = AGENT_RULES, normalise: str = "count") -> DataFrame:
    return apply_rules(df, rules, normalise).orderBy(F.desc("rules_score"), "pair_id")


def dry_run(df: DataFrame, rules: list[Rule], rows: int = 10, top: int = 5) -> DataFrame:
    """Scores of the best ``top`` of the first ``rows`` pairs, to try a rule set."""
    sample = df.orderBy("pair_id").limit(rows)
    return apply_rules(sample, rules).orderBy(F.desc("rules_score"), "pair_id").limit(top)


def control_percentile(ranked: DataFrame, control: tuple[str, str], threshold: float = 0.80) -> DataFrame:
    """Share of pairs not scoring above the control pair, and whether it reaches the threshold.

    Two mergeable aggregations; the control's score is a scalar subquery.
    """
    best = ranked.where(same_pair("GeneAName", "GeneBName", *control)).agg(F.max("rules_score").alias("s")).scalar()
    counts = ranked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rules_score") > best).alias("better"),
                        F.first(best).alias("control_score"))
    pct = F.when(F.col("control_score").isNotNull(), F.try_divide(F.col("n") - F.col("better"), F.col("n")))
    return counts.withColumn("percentile", pct).withColumn("validated", F.coalesce(pct >= threshold, F.lit(False)))


# --- rule set as metadata -----------------------------------------------------

def add_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    if any(r.name == rule.name for r in rules):
        raise ValueError(f"rule {rule.name!r} exists")
    return [*rules, rule]


def remove_rule(rules: list[Rule], name: str) -> list[Rule]:
    return [r for r in rules if r.name != name]


def update_rule(rules: list[Rule], name: str, **changes) -> list[Rule]:
    if all(r.name != name for r in rules):
        raise KeyError(name)
    return [replace(r, **changes) if r.name == name else r for r in rules]


def summarise_rules(rules: list[Rule]) -> dict:
    return {"total_rules": len(rules), "enabled_rules": len(enabled(rules)), "rules": [asdict(r) for r in rules]}


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.condition, float(r.weight), r.description, r.enabled) for r in rules],
        "name string, condition string, weight double, description string, enabled boolean")


def save_rules(spark: SparkSession, rules: list[Rule], path: str) -> None:
    rules_frame(spark, rules).coalesce(1).write.mode("overwrite").json(path)


def load_rules(spark: SparkSession, path: str, default: list[Rule] = AGENT_RULES) -> list[Rule]:
    """Valid rules of a JSON table; invalid ones are skipped; the defaults when nothing usable is there."""
    from pyspark.errors import AnalysisException
    try:
        lines = spark.read.text(path, wholetext=True).collect()
    except AnalysisException:
        return list(default)
    out: list[Rule] = []
    for line in lines:
        try:
            docs = json.loads(line.value)
        except json.JSONDecodeError:
            try:
                docs = [json.loads(x) for x in line.value.splitlines() if x.strip()]
            except json.JSONDecodeError:
                continue
        if isinstance(docs, dict):
            docs = docs.get("rules", [docs])
        for d in docs:
            try:
                out.append(Rule(d["name"], d["condition"], float(d["weight"]),
                                d.get("description", d.get("explanation", "")), bool(d.get("enabled", True))))
            except (KeyError, TypeError, ValueError):
                continue
    return out or list(default)
