"""Health scores with capped deductions per category and dimension.

Contributions are summed per (file, dimension, category) first, so a file with very many findings sends one partial sum per
task and category; only the finding-level impacts need the sums joined back, through a window over a category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: points taken off by severity
SEVERITY = {"low": 0.3, "medium": 0.7, "high": 1.2, "critical": 2.0}
SEVERITY_OTHER = 0.5
# fixed values: weight of a finding in the defect dimension; 1.0 for the others
WEIGHT = {
    "co_change_scatter": 1.8, "change_entropy": 1.51, "ownership_risk": 1.38, "nested_complexity": 1.34, "complex_conditional": 1.33, "large_method": 1.25, "complex_method": 1.21,
    "function_hotspot": 1.16, "god_class": 1.13, "prior_defect": 1.0, "untested_hotspot": 1.3, "churn_risk": 1.2, "code_age_volatility": 1.1, "developer_congestion": 0.5, "low_cohesion": 0.5,
    "brain_method": 0.5, "bumpy_road": 0.5, "primitive_obsession": 0.5, "dry_violation": 0.5, "knowledge_loss": 0.4, "error_handling": 0.5,
}
# fixed values: categories of the defect dimension; size_and_complexity for the others
CATEGORY = {
    "brain_method": "structural_complexity", "low_cohesion": "structural_complexity", "god_class": "structural_complexity", "nested_complexity": "structural_complexity",
    "bumpy_road": "structural_complexity", "complex_conditional": "structural_complexity", "complex_method": "size_and_complexity", "large_method": "size_and_complexity",
    "primitive_obsession": "size_and_complexity", "dry_violation": "duplication", "untested_hotspot": "test_coverage", "coverage_gap": "test_coverage",
    "coverage_gradient": "test_coverage_gradient", "developer_congestion": "organizational", "knowledge_loss": "organizational", "hidden_coupling": "organizational",
    "function_hotspot": "organizational", "code_age_volatility": "organizational", "ownership_risk": "organizational", "churn_risk": "organizational",
    "change_entropy": "organizational", "co_change_scatter": "organizational", "prior_defect": "organizational", "large_assertion_block": "test_quality",
    "duplicated_assertion_block": "test_quality", "error_handling": "error_handling",
}
CAP = {"organizational": 3.5, "structural_complexity": 2.5, "test_coverage": 2.0, "test_coverage_gradient": 2.0, "size_and_complexity": 1.5, "duplication": 1.0, "test_quality": 0.5, "error_handling": 0.5}
# fixed values: the maintainability and performance dimensions
MAINTAINABILITY = ("low_cohesion", "brain_method", "primitive_obsession", "dry_violation", "error_handling", "god_class", "large_method", "nested_complexity")
MAINTAINABILITY_CATEGORY = {
    "brain_method": "structural_complexity", "low_cohesion": "structural_complexity", "god_class": "structural_complexity", "nested_complexity": "structural_complexity",
    "large_method": "structural_complexity", "primitive_obsession": "size_and_complexity", "dry_violation": "duplication", "error_handling": "error_handling",
}
MAINTAINABILITY_CAP = {"structural_complexity": 4.0, "size_and_complexity": 2.0, "duplication": 2.0, "error_handling": 2.0}
PERFORMANCE_WEIGHT = {"io_in_loop": 1.0, "blocking_sync_in_async": 0.7, "string_concat_in_loop": 0.7}
MAINTAINABILITY_HOME = ("low_cohesion", "brain_method", "primitive_obsession", "dry_violation", "error_handling")


def lookup(key: Column, values: dict, default) -> Column:
    """A small fixed table as an expression inside code generation: no join."""
    m = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def deduction(severity: Column, given: Column | None = None) -> Column:
    d = lookup(F.lower(severity), SEVERITY, SEVERITY_OTHER)
    return d if given is None else F.coalesce(given, d)


def dimensions(biomarker: Column) -> Column:
    """The dimensions that a finding counts in, with weight, category and cap in each."""

    def entry(name: str, weight: Column, category: Column, caps: dict, cap: float) -> Column:
        return F.struct(F.lit(name).alias("dim"), weight.alias("weight"), category.alias("category"), lookup(category, caps, cap).alias("cap"))

    defect = entry("defect", lookup(biomarker, WEIGHT, 1.0), lookup(biomarker, CATEGORY, "size_and_complexity"), CAP, 1.0)
    maintain = entry("maintainability", F.lit(1.0), lookup(biomarker, MAINTAINABILITY_CATEGORY, "size_and_complexity"), MAINTAINABILITY_CAP, 1.0)
    perform = entry("performance", lookup(biomarker, PERFORMANCE_WEIGHT, 1.0), F.lit("performance"), {"performance": 1.0}, 1.0)
    return F.when(biomarker.isin(*PERFORMANCE_WEIGHT), F.array(perform)).when(biomarker.isin(*MAINTAINABILITY), F.array(defect, maintain)).otherwise(F.array(defect))


def home_dimension(biomarker: Column) -> Column:
    return F.when(biomarker.isin(*PERFORMANCE_WEIGHT), "performance").when(biomarker.isin(*MAINTAINABILITY_HOME), "maintainability").otherwise("defect")


def weighted(findings: DataFrame) -> DataFrame:
    """One row per finding and dimension: points = deduction x weight."""
    x = findings.withColumn("m", F.explode(dimensions(F.col("biomarker_type"))))
    return x.select(*findings.columns, "m.dim", "m.category", "m.cap", (deduction(F.col("severity"), F.col("deduction")) * F.col("m.weight")).alias("points"))


def category_sums(findings: DataFrame) -> DataFrame:
    """(file_path, dim, category, cap, points, counted): counted is capped."""
    s = weighted(findings).where(F.col("file_path").isNotNull()).groupBy("file_path", "dim", "category", "cap").agg(F.sum(F.col("points").cast("decimal(20,6)")).cast("double").alias("points"))
    return s.withColumn("counted", F.least("points", "cap"))


def file_scores(findings: DataFrame) -> DataFrame:
    """(file_path, defect, maintainability, performance): 10 minus the capped points, within 1 and 10.  A file without
    findings is not in the result; findings without a file are left out."""
    s = category_sums(findings)
    score = lambda dim: F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.lit(10.0) - F.coalesce(F.sum(F.when(F.col("dim") == dim, F.col("counted"))), F.lit(0.0))))
    return s.groupBy("file_path").agg(*(score(dim).alias(dim) for dim in ("defect", "maintainability", "performance")))


def finding_impacts(findings: DataFrame) -> DataFrame:
    """Each finding's share of the capped points of its category, in its home dimension.  The sums are pre-aggregated and
    joined back, so no window gathers all findings of a hot file in one task."""
    w = weighted(findings).where(F.col("dim") == home_dimension(F.col("biomarker_type")))
    sums = category_sums(findings).select("file_path", "dim", "category", F.col("points").alias("total"), "counted")
    j = w.join(sums, ["file_path", "dim", "category"])
    return j.select("finding_id", "file_path", "dim", F.when(F.col("total") > 0, F.col("points") * F.col("counted") / F.col("total")).otherwise(0.0).alias("impact"))
