"""Detectors as a registry of column expressions: each is a filter and a projection, all run in one pass over the files.

Tabular detectors read a flat file context with its history; detectors that need a syntax tree read the metrics of
``sources.python_source``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    name: str
    fires: Callable[[], Column]
    severity: Callable[[], Column]


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _sev(level: str) -> Callable[[], Column]:
    return lambda: F.lit(level)


#: Per function: ccn, n_vars, n_ifs, loc, depth, n_args.
FUNCTION_DETECTORS = [
    Detector("brain_method", lambda: (_c("ccn") >= 15) & (_c("n_vars") >= 15) & (_c("n_ifs") >= 5), _sev("high")),
    Detector("complex_method", lambda: _c("ccn") > 10, lambda: F.when(F.col("ccn") > 20, "high").otherwise("medium")),
    Detector("large_method", lambda: _c("loc") > 60, lambda: F.when(F.col("loc") > 100, "high").otherwise("medium")),
    Detector("nested_complexity", lambda: _c("depth") > 4, lambda: F.when(F.col("depth") > 6, "high").otherwise("medium")),
    Detector("primitive_obsession", lambda: _c("n_args") > 5, _sev("low")),
]

#: Per file: has_test, dependents, nloc, pagerank, duplication, and the history of ``operators.history.git_meta``.
FILE_DETECTORS = [
    Detector("untested_hotspot", lambda: ~F.coalesce(F.col("has_test"), F.lit(False)) & (_c("dependents") > 5), _sev("high")),
    Detector("coverage_gap", lambda: ~F.coalesce(F.col("has_test"), F.lit(False)) & (_c("nloc") > 100), _sev("medium")),
    Detector("function_hotspot", lambda: (_c("pagerank") > 0.01) & (_c("dependents") > 10), _sev("medium")),
    Detector("dry_violation", lambda: _c("duplication") > 0.2, _sev("medium")),
    Detector("large_class", lambda: _c("nloc") > 400, _sev("high")),
]

HISTORY_DETECTORS = [
    Detector("ownership_risk", lambda: (_c("n_owners") == 1) & (_c("nloc") > 200), _sev("medium")),
    Detector("developer_congestion", lambda: (_c("n_authors") >= 3) & (_c("recent_changes") > 10), _sev("low")),
    Detector("knowledge_loss", lambda: _c("former_owners") > 2, _sev("low")),
    Detector("churn_risk", lambda: _c("recent_changes") > 15, _sev("medium")),
    Detector("code_age_volatility", lambda: (_c("age_days") > 365) & (_c("recent_changes") > 5), _sev("low")),
    Detector("change_entropy", lambda: _c("change_entropy") > 0.7, _sev("medium")),
    Detector("co_change_scatter", lambda: _c("co_change_partners") > 5, _sev("low")),
    Detector("prior_defect", lambda: _c("bug_fixes") > 3, lambda: F.when(F.col("bug_fixes") > 5, "medium").otherwise("low")),
    Detector("bumpy_road", lambda: (_c("recent_changes") > 5) & (_c("max_ccn") > 8), _sev("medium")),
]


def detect(df: DataFrame, detectors: list[Detector], keep: list[str]) -> DataFrame:
    """``keep`` columns, biomarker_type and severity: one row per detector that fires.  Nulls count as 0 or false."""
    hits = F.array_compact(F.array(*(F.when(x.fires(), F.struct(F.lit(x.name).alias("biomarker_type"), x.severity().alias("severity"))) for x in detectors)))
    return df.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.biomarker_type", "h.severity")
