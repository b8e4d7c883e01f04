"""Report filters as plain data, turned into Column predicates that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.text import model_family


@dataclass(frozen=True)
class ReportFilters:
    time_range: str = "month"
    department: str | None = None
    model: str | None = None
    provider: str | None = None
    category: str | None = None
    severity: str | None = None
    status: str | None = None
    start: datetime | str | None = None
    end: datetime | str | None = None
    dimension: str = "department"
    metric: str = "cost"
    limit: int = 50
    offset: int = 0


def filter_usage(usage: DataFrame, f: ReportFilters = ReportFilters()) -> DataFrame:
    """Department and model exactly, provider by family of model or tool, time on start and end."""
    tests: list[Column] = []
    if f.department:
        tests.append(F.col("department_id") == f.department)
    if f.model:
        tests.append(F.col("model_name") == f.model)
    if f.provider:
        wanted = f.provider.lower()
        tests.append((model_family(F.col("model_name")) == wanted) | (model_family(F.col("tool_name")) == wanted))
    if f.start is not None:
        tests.append(F.col("usage_start") >= F.lit(f.start))
    if f.end is not None:
        tests.append(F.col("usage_end") <= F.lit(f.end))
    return _all(usage, tests)


def filter_findings(findings: DataFrame, f: ReportFilters = ReportFilters()) -> DataFrame:
    """All given restrictions at once; a category may name the type or the category."""
    tests: list[Column] = []
    for column, value in (("department", f.department), ("severity", f.severity), ("status", f.status)):
        if value:
            tests.append(F.col(column) == value)
    if f.model:
        tests.append(F.col("model") == f.model)
    if f.provider:
        tests.append(F.col("provider") == f.provider.lower())
    if f.category:
        tests.append((F.col("type") == f.category) | (F.col("category") == f.category))
    if f.start is not None:
        tests.append(F.col("timestamp") >= F.lit(f.start))
    if f.end is not None:
        tests.append(F.col("timestamp") <= F.lit(f.end))
    return _all(findings, tests)


def filter_columns(frame: DataFrame, **equal) -> DataFrame:
    """Equality restrictions on the columns that were given a value."""
    return _all(frame, [F.col(c) == v for c, v in equal.items() if v is not None])


def _all(frame: DataFrame, tests: list[Column]) -> DataFrame:
    for test in tests:
        frame = frame.filter(test)
    return frame
