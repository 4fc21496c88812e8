"""What a plan really does: pushed filters, columns read, rows out of the scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def formatted(df: DataFrame) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def pushed_filters(df: DataFrame) -> str:
    found = re.search(r"PushedFilters: (\[.*\])", formatted(df))
    return found[1] if found else "[]"


def read_schema(df: DataFrame) -> str:
    found = re.search(r"ReadSchema: (\S+)", formatted(df))
    return found[1] if found else ""


def scan_output_rows(df: DataFrame) -> int:
    """Runs the plan and returns the rows that left its scans: what pruning by statistics has not kept out."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()

    def walk(node: object) -> int:
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        rows = node.metrics().get("numOutputRows")
        own = rows.get().value() if node.nodeName().startswith("Scan parquet") and rows.isDefined() else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(plan)


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", formatted(df), re.M))
