"""What a physical plan contains, read from its explain text."""

from __future__ import annotations

import contextlib
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlanShape:
    exchanges: int
    broadcasts: int
    sort_merge_joins: int
    cartesian_products: int
    nested_loop_joins: int
    python_nodes: int
    row_expansions: int
    partition_filters: list[str]
    pushed_filters: list[str]
    read_schemas: list[str]


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def plan_shape(df: DataFrame) -> PlanShape:
    text = explain_text(df)
    tree, _, details = text.partition("\n\n\n")

    def nodes(name: str) -> int:
        return len(re.findall(rf"(?<![A-Za-z]){name} \(\d+\)", tree))

    def lines(label: str) -> list[str]:
        return re.findall(rf"^{label}: (.*)$", text, flags=re.M)

    return PlanShape(
        exchanges=nodes("Exchange"),
        broadcasts=nodes("BroadcastExchange"),
        sort_merge_joins=len(re.findall(r"SortMergeJoin", tree)),
        cartesian_products=len(re.findall(r"CartesianProduct", tree)),
        nested_loop_joins=len(re.findall(r"BroadcastNestedLoopJoin", tree)),
        python_nodes=len(re.findall(r"Python|Pandas|ArrowEval", tree)),
        row_expansions=nodes("Expand"),
        partition_filters=lines("PartitionFilters"),
        pushed_filters=lines("PushedFilters"),
        read_schemas=lines("ReadSchema"),
    )
