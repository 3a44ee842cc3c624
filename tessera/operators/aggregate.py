"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact(column: str | Column, scale: int = 4) -> Column:
    """A double as a decimal, so that sums do not depend on the order of rows."""
    return (F.col(column) if isinstance(column, str) else column).cast(f"decimal(18,{scale})")


def summary_by(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Row count, sum and mean of each measure by group; one shuffle of pre-aggregated rows.

    Null keys form a group; null measures are left out of sums and means; an
    empty input gives no groups.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for name, column in measures.items():
        aggs += [F.sum(column).cast("double").alias(f"sum_{name}"), (F.sum(column).cast("double") / F.count(column)).alias(f"mean_{name}")]
    return df.groupBy(*by).agg(*aggs)
