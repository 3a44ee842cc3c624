"""Queries of the core library with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregate import exact, summary_by
from tessera.session import table


def summary_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity and price by return flag and line status."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return summary_by(lines, ["l_returnflag", "l_linestatus"], {"quantity": exact("l_quantity"), "price": exact("l_extendedprice")})


QUERIES = {"summary_by_status": summary_by_status}

ORACLE_SQL = {
    "summary_by_status": """
        SELECT l_returnflag, l_linestatus, count(*) AS n_rows,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_quantity,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(l_quantity) AS mean_quantity,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / count(l_extendedprice) AS mean_price
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
    """
}
