"""Views over the driver tables shared by the query catalogue and tests.

The tables carry no nulls, so missing values are derived by the same
expression on both sides (Spark here, SQL in ``oracles``). Row order is
the table's unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.columns import ROW_ID
from tabforge.sources.scan import load_table


def _null_if(cond, value):
    return F.when(cond, F.lit(None)).otherwise(value)


def orders_n(spark: SparkSession, sf: str) -> DataFrame:
    """orders with nulls in o_custkey (key%13), price (key%7), priority (key%11)."""
    o = load_table(spark, sf, "orders", order_by="o_orderkey")
    k = F.col("o_orderkey")
    return o.select(
        ROW_ID,
        "o_orderkey",
        _null_if(k % 13 == 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        _null_if(k % 7 == 0, F.col("o_totalprice")).alias("price"),
        "o_orderdate",
        _null_if(k % 11 == 0, F.col("o_orderpriority")).alias("priority"),
    )


ORDERS_N_SQL = """orders_n AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
         o_orderdate,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority
  FROM orders)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "events", order_by="event_id")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "lineitem")


def part(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "part", order_by="p_partkey")


def customer(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "customer", order_by="c_custkey")
