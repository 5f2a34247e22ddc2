"""The flagship mapping: orders in force, their customer, totals by customer and day, a rule, and the accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.errors import ledger, split_valid
from ..operators.joins import traverse_n1


def order_summary(orders: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Data, error rows and the ledger of rows: aggregated, filtered."""
    live = orders.where("o_orderstatus <> 'P'")
    joined = traverse_n1(live, customer, live["o_custkey"] == customer["c_custkey"], "c_custkey")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    grouped = joined.groupBy("c_custkey", "c_mktsegment", F.to_date("o_orderdate").alias("order_date")).agg(F.count(F.lit(1)).alias("n_orders"), total.cast("double").alias("total"))
    data, errors = split_valid(grouped, F.col("total") > 0, "c_custkey", path="order_summary", expected="total > 0")
    accounts = ledger(orders, {"processed": live, "filtered": orders.where("not coalesce(o_orderstatus <> 'P', false)")})
    return data, errors, accounts
