"""Sources and sinks over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.profile import first_rows_of
from ..session import checkpoint_folder
from ..sources import tables as src
from .registry import query
from .standin import table


def scratch(spark, name: str) -> str:
    """A fresh path in the shared folder for a round trip."""
    return f"{checkpoint_folder(spark)}/scoreloom-{name}-{uuid.uuid4().hex}"


@query(
    "csv_round_trip",
    "c_custkey,c_nationkey:int c_acctbal:num c_name,c_mktsegment:str",
    "SELECT c_custkey, c_nationkey, c_acctbal, c_name, c_mktsegment FROM customer",
)
def _csv(spark, sf):
    df, path = table(spark, sf, "customer"), scratch(spark, "csv")
    src.write_csv_table(df, path)
    return src.read_csv_table(spark, path, df.schema)


@query(
    "parquet_table_source",
    "s_suppkey,s_nationkey:int s_acctbal:num s_name:str",
    "SELECT s_suppkey, s_nationkey, s_acctbal, s_name FROM supplier",
)
def _parquet(spark, sf):
    return src.read_table(spark, "supplier", [f"{sf}/absent", sf])


@query(
    "categories_as_strings",
    "c_custkey:int c_nationkey,c_mktsegment:str",
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer",
)
def _strings(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return src.categories_as_strings(df, ["c_nationkey", "c_mktsegment"])


@query(
    "first_rows_in_order",
    "o_orderkey,o_custkey:int o_totalprice:num",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200",
)
def _head(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return first_rows_of(orders, [F.desc("o_totalprice"), "o_orderkey"], src.DEBUG_ROWS)


@query("submission_round_trip", "SK_ID_CURR:int TARGET:num",
       "SELECT doc_id AS SK_ID_CURR, CAST(n_chars AS DOUBLE) / 20000 AS TARGET FROM documents")
def _submission(spark, sf):
    scores = table(spark, sf, "documents").selectExpr("doc_id AS SK_ID_CURR", "n_chars / 20000 AS TARGET")
    path = scratch(spark, "submission")
    src.write_csv_table(scores, path)
    return src.read_csv_table(spark, path, "SK_ID_CURR bigint, TARGET double")
