"""Shape of the physical plans and of the registry."""

import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from scoreloom.catalog import standin as st
from scoreloom.catalog.blocks import native_wide
from scoreloom.operators.ordered import newest_first, top_rows
from scoreloom.plans.bureau import bureau_features
from scoreloom.plans.installments import installment_features
from scoreloom.plans.wide import join_blocks, write_block
from scoreloom.sources.tables import read_csv_table, read_table, write_csv_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_on_the_client_and_no_python(spark, sf, tmp_path):
    st.Native(spark, sf).installments().write.parquet(str(tmp_path / "ip"))
    out = installment_features(spark.read.parquet(str(tmp_path / "ip")), st.INSTALLMENT_TIES, hot_rows=10**9)
    plan = plan_of(out)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Python" not in plan and "Pandas" not in plan


def test_percentiles_of_all_columns_in_one_aggregate(spark, sf, tmp_path):
    """All of the whole history: the block itself, its moments and its percentiles, one scan and one exchange each."""
    st.Native(spark, sf).installments().write.parquet(str(tmp_path / "ip"))
    out = installment_features(spark.read.parquet(str(tmp_path / "ip")), st.INSTALLMENT_TIES, all_history=True, hot_rows=10**9)
    plan = plan_of(out)
    assert plan.count("FileScan parquet") == 3 and len(re.findall(r"Exchange hashpartitioning", plan)) == 3


def test_stored_blocks_join_without_an_exchange(spark, sf):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(native_wide(spark, sf, store="plan_test", buckets=4))
        assert plan.count("SortMergeJoin") == 5 and "Exchange" not in plan
        changed = write_block(spark.table("plan_test_bureau").select("SK_ID_CURR", "B_DAYS_CREDIT_count"), "plan_test_bureau_2", 4)
        again = join_blocks(spark.table("plan_test_application"), [changed, spark.table("plan_test_pos")])
        assert "Exchange" not in plan_of(again)
        assert again.count() == spark.table("plan_test_application").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_distinct_counts_of_the_bureau_block_copy_no_rows(spark, sf):
    bureau = st.Native(spark, sf).bureau()
    plain = bureau_features(bureau, hot_rows=10**9)
    assert "Expand" not in plan_of(plain)
    hot = bureau_features(bureau, hot_rows=5)
    columns = ["SK_ID_CURR", "B_CREDIT_TYPE_nunique", "B_CREDIT_DAY_OVERDUE_NUNIQUE"]
    assert plain.select(columns).exceptAll(hot.select(columns)).isEmpty() and plain.count() == hot.count()


def test_top_rows_limit_before_the_exchange(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = plan_of(top_rows(orders, ["o_custkey"], newest_first("o_orderdate", "o_orderkey"), 5))
    assert plan.count("WindowGroupLimit") == 2


def test_filter_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(entry.queries()["equality_filter"](spark, sf))
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderpriority" not in plan


def test_debug_rows_and_fallback_folder(spark, sf, tmp_path):
    assert read_table(spark, "orders", [str(tmp_path), sf], debug=True, num_rows=7).count() == 7
    with pytest.raises(FileNotFoundError):
        read_table(spark, "absent", sf)
    write_csv_table(spark.range(5), str(tmp_path / "csv"))
    assert read_csv_table(spark, str(tmp_path / "csv"), "id bigint", debug=True, num_rows=3).count() == 3


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.parametrize(
    "name",
    [
        "bureau_features", "credit_card_features", "previous_application_features", "pos_cash_features",
        "installment_features_all_history", "weight_of_evidence", "roc_auc", "stratified_folds", "label_propagation", "quantile_bins", "column_profile",
        "logistic_regression_of_one_column", "sgd_logistic_regression_of_one_column", "sigmoid_of_margins", "decision_tree_on_all_columns",
        "ada_boost_three_rounds", "boosted_trees_three_rounds", "importance_sink_of_correlations", "run_parameter_sink",
    ],
)
def test_queries_agree_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    keys = [c for c in got if got[c].dtype.kind in "iO"]
    got, want = (d.sort_values(keys or list(d)).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in got:
        if got[c].dtype.kind == "f":
            np.testing.assert_array_equal(got[c].to_numpy(float), want[c].to_numpy(float), err_msg=c)
        else:
            assert got[c].tolist() == want[c].tolist(), c
