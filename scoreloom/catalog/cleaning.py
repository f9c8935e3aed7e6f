"""Cleaning, flags, arithmetic and row statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls, rowstats
from ..functions.naming import drop_existing, feature_names, matching, tidy_columns, with_prefix
from ..operators import clean
from ..operators.joins import bind_by_id, left_join_blocks, stack
from . import standin as st
from .registry import query
from .standin import table

ORDER_ID = "o_orderkey"


@query("column_selection", "o_orderkey,o_custkey:int o_totalprice:num",
       "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _select(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("sentinel_to_null", "l_orderkey,l_linenumber:int l_returnflag:str l_quantity:num",
       "SELECT l_orderkey, nullif(l_linenumber, 7) AS l_linenumber, nullif(l_returnflag, 'A') AS l_returnflag, "
       "CASE WHEN l_quantity IN (1, 50) THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem")  # fmt: skip
def _sentinel(spark, sf):
    rules = {"l_linenumber": (7,), "l_returnflag": ("A",), "l_quantity": (1, 50)}
    df = table(spark, sf, "lineitem").select("l_orderkey", *rules)
    return df.withColumns({c: nulls.missing_if(F.col(c), *v) for c, v in rules.items()})


@query("out_of_range_to_null", "c_custkey:int c_acctbal:num",
       "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def _range(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", nulls.keep_from(F.col("c_acctbal"), 0).alias("c_acctbal"))


@query("infinity_to_null", "event_id:int value:num odd:num",
       "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value, "
       "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 2 END AS odd FROM events")  # fmt: skip
def _finite(spark, sf):
    broken = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_id % 10 WHEN 0 THEN double('inf') ELSE value END AS value",
        "CASE event_id % 6 WHEN 0 THEN double('nan') WHEN 3 THEN double('-inf') ELSE value / 2 END AS odd",
    )
    return nulls.finite_frame(broken)


@query("constant_fill", "SK_ID_BUREAU:int AMT_CREDIT_SUM_DEBT:num AMT_CREDIT_MAX_OVERDUE:num",
       "SELECT SK_ID_BUREAU, coalesce(AMT_CREDIT_SUM_DEBT, -1) AS AMT_CREDIT_SUM_DEBT, AMT_CREDIT_MAX_OVERDUE "
       f"FROM ({st.BUREAU_SQL})")  # fmt: skip
def _fill(spark, sf):
    return nulls.fill_constant(st.Native(spark, sf).bureau(), -1, ["AMT_CREDIT_SUM_DEBT"])


@query("comparison_flags", "SK_ID_BUREAU,over,under,same,differs:int",
       "SELECT SK_ID_BUREAU, CASE WHEN DAYS_CREDIT_ENDDATE > 0 THEN 1 ELSE 0 END AS over, "
       "CASE WHEN DAYS_CREDIT_ENDDATE < -500 THEN 1 ELSE 0 END AS under, "
       "CASE WHEN CREDIT_ACTIVE = 'Active' THEN 1 ELSE 0 END AS same, "
       f"CASE WHEN CREDIT_ACTIVE = 'Closed' THEN 0 ELSE 1 END AS differs FROM ({st.BUREAU_SQL})")  # fmt: skip
def _flags(spark, sf):
    end, active = F.col("DAYS_CREDIT_ENDDATE"), F.col("CREDIT_ACTIVE")
    return st.Native(spark, sf).bureau().select(
        "SK_ID_BUREAU", nulls.flag(end > 0).alias("over"), nulls.flag(end < -500).alias("under"),
        nulls.flag(active == "Active").alias("same"), nulls.flag_not_equal(active, "Closed").alias("differs"),
    )


@query("positive_part", "SK_ID_PREV,NUM_INSTALMENT_NUMBER,l_partkey,l_suppkey:int dpd,dbd:num",
       "SELECT SK_ID_PREV, NUM_INSTALMENT_NUMBER, l_partkey, l_suppkey, "
       "CASE WHEN DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT THEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT ELSE 0 END AS dpd, "
       "CASE WHEN DAYS_ENTRY_PAYMENT < DAYS_INSTALMENT THEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT ELSE 0 END AS dbd "
       f"FROM ({st.INSTALLMENTS_SQL})")  # fmt: skip
def _positive(spark, sf):
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return st.Native(spark, sf).installments().withColumns(
        {"dpd": nulls.positive_part(late), "dbd": nulls.positive_part(-late)}
    )


@query("arithmetic_projection", "o_orderkey:int difference,guarded,product,weighted:num",
       "SELECT o_orderkey, o_totalprice - o_custkey AS difference, o_totalprice / (1 + o_custkey) AS guarded, "
       "o_totalprice * o_custkey AS product, o_totalprice * 2 + o_custkey * 3 AS weighted FROM orders")  # fmt: skip
def _arithmetic(spark, sf):
    a, b = F.col("o_totalprice"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", (a - b).alias("difference"), nulls.ratio(a, b + 1).alias("guarded"),
        (a * b).alias("product"), (a * 2 + b * 3).alias("weighted"),
    )


@query("division_rules", "SK_ID_PREV:int plain,safe:num",
       "SELECT SK_ID_PREV, AMT_DOWN_PAYMENT / nullif(AMT_CREDIT, 0) AS plain, "
       "CASE WHEN AMT_CREDIT = 0 THEN 0 ELSE AMT_DOWN_PAYMENT / nullif(AMT_CREDIT, 0) END AS safe "
       f"FROM ({st.PREVIOUS_SQL})")  # fmt: skip
def _division(spark, sf):
    a, b = F.col("AMT_DOWN_PAYMENT"), F.col("AMT_CREDIT")
    return st.Native(spark, sf).previous().select(
        "SK_ID_PREV", nulls.ratio(a, b).alias("plain"), nulls.safe_div("AMT_DOWN_PAYMENT", "AMT_CREDIT").alias("safe")
    )


@query("equality_filter", "o_orderkey:int o_totalprice:num",
       "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _filter(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")


@query("train_test_split", "half:str n:int mean_chars:num",
       "SELECT CASE WHEN TARGET IS NULL THEN 'test' ELSE 'train' END AS half, count(*) AS n, avg(N_CHARS) AS mean_chars "
       f"FROM ({st.DOCUMENTS_SQL}) GROUP BY 1")  # fmt: skip
def _split(spark, sf):
    train, test = clean.split_by_label(st.Native(spark, sf).documents())
    both = stack(train.withColumn("half", F.lit("train")), test.withColumn("half", F.lit("test")))
    return both.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.avg("N_CHARS").alias("mean_chars"))


@query("column_prefix", "SK_ID_CURR,B_o_orderkey:int B_o_totalprice:num",
       'SELECT o_custkey AS "SK_ID_CURR", o_orderkey AS "B_o_orderkey", o_totalprice AS "B_o_totalprice" FROM orders')
def _prefix(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "SK_ID_CURR")
    return with_prefix(orders, "B_", ["SK_ID_CURR"])


@query("columns_by_pattern", "SK_ID_CURR,documents:int",
       "SELECT SK_ID_CURR, " + " + ".join(f"FLAG_DOCUMENT_{i}" for i in range(2, 22))
       + f" AS documents FROM ({st.APPLICATION_SQL})")
def _pattern(spark, sf):
    clients = stack(*st.Native(spark, sf).applications())
    return clients.select("SK_ID_CURR", rowstats.row_sum(matching(clients, "FLAG_DOC")).alias("documents"))


@query("feature_column_list", "SK_ID_CURR:int TOTAL:num",
       "SELECT SK_ID_CURR, N_CHARS + N_SPACES + N_STOPS + N_COMMAS + N_E + N_ONES AS \"TOTAL\" "
       f"FROM ({st.DOCUMENTS_SQL})")  # fmt: skip
def _features(spark, sf):
    df = drop_existing(st.Native(spark, sf).documents(), "LANG", "SOURCE", "NEW_LIVE_IND_SUM")
    return df.select("SK_ID_CURR", rowstats.row_sum(feature_names(df)).alias("TOTAL"))


@query("column_name_tidying", "ORDER_KEY:int TOTAL_PRICE:num",
       'SELECT o_orderkey AS "ORDER_KEY", o_totalprice AS "TOTAL_PRICE" FROM orders')
def _tidy(spark, sf):
    return tidy_columns(
        table(spark, sf, "orders").selectExpr("o_orderkey AS ` order key`", "o_totalprice AS `total price `")
    )


@query("drop_incomplete_columns", "SK_ID_CURR,TARGET,CNT_CHILDREN:int kept:str",
       "SELECT SK_ID_CURR, TARGET, CNT_CHILDREN, 'SK_ID_CURR,TARGET,CNT_CHILDREN' AS kept FROM "
       f"({st.APPLICATION_SQL}) WHERE (SELECT count(*) - count(EXT_SOURCE_1) FROM ({st.APPLICATION_SQL})) > 0 "
       f"AND (SELECT count(*) - count(CNT_CHILDREN) FROM ({st.APPLICATION_SQL})) = 0")  # fmt: skip
def _incomplete(spark, sf):
    rows = stack(*st.Native(spark, sf).applications())
    rows = rows.select("SK_ID_CURR", "TARGET", "EXT_SOURCE_1", "CNT_CHILDREN", "OWN_CAR_AGE")
    kept = clean.drop_incomplete(rows)
    return kept.withColumn("kept", F.lit(",".join(kept.columns)))


@query("lossless_narrowing", "column,type:str",
       "SELECT * FROM (SELECT unnest(['l_orderkey','l_linenumber','l_quantity','l_extendedprice']) AS \"column\", "
       "unnest([CASE WHEN max(l_orderkey) < 127 THEN 'tinyint' WHEN max(l_orderkey) < 32767 THEN 'smallint' ELSE 'int' END, "
       "CASE WHEN max(l_linenumber) < 127 THEN 'tinyint' ELSE 'smallint' END, "
       "CASE WHEN bool_and(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) = l_quantity) THEN 'float' ELSE 'double' END, "
       "CASE WHEN bool_and(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) = l_extendedprice) THEN 'float' ELSE 'double' END]) "
       "AS \"type\" FROM lineitem)")  # fmt: skip
def _narrow(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    types = dict(clean.narrow(df).dtypes)
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in types.items()]
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
_LIST = f"list_filter([{', '.join(EXT)}], lambda x: x IS NOT NULL)"


def _stacked(spark, sf):
    return stack(*st.Native(spark, sf).applications())


@query("row_min_max", "SK_ID_CURR:int low,high:num",
       f"SELECT SK_ID_CURR, least({', '.join(EXT)}) AS low, greatest({', '.join(EXT)}) AS high FROM ({st.APPLICATION_SQL})")
def _row_min_max(spark, sf):
    return _stacked(spark, sf).select("SK_ID_CURR", rowstats.row_min(EXT).alias("low"), rowstats.row_max(EXT).alias("high"))


@query("row_sum_mean", "SK_ID_CURR:int total,mean:num",
       f"SELECT SK_ID_CURR, coalesce(list_sum({_LIST}), 0) AS total, list_avg({_LIST}) AS mean FROM ({st.APPLICATION_SQL})")
def _row_sum_mean(spark, sf):
    return _stacked(spark, sf).select("SK_ID_CURR", rowstats.row_sum(EXT).alias("total"), rowstats.row_mean(EXT).alias("mean"))


@query("row_median", "SK_ID_CURR:int middle:num",
       f"SELECT SK_ID_CURR, list_median({_LIST}) AS middle FROM ({st.APPLICATION_SQL})")
def _row_median(spark, sf):
    return _stacked(spark, sf).select("SK_ID_CURR", rowstats.row_median(EXT).alias("middle"))


@query("row_std", "SK_ID_CURR:int spread:num",
       f"SELECT SK_ID_CURR, CASE WHEN len({_LIST}) > 1 THEN list_stddev_samp({_LIST}) END AS spread FROM ({st.APPLICATION_SQL})")
def _row_std(spark, sf):
    return _stacked(spark, sf).select("SK_ID_CURR", rowstats.row_std(EXT).alias("spread"))


AREAS = "LIVINGAREA_MODE LANDAREA_MODE NONLIVINGAREA_AVG YEARS_BEGINEXPLUATATION_AVG TOTALAREA_MODE".split()
_AREA = f"list_filter([{', '.join(AREAS)}], lambda x: x IS NOT NULL)"


@query("row_kurtosis", "SK_ID_CURR:int peak:flat",
       f"""SELECT SK_ID_CURR, CASE WHEN n < 4 THEN NULL WHEN m2 < 1e-14 THEN 0 ELSE
           n * (n + 1) * (n - 1) * m4 / ((n - 2) * (n - 3) * m2 * m2) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) END AS peak
           FROM (SELECT SK_ID_CURR, CAST(len(v) AS DOUBLE) AS n, list_sum(list_transform(v, lambda x: pow(x - m, 2))) AS m2,
                 list_sum(list_transform(v, lambda x: pow(x - m, 4))) AS m4
                 FROM (SELECT SK_ID_CURR, {_AREA} AS v, list_avg({_AREA}) AS m FROM ({st.APPLICATION_SQL})))""")  # fmt: skip
def _row_kurtosis(spark, sf):
    return _stacked(spark, sf).select("SK_ID_CURR", rowstats.row_kurtosis(AREAS).alias("peak"))


@query("left_join_feature_blocks", "c_custkey,n_orders:int total,bal:num",
       "SELECT c_custkey, n_orders, total, bal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, "
       "sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN (SELECT c_custkey AS k, "
       "c_acctbal AS bal FROM customer WHERE c_acctbal > 0) ON c_custkey = k")  # fmt: skip
def _blocks(spark, sf):
    customer = table(spark, sf, "customer")
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total")
    )
    rich = customer.filter("c_acctbal > 0").selectExpr("c_custkey", "c_acctbal AS bal")
    return left_join_blocks(customer.select("c_custkey"), [sums, rich], "c_custkey")


@query("union_with_missing_columns", "SK_ID_CURR,TARGET,CNT_CHILDREN:int",
       f"SELECT SK_ID_CURR, TARGET, CNT_CHILDREN FROM ({st.APPLICATION_SQL})")
def _union(spark, sf):
    return stack(*st.Native(spark, sf).applications())


@query("union_of_scored_halves", "SK_ID_CURR:int SCORE:num",
       f"SELECT SK_ID_CURR, CASE WHEN TARGET IS NULL THEN N_CHARS / 2 ELSE N_CHARS END AS \"SCORE\" FROM ({st.DOCUMENTS_SQL})")
def _scored(spark, sf):
    train, test = clean.split_by_label(st.Native(spark, sf).documents())
    return stack(train.selectExpr("SK_ID_CURR", "N_CHARS AS SCORE"), test.selectExpr("SK_ID_CURR", "N_CHARS / 2 AS SCORE"))


@query("bind_columns_by_id", "doc_id,n_chars,quality:int lang:str",
       "SELECT d.doc_id, n_chars, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _bind(spark, sf):
    docs = table(spark, sf, "documents")
    return bind_by_id([docs.select("doc_id", "n_chars"), docs.select("doc_id", "lang"), table(spark, sf, "labels")], "doc_id")
