"""Group aggregation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import ratio
from ..functions.stats import share, smoothed_ratio, stat
from ..operators import aggregate as agg
from ..operators.profile import collect_stats
from ..operators.skew import group_percentiles
from . import standin as st
from .registry import query
from .sqltext import picks, spec_sql, stat_sql
from .standin import table

SPEC = {"o_totalprice": ["sum", "mean", "min", "max"], "o_orderkey": ["count"], "o_orderpriority": ["nunique"]}


@query("dictionary_aggregation",
       "o_custkey,o_orderkey_COUNT,o_orderpriority_NUNIQUE:int o_totalprice_SUM,o_totalprice_MEAN,o_totalprice_MIN,o_totalprice_MAX:num",
       f"SELECT o_custkey, {picks(spec_sql(SPEC))} FROM orders GROUP BY o_custkey")
def _dictionary(spark, sf):
    return agg.aggregate(table(spark, sf, "orders"), ["o_custkey"], SPEC)


def _simple(name: str, stats: list[str], column: str = "AMT_CREDIT_SUM_DEBT", kinds: str = "num"):
    cols = {f"v_{s}": stat_sql(s, column) for s in stats}

    @query(name, {"SK_ID_CURR": "int", **{c: kinds for c in cols}},
           f"SELECT SK_ID_CURR, {picks(cols)} FROM ({st.BUREAU_SQL}) GROUP BY SK_ID_CURR")
    def run(spark, sf):
        rows = st.Native(spark, sf).bureau()
        return rows.groupBy("SK_ID_CURR").agg(*[stat(s, column).alias(f"v_{s}") for s in stats])

    return run


_simple("group_sum", ["sum"])
_simple("group_mean_min_max", ["mean", "min", "max"])
_simple("group_variance", ["var", "std"])
_simple("group_count_and_size", ["count", "size"], kinds="int")
_simple("group_distinct_count", ["nunique"], "CREDIT_TYPE", kinds="int")
_simple("group_skew_kurtosis", ["skew", "kurt"], "AMT_CREDIT_SUM", kinds="flat")


@query("group_median", "SK_ID_CURR:int middle:num",
       f"SELECT SK_ID_CURR, median(AMT_CREDIT_SUM_DEBT) AS middle FROM ({st.BUREAU_SQL}) GROUP BY SK_ID_CURR")
def _median(spark, sf):
    return group_percentiles(st.Native(spark, sf).bureau(), ["SK_ID_CURR"], "AMT_CREDIT_SUM_DEBT", [0.5], ["middle"])


@query("group_iqr", "o_custkey:int iqr:num",
       "SELECT o_custkey, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders GROUP BY 1")
def _iqr(spark, sf):
    cuts = group_percentiles(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", [0.25, 0.75], ["a", "b"])
    return cuts.selectExpr("o_custkey", "b - a AS iqr")


@query("global_percentiles", "q10,q50,q90:num",
       "SELECT quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS q50, "
       "quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem")  # fmt: skip
def _global(spark, sf):
    return group_percentiles(table(spark, sf, "lineitem"), [], "l_extendedprice", [0.1, 0.5, 0.9], ["q10", "q50", "q90"])


@query("last_value_by_order", "o_custkey:int last_status:str",
       "SELECT o_custkey, o_orderstatus AS last_status FROM orders QUALIFY row_number() OVER "
       "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")  # fmt: skip
def _last(spark, sf):
    last = agg.last_value("o_orderstatus", ["o_orderdate", "o_orderkey"])
    return table(spark, sf, "orders").groupBy("o_custkey").agg(last.alias("last_status"))


@query("first_known_value", "SK_ID_CURR:int first_cnt:num",
       f"SELECT SK_ID_CURR, CNT_INSTALMENT AS first_cnt FROM ({st.POS_SQL}) WHERE CNT_INSTALMENT IS NOT NULL QUALIFY "
       "row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY MONTHS_BALANCE, event_id) = 1")  # fmt: skip
def _first(spark, sf):
    first = agg.first_known_value("CNT_INSTALMENT", ["MONTHS_BALANCE", "event_id"])
    return st.Native(spark, sf).pos().groupBy("SK_ID_CURR").agg(first.alias("first_cnt"))


@query("arg_max_row", "SK_ID_CURR,LATEST_SK_DPD,LATEST_SK_ID_PREV:int",
       'SELECT SK_ID_CURR, SK_DPD AS "LATEST_SK_DPD", SK_ID_PREV AS "LATEST_SK_ID_PREV" '
       f"FROM ({st.POS_SQL}) QUALIFY row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY MONTHS_BALANCE DESC, event_id DESC) = 1")  # fmt: skip
def _arg_max(spark, sf):
    return agg.arg_max_row(
        st.Native(spark, sf).pos(), ["SK_ID_CURR"], ["MONTHS_BALANCE", "event_id"], ["SK_DPD", "SK_ID_PREV"]
    )


_COUNTS = {
    "NAME_CONTRACT_STATUS_" + s.upper().replace(" ", "_"): f"count(*) FILTER (WHERE NAME_CONTRACT_STATUS = '{s}')"
    for s in st.POS_STATUSES
}


@query("value_counts_as_columns", {"SK_ID_CURR": "int", **{c: "int" for c in _COUNTS}},
       f"SELECT SK_ID_CURR, {picks(_COUNTS)} FROM ({st.POS_SQL}) GROUP BY SK_ID_CURR")
def _counts(spark, sf):
    return agg.value_counts(st.Native(spark, sf).pos(), ["SK_ID_CURR"], "NAME_CONTRACT_STATUS", st.POS_STATUSES)


@query("half_even_smoothed_ratio", "SK_ID_CURR:int ratio:num",
       f"SELECT SK_ID_CURR, round_even(a / (0.0001 + b), 0) AS ratio FROM (SELECT SK_ID_CURR, "
       "count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Active') AS a, "
       f"count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Completed') AS b FROM ({st.POS_SQL}) GROUP BY 1)")  # fmt: skip
def _half_even(spark, sf):
    counts = agg.value_counts(st.Native(spark, sf).pos(), ["SK_ID_CURR"], "NAME_CONTRACT_STATUS", ["Active", "Completed"])
    ratio_col = smoothed_ratio("NAME_CONTRACT_STATUS_ACTIVE", "NAME_CONTRACT_STATUS_COMPLETED")
    return counts.select("SK_ID_CURR", ratio_col.alias("ratio"))


_SEGMENT_SPEC = {"AMT_CREDIT": ["max", "mean"], "CNT_PAYMENT": ["mean", "sum"]}
_SEGMENTS = {"": None, "APPROVED_": "NAME_CONTRACT_STATUS = 'Approved'", "REFUSED_": "NAME_CONTRACT_STATUS = 'Refused'"}
_SEGMENT_SQL = {n: e for p, w in _SEGMENTS.items() for n, e in spec_sql(_SEGMENT_SPEC, p, w).items()}


@query("segment_aggregation", {"SK_ID_CURR": "int", **{c: "num" for c in _SEGMENT_SQL}},
       f"SELECT SK_ID_CURR, {picks(_SEGMENT_SQL)} FROM ({st.PREVIOUS_SQL}) GROUP BY SK_ID_CURR")
def _segments(spark, sf):
    rows = st.Native(spark, sf).previous()
    return rows.groupBy("SK_ID_CURR").agg(*agg.segment_columns(_SEGMENT_SPEC, _SEGMENTS))


@query("filtered_aggregates_on_spine", "SK_ID_CURR:int APPROVED_MAX:num REFUSED_MAX:num",
       'SELECT SK_ID_CURR, max(AMT_CREDIT) FILTER (WHERE NAME_CONTRACT_STATUS = \'Approved\') AS "APPROVED_MAX", '
       'max(AMT_CREDIT) FILTER (WHERE NAME_CONTRACT_STATUS = \'Refused\') AS "REFUSED_MAX" '
       f"FROM ({st.PREVIOUS_SQL}) GROUP BY SK_ID_CURR")  # fmt: skip
def _spine_filtered(spark, sf):
    return st.Native(spark, sf).previous().groupBy("SK_ID_CURR").agg(
        stat("max", "AMT_CREDIT", _SEGMENTS["APPROVED_"]).alias("APPROVED_MAX"),
        stat("max", "AMT_CREDIT", _SEGMENTS["REFUSED_"]).alias("REFUSED_MAX"),
    )


@query("aggregate_on_spine", "o_custkey,n:int total:num",
       "SELECT s.o_custkey, n, total FROM (SELECT DISTINCT o_custkey FROM orders) s LEFT JOIN (SELECT o_custkey, count(*) AS n, "
       "sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON s.o_custkey = a.o_custkey")  # fmt: skip
def _spine(spark, sf):
    orders = table(spark, sf, "orders")
    part = orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    return agg.entity_spine(orders, "o_custkey").join(part, "o_custkey", "left")


@query("group_share", "SK_ID_CURR:int refused:num",
       "SELECT SK_ID_CURR, avg(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1.0 ELSE 0.0 END) AS refused "
       f"FROM ({st.PREVIOUS_SQL}) GROUP BY 1")  # fmt: skip
def _share(spark, sf):
    rows = st.Native(spark, sf).previous()
    return rows.groupBy("SK_ID_CURR").agg(share("NAME_CONTRACT_STATUS = 'Refused'").alias("refused"))


@query("two_level_aggregation", "SK_ID_CURR:int total,load:num",
       "SELECT * FROM (SELECT SK_ID_CURR, sum(m) AS total FROM (SELECT SK_ID_CURR, SK_ID_PREV, max(CNT_INSTALMENT_MATURE_CUM) AS m "
       f"FROM ({st.CREDIT_CARD_SQL}) GROUP BY ALL) GROUP BY 1) JOIN (SELECT SK_ID_CURR, avg(r) AS load FROM (SELECT SK_ID_CURR, "
       "SK_ID_PREV, AMT_CREDIT_LIMIT_ACTUAL, max(AMT_BALANCE) / nullif(max(AMT_CREDIT_LIMIT_ACTUAL), 0) AS r "
       f"FROM ({st.CREDIT_CARD_SQL}) GROUP BY ALL) GROUP BY 1) USING (SK_ID_CURR)")  # fmt: skip
def _two_level(spark, sf):
    cards, key, loan, limit = st.Native(spark, sf).credit_card(), ["SK_ID_CURR"], "SK_ID_PREV", "AMT_CREDIT_LIMIT_ACTUAL"
    totals = agg.two_level(
        cards, key, [loan], [F.max("CNT_INSTALMENT_MATURE_CUM").alias("m")], [F.sum("m").alias("total")]
    )
    load = ratio(F.max("AMT_BALANCE"), F.max(limit)).alias("r")
    return totals.join(agg.two_level(cards, key, [loan, limit], [load], [F.avg("r").alias("load")]), key)


@query("aggregate_max_ratio", "SK_ID_CURR:int loading:num",
       f"SELECT SK_ID_CURR, max(AMT_BALANCE) / nullif(max(AMT_CREDIT_LIMIT_ACTUAL), 0) AS loading FROM ({st.CREDIT_CARD_SQL}) GROUP BY 1")
def _max_ratio(spark, sf):
    cards = st.Native(spark, sf).credit_card()
    return cards.groupBy("SK_ID_CURR").agg(ratio(F.max("AMT_BALANCE"), F.max("AMT_CREDIT_LIMIT_ACTUAL")).alias("loading"))


@query("ratios_of_aggregates", "SK_ID_CURR:int per_type,debt_share:num",
       "SELECT SK_ID_CURR, count(*) / count(DISTINCT CREDIT_TYPE) AS per_type, coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) / "
       f"nullif(coalesce(sum(AMT_CREDIT_SUM), 0), 0) AS debt_share FROM ({st.BUREAU_SQL}) GROUP BY 1")  # fmt: skip
def _ratios(spark, sf):
    sums = st.Native(spark, sf).bureau().groupBy("SK_ID_CURR").agg(
        stat("size", "SK_ID_BUREAU").alias("n"), stat("nunique", "CREDIT_TYPE").alias("t"),
        stat("sum", "AMT_CREDIT_SUM_DEBT").alias("d"), stat("sum", "AMT_CREDIT_SUM").alias("c"),
    )
    return sums.select(
        "SK_ID_CURR", ratio(F.col("n"), F.col("t")).alias("per_type"), ratio(F.col("d"), F.col("c")).alias("debt_share")
    )


@query("global_column_statistics", "column:str low,high,mean:num known:int",
       " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", min({c}) AS low, max({c}) AS high, avg({c}) AS mean, count({c}) AS known FROM lineitem"
           for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))
def _statistics(spark, sf):
    df, names = table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
    s = collect_stats(df, names)
    rows = [(c, float(s.low[c]), float(s.high[c]), float(s.mean[c]), s.known[c]) for c in names]
    return spark.createDataFrame(rows, "column string, low double, high double, mean double, known bigint")
