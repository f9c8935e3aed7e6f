"""Ordered-history operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as op
from ..plans import installments as ip
from . import standin as st
from .blocks import IP_PREPARED_SQL, IP_RANKED_SQL, KEY, typed
from .registry import query
from .sqltext import bundle_sql, picks, slope_sql, stat_sql
from .standin import table

ORDER = ("DAYS_INSTALMENT", *st.INSTALLMENT_TIES)


def _payments(spark, sf):
    return ip.prepared(st.Native(spark, sf).installments())


@query("mean_monthly_step", "SK_ID_CURR:int step:num",
       "SELECT SK_ID_CURR, avg(d) AS step FROM (SELECT SK_ID_CURR, AMT_BALANCE - lag(AMT_BALANCE) OVER "
       f"(PARTITION BY SK_ID_CURR ORDER BY MONTHS_BALANCE, event_id) AS d FROM ({st.CREDIT_CARD_SQL})) GROUP BY 1")  # fmt: skip
def _step(spark, sf):
    cards = st.Native(spark, sf).credit_card().select(KEY, "MONTHS_BALANCE", "event_id", "AMT_BALANCE")
    return op.mean_step(cards, [KEY], op.oldest_first("MONTHS_BALANCE", "event_id"), "AMT_BALANCE", "step")


_TAILS = {f"price_last_{n}": stat_sql("mean", "o_totalprice", f"rn <= {n}") for n in (1, 2, 3, 4, 5)}


@query("last_n_means", {"o_custkey": "int", **{c: "num" for c in _TAILS}},
       f"SELECT o_custkey, {picks(_TAILS)} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, "
       "o_orderkey DESC) AS rn FROM orders) GROUP BY 1")  # fmt: skip
def _tails(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    order = op.newest_first("o_orderdate", "o_orderkey")
    return op.tail_means(orders, ["o_custkey"], order, {"o_totalprice": "price_last_{n}"}, [1, 2, 3, 4, 5])


_BUNDLES = {"DPD": ["sum", "mean", "max", "min", "std", "count"], ip.OVER: ["mean", "median", "iqr", "skew", "kurt"]}
_PERIODS = [1, 5, 20, 100]
_BUNDLE_SQL = {
    n: e
    for k in _PERIODS
    for c, stats in _BUNDLES.items()
    for n, e in bundle_sql(c, stats, f"last_{k}_", f"rn <= {k}").items()
}


@query("last_k_statistics", typed(_BUNDLE_SQL),
       f"SELECT SK_ID_CURR, {picks(_BUNDLE_SQL)} FROM ({IP_RANKED_SQL}) GROUP BY 1")
def _last_k(spark, sf):
    rows = _payments(spark, sf).select(KEY, *ORDER, *_BUNDLES)
    return op.last_k_statistics(rows, [KEY], op.newest_first(*ORDER), _BUNDLES, _PERIODS)


_WHOLE = {"DPD": ["sum", "mean", "max", "min", "std", "count", "skew", "kurt", "iqr", "median"]}
_WHOLE_SQL = bundle_sql("DPD", _WHOLE["DPD"], "whole_")


@query("statistic_bundle", typed(_WHOLE_SQL), f"SELECT SK_ID_CURR, {picks(_WHOLE_SQL)} FROM ({IP_PREPARED_SQL}) GROUP BY 1")
def _bundle(spark, sf):
    from ..functions.stats import stat_bundle
    from ..operators.skew import group_percentiles

    rows = _payments(spark, sf).select(KEY, "DPD")
    plain = [s for s in _WHOLE["DPD"] if s not in ("iqr", "median")]
    cuts = group_percentiles(rows, [KEY], "DPD", [0.25, 0.5, 0.75], ["q1", "whole_DPD_median", "q3"])
    out = rows.groupBy(KEY).agg(*stat_bundle("DPD", plain, "whole_"))
    return out.join(cuts.withColumn("whole_DPD_iqr", F.col("q3") - F.col("q1")), KEY)


_FRACTION = {
    f"last_5by20_fraction_DPD_{s}": f'CASE WHEN b_{s} = 0 THEN 0 ELSE a_{s} / nullif(b_{s}, 0) END' for s in ("sum", "mean", "max")
}


@query("short_to_long_fractions", typed(_FRACTION),
       f"SELECT SK_ID_CURR, {picks(_FRACTION)} FROM (SELECT SK_ID_CURR, "
       + ", ".join(f"{stat_sql(s, 'DPD', f'rn <= {k}')} AS {p}_{s}" for p, k in (("a", 5), ("b", 20)) for s in ("sum", "mean", "max"))
       + f" FROM ({IP_RANKED_SQL}) GROUP BY 1)")
def _fractions(spark, sf):
    rows = _payments(spark, sf).select(KEY, *ORDER, "DPD")
    out = op.last_k_statistics(rows, [KEY], op.newest_first(*ORDER), {"DPD": ["sum", "mean", "max"]}, [5, 20])
    return out.selectExpr("*", *op.fraction_columns(out.columns, 5, 20))


_TRENDS = {f"{k}_period_trend_{c}": slope_sql(c, k) for k in (10, 50, 500) for c in ("DPD", ip.OVER)}


@query("trend_slopes", typed(_TRENDS), f"SELECT SK_ID_CURR, {picks(_TRENDS)} FROM ({IP_RANKED_SQL}) GROUP BY 1")
def _trends(spark, sf):
    rows = _payments(spark, sf).select(KEY, *ORDER, "DPD", ip.OVER)
    return op.trends(rows, [KEY], op.newest_first(*ORDER), ["DPD", ip.OVER], [10, 50, 500])


_LOAN_SQL = {n: e for c, s in ip.LOAN_BUNDLES.items() for n, e in bundle_sql(c, s, "last_loan_").items()}


@query("last_loan_features", typed(_LOAN_SQL),
       f"SELECT SK_ID_CURR, {picks(_LOAN_SQL)} FROM ({IP_RANKED_SQL}) WHERE SK_ID_PREV = newest GROUP BY 1")
def _last_loan(spark, sf):
    return op.last_loan(_payments(spark, sf), [KEY], "SK_ID_PREV", ORDER, ip.LOAN_BUNDLES)


@query("top_rows_in_order", "p_brand:str n:int mean_price:num",
       "SELECT p_brand, count(*) AS n, avg(p_retailprice) AS mean_price FROM part GROUP BY 1 ORDER BY mean_price DESC, p_brand LIMIT 30")
def _top(spark, sf):
    means = table(spark, sf, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price")
    )
    return means.orderBy(F.desc("mean_price"), "p_brand").limit(30)


@query("first_row_per_key", "o_custkey,o_orderkey:int o_totalprice:num",
       "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY "
       "o_totalprice DESC, o_orderkey) = 1")  # fmt: skip
def _first_row(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return op.first_rows(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
