"""Feature blocks, the wide table, the scorecard and the stack over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.ordered import SMALLEST_DIVISOR, UNSTABLE
from ..plans import application as app
from ..plans import bureau, credit_card, installments, pos, previous
from ..plans.wide import wide_table
from . import standin as st
from .registry import query
from .sqltext import bundle_sql, kind_of, picks, ratio_sql, slope_sql, spec_sql, stat_sql

KEY = "SK_ID_CURR"


def prefixed(inner: str, columns, prefix: str) -> str:
    return f"SELECT {KEY}, " + ", ".join(f'"{c}" AS "{prefix}{c}"' for c in columns) + f" FROM ({inner})"


def typed(columns, **fixed) -> dict[str, str]:
    return {KEY: "int", **{c: fixed.get(c) or kind_of(c) for c in columns}}


# ---------------------------------------------------------------- application


def _row_kurt(cols) -> str:
    vals = "[" + ", ".join(f'CAST("{c}" AS DOUBLE)' for c in cols) + "]"
    n, d = len(cols), len(cols)
    mean = f"list_avg({vals})"
    m2 = f"list_sum(list_transform({vals}, lambda x: pow(x - {mean}, 2)))"
    m4 = f"list_sum(list_transform({vals}, lambda x: pow(x - {mean}, 4)))"
    adj = f"3.0 * ({n} - 1) * ({n} - 1) / (({n} - 2) * ({n} - 3))"
    body = f"{n} * ({n} + 1.0) * ({n} - 1) * {m4} / (({d} - 2) * ({d} - 3) * {m2} * {m2})"
    return f"CASE WHEN {m2} < 1e-14 THEN 0.0 ELSE {body} - {adj} END"


def _row_sum(cols) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


def _application_sql() -> tuple[str, list[str]]:
    clean = (
        "SELECT * REPLACE (nullif(DAYS_LAST_PHONE_CHANGE, 0) AS DAYS_LAST_PHONE_CHANGE, "
        "nullif(CODE_GENDER, 'XNA') AS CODE_GENDER, nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED, "
        "nullif(NAME_FAMILY_STATUS, 'Unknown') AS NAME_FAMILY_STATUS, "
        "nullif(ORGANIZATION_TYPE, 'XNA') AS ORGANIZATION_TYPE), CNT_FAM_MEMBERS - CNT_CHILDREN AS CNT_NON_CHILD "
        f"FROM ({st.APPLICATION_SQL})"
    )
    edges = app.EMPLOYED_EDGES
    bins = " ".join(f"WHEN DAYS_EMPLOYED <= {hi} THEN {i}" for i, hi in enumerate(edges[1:]))
    ext = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
    lst = f"list_filter([{', '.join(ext)}], lambda x: x IS NOT NULL)"
    docs = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]
    yes = {c: f"CASE {c} WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END" for c in app.LIVE_FLAGS}
    cols = {c: c for c in app.KEPT}
    cols["NEW_IS_DAYS_EMPLOYED_365243"] = "CASE WHEN DAYS_EMPLOYED IS NULL THEN 1 ELSE 0 END"
    cols["DAYS_EMPLOYED"] = f"CASE WHEN DAYS_EMPLOYED <= {edges[0]} THEN NULL {bins} END"
    cols["CNT_NON_CHILD"] = "CNT_NON_CHILD"
    for name, a, b, plus in app.RATIOS:
        cols[name.replace("/", "_DIV_")] = ratio_sql(a, f"{b} + {plus}" if plus >= 0 else f"{b} - {-plus}")
    cols["AMT_INCOME_TOTAL_DIV_CNT_FAM_MEMBERS_TIMES_AMT_CREDIT"] = ratio_sql(
        "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS * AMT_CREDIT"
    )
    cols["EXT_SOURCES_PROD"] = "EXT_SOURCE_1 * EXT_SOURCE_2 * EXT_SOURCE_3"
    cols["EXT_SOURCE_WEIGHTED"] = "EXT_SOURCE_1 * 2 + EXT_SOURCE_2 * 3 + EXT_SOURCE_3 * 4"
    cols["EXT_SCORES_STD"] = f"CASE WHEN len({lst}) > 1 THEN list_stddev_samp({lst}) END"
    cols["EXT_SOURCES_min"] = f"list_min({lst})"
    cols["EXT_SOURCES_max"] = f"list_max({lst})"
    cols["EXT_SOURCES_sum"] = f"coalesce(list_sum({lst}), 0)"
    cols["EXT_SOURCES_mean"] = f"list_avg({lst})"
    cols["EXT_SOURCES_nanmedian"] = f"list_median({lst})"
    cols["NEWLY_EMPLOYED"] = "CASE WHEN DAYS_EMPLOYED < -2000 THEN 1 ELSE 0 END"
    cols["YOUNG_AGED"] = "CASE WHEN DAYS_BIRTH < -14000 THEN 1 ELSE 0 END"
    cols["NEW_DOC_IND_KURT"] = _row_kurt(docs)
    cols["NEW_NUMBER_OF_DOCUMENTS_SUBMITTED"] = _row_sum(docs)
    cols["NEW_LIVE_IND_SUM"] = _row_sum(yes.values())
    cols["NEW_LIVE_IND_KURT"] = "CAST(NULL AS DOUBLE)"
    cols["NEW_CONTACT_IND_SUM"] = _row_sum(app.CONTACT_FLAGS)
    cols["NEW_CONTACT_IND_KURT"] = _row_kurt(app.CONTACT_FLAGS)
    cols["NEW_REG_IND_SUM"] = _row_sum(app.REGION_FLAGS)
    cols["NEW_REG_IND_KURT"] = _row_kurt(app.REGION_FLAGS)
    return f"SELECT {KEY}, TARGET,\n  {picks(cols)}\nFROM ({clean})", ["TARGET", *cols]


APP_SQL, APP_COLUMNS = _application_sql()
APP_KINDS = typed(APP_COLUMNS, CODE_GENDER="str")


@query("application_features", APP_KINDS, APP_SQL)
def _application(spark, sf):
    return app.application_features(*st.Native(spark, sf).applications())


# --------------------------------------------------------------------- bureau


def _bureau_sql() -> tuple[str, list[str]]:
    clean = (
        "SELECT * REPLACE (CASE WHEN DAYS_CREDIT_ENDDATE >= -40000 THEN DAYS_CREDIT_ENDDATE END AS DAYS_CREDIT_ENDDATE, "
        "CASE WHEN DAYS_CREDIT_UPDATE >= -40000 THEN DAYS_CREDIT_UPDATE END AS DAYS_CREDIT_UPDATE) "
        f"FROM ({st.BUREAU_SQL})"
    )
    cols = {
        "DAYS_CREDIT_count": "count(DAYS_CREDIT)",
        "CREDIT_TYPE_nunique": "count(DISTINCT CREDIT_TYPE)",
        "credit_active_binary": "avg(CASE WHEN CREDIT_ACTIVE = 'Closed' THEN 0.0 ELSE 1.0 END)",
        "total_customer_debt": stat_sql("sum", "AMT_CREDIT_SUM_DEBT"),
        "total_customer_credit": stat_sql("sum", "AMT_CREDIT_SUM"),
        "total_customer_overdue": stat_sql("sum", "AMT_CREDIT_SUM_OVERDUE"),
        "average_creditdays_prolonged": stat_sql("sum", "CNT_CREDIT_PROLONG"),
        "credit_enddate_percentage": "avg(CASE WHEN DAYS_CREDIT_ENDDATE > 0 THEN 1.0 ELSE 0.0 END)",
        **spec_sql(bureau.AGGREGATES),
    }
    ratios = {
        "average_of_past_loans_per_type": ratio_sql("DAYS_CREDIT_count", "CREDIT_TYPE_nunique"),
        "debt_credit_ratio": ratio_sql("total_customer_debt", "total_customer_credit"),
        "overdue_debt_ratio": ratio_sql("total_customer_overdue", "total_customer_debt"),
    }
    inner = f"SELECT {KEY}, {picks(cols)} FROM ({clean}) GROUP BY {KEY}"
    names = [*cols, *ratios]
    return prefixed(f"SELECT *, {picks(ratios)} FROM ({inner})", names, "B_"), ["B_" + n for n in names]


B_SQL, B_COLUMNS = _bureau_sql()


@query("bureau_features", typed(B_COLUMNS), B_SQL)
def _bureau(spark, sf):
    return bureau.bureau_features(st.Native(spark, sf).bureau())


# ---------------------------------------------------------------- credit card


def _credit_card_sql() -> tuple[str, list[str]]:
    clean = (
        "SELECT * REPLACE (CASE WHEN AMT_DRAWINGS_ATM_CURRENT >= 0 THEN AMT_DRAWINGS_ATM_CURRENT END AS AMT_DRAWINGS_ATM_CURRENT, "
        "CASE WHEN AMT_DRAWINGS_CURRENT >= 0 THEN AMT_DRAWINGS_CURRENT END AS AMT_DRAWINGS_CURRENT), "
        f"AMT_BALANCE - lag(AMT_BALANCE) OVER (PARTITION BY {KEY} ORDER BY MONTHS_BALANCE, event_id) AS step "
        f"FROM ({st.CREDIT_CARD_SQL})"
    )
    cols = {
        "credit_card_number_of_loans": "count(DISTINCT SK_ID_PREV)",
        "credit_card_average_of_days_past_due": "avg(SK_DPD)",
        "credit_card_drawings_atm": stat_sql("sum", "AMT_DRAWINGS_ATM_CURRENT"),
        "credit_card_drawings_total": stat_sql("sum", "AMT_DRAWINGS_CURRENT"),
        "credit_card_monthly_diff": "avg(step)",
        "CC_COUNT": "count(*)",
        **spec_sql(credit_card.AGGREGATES),
    }
    main = f"SELECT {KEY}, {picks(cols)} FROM ({clean}) GROUP BY {KEY}"
    loans = (
        f"SELECT {KEY}, coalesce(sum(m), 0) AS credit_card_total_installments FROM (SELECT {KEY}, SK_ID_PREV, "
        f"max(CNT_INSTALMENT_MATURE_CUM) AS m FROM ({clean}) GROUP BY ALL) GROUP BY {KEY}"
    )
    loads = (
        f"SELECT {KEY}, avg(r) AS credit_card_avg_loading_of_credit_limit FROM (SELECT {KEY}, SK_ID_PREV, "
        f"AMT_CREDIT_LIMIT_ACTUAL, max(AMT_BALANCE) / nullif(max(AMT_CREDIT_LIMIT_ACTUAL), 0) AS r FROM ({clean}) "
        f"GROUP BY ALL) GROUP BY {KEY}"
    )
    more = {
        "credit_card_cash_card_ratio": ratio_sql("credit_card_drawings_atm", "credit_card_drawings_total"),
        "credit_card_installments_per_loan": ratio_sql("credit_card_total_installments", "credit_card_number_of_loans"),
    }
    names = [*cols, "credit_card_total_installments", "credit_card_avg_loading_of_credit_limit", *more]
    joined = f"SELECT *, {picks(more)} FROM ({main}) JOIN ({loans}) USING ({KEY}) JOIN ({loads}) USING ({KEY})"
    return prefixed(joined, names, "CC_"), ["CC_" + n for n in names]


CC_SQL, CC_COLUMNS = _credit_card_sql()
CC_TIES = ["event_id"]


@query("credit_card_features", typed(CC_COLUMNS), CC_SQL)
def _credit_card(spark, sf):
    return credit_card.credit_card_features(st.Native(spark, sf).credit_card(), ties=CC_TIES)


# --------------------------------------------------------------- installments

IP_PREPARED_SQL = f"""
SELECT *, greatest(coalesce(late, 0), 0) AS DPD, greatest(coalesce(-late, 0), 0) AS DBD,
  CASE WHEN late > 0 THEN 1 ELSE 0 END AS IS_DPD,
  CASE WHEN "{installments.OVER}" > 0 THEN 1 ELSE 0 END AS "{installments.IS_OVER}"
FROM (SELECT *, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS late,
        AMT_PAYMENT / nullif(AMT_INSTALMENT + 1, 0) AS "AMT_PAYMENT_DIV_AMT_INSTALMENT",
        AMT_PAYMENT - AMT_INSTALMENT AS "{installments.OVER}"
      FROM ({st.INSTALLMENTS_SQL}))
"""
IP_ORDER = "DAYS_INSTALMENT DESC NULLS LAST, " + ", ".join(f"{c} DESC NULLS LAST" for c in st.INSTALLMENT_TIES)
IP_RANKED_SQL = f"""
SELECT *, row_number() OVER w AS rn, first_value(SK_ID_PREV) OVER w AS newest
FROM ({IP_PREPARED_SQL}) WINDOW w AS (PARTITION BY {KEY} ORDER BY {IP_ORDER})
"""


# A ratio of two standardised values has no stable digits where the divisor is 0 up to
# rounding (a symmetric group); both sides show a missing value there.


def _installments_sql(all_history: bool = False) -> tuple[str, list[str]]:
    m = installments
    cols: dict[str, str] = {}
    for k in m.PERIODS:
        for c, stats in m.BUNDLES.items():
            cols |= bundle_sql(c, stats, f"last_{k}_", f"rn <= {k}")
    for k in m.TREND_PERIODS:
        for c in ("DPD", m.OVER):
            cols[f"{k}_period_trend_{c}"] = slope_sql(c, k)
    for c, stats in m.LOAN_BUNDLES.items():
        cols |= bundle_sql(c, stats, "last_loan_", "SK_ID_PREV = newest")
    cols |= spec_sql(m.AGGREGATES)
    if all_history:
        for c, stats in m.BUNDLES.items():
            cols |= bundle_sql(c, stats, "all_installment_")
    short, long = m.FRACTIONS[-1]
    fractions = {}
    for c, stats in m.BUNDLES.items():
        for s in stats:
            a, b = f'"last_{short}_{c}_{s}"', f'"last_{long}_{c}_{s}"'
            fractions[f"last_{short}by{long}_fraction_{c}_{s}"] = (
                f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / nullif({b}, 0) END"
            )
            if s in UNSTABLE:
                name = f"last_{short}by{long}_fraction_{c}_{s}"
                fractions[name] = f"CASE WHEN abs({b}) >= {SMALLEST_DIVISOR} THEN {fractions[name]} END"
    names = [*cols, *fractions]
    inner = f"SELECT {KEY}, {picks(cols)} FROM ({IP_RANKED_SQL}) GROUP BY {KEY}"
    return prefixed(f"SELECT *, {picks(fractions)} FROM ({inner})", names, "IP_"), ["IP_" + n for n in names]


IP_SQL, IP_COLUMNS = _installments_sql()
IP_ALL_SQL, IP_ALL_COLUMNS = _installments_sql(all_history=True)


@query("installment_features", typed(IP_COLUMNS), IP_SQL)
def _installments(spark, sf):
    rows = st.Native(spark, sf).installments()
    return installments.installment_features(rows, ties=st.INSTALLMENT_TIES)


@query("installment_features_all_history", typed(IP_ALL_COLUMNS), IP_ALL_SQL)
def _installments_all(spark, sf):
    rows = st.Native(spark, sf).installments()
    return installments.installment_features(rows, ties=st.INSTALLMENT_TIES, all_history=True)


# ------------------------------------------------------ previous applications


def _previous_sql() -> tuple[str, list[str]]:
    m = previous
    days = ", ".join(f"nullif({c}, 365243) AS {c}" for c in m.DAY_COLUMNS)
    ranked = (
        f"SELECT * REPLACE ({days}), CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1 ELSE 0 END AS WAS_APPROVED, "
        "CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END AS WAS_REFUSED, "
        "CASE WHEN NAME_CONTRACT_TYPE = 'Revolving loans' THEN 1 ELSE 0 END AS WAS_REVOLVING_LOAN, "
        "AMT_APPLICATION / nullif(AMT_CREDIT, 0) AS AMT_APPLICATION_DIV_AMT_CREDIT, "
        f"row_number() OVER (PARTITION BY {KEY} ORDER BY DAYS_DECISION DESC, SK_ID_PREV DESC) AS rn "
        f"FROM ({st.PREVIOUS_SQL})"
    )
    cols = {c: f"max({c}) FILTER (WHERE rn = 1)" for c in ("WAS_APPROVED", "WAS_REFUSED", "WAS_REVOLVING_LOAN")}
    cols["NUM_PREVIOUS_APPLICATIONS"] = "count(DISTINCT SK_ID_PREV)"
    cols["FRACTION_REFUSED_APPLICATION"] = "avg(WAS_REFUSED)"
    for n in m.TAILS:
        for c, name in m.TAIL_NAMES.items():
            cols[name.format(n=n)] = stat_sql("mean", c, f"rn <= {n}")
    cols |= spec_sql(m.AGGREGATES)
    cols |= spec_sql(m.AGGREGATES, "APPROVED_", "NAME_CONTRACT_STATUS = 'Approved'")
    cols |= spec_sql(m.AGGREGATES, "REFUSED_", "NAME_CONTRACT_STATUS = 'Refused'")
    inner = f"SELECT {KEY}, {picks(cols)} FROM ({ranked}) GROUP BY {KEY}"
    return prefixed(inner, cols, "PA_"), ["PA_" + n for n in cols]


PA_SQL, PA_COLUMNS = _previous_sql()


@query("previous_application_features", typed(PA_COLUMNS), PA_SQL)
def _previous(spark, sf):
    return previous.previous_features(st.Native(spark, sf).previous())


# ------------------------------------------------------------------- POS cash


def _pos_sql() -> tuple[str, list[str]]:
    m = pos
    ranked = (
        "SELECT *, CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END AS done, "
        "CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS DPD_GT_0, CASE WHEN SK_DPD_DEF > 0 THEN 1 ELSE 0 END AS DPDDEF_GT_0, "
        "SK_DPD - SK_DPD_DEF AS DPD_MINUS_DPD_DEF, row_number() OVER w AS rn, first_value(SK_ID_PREV) OVER w AS newest "
        f"FROM ({st.POS_SQL}) WINDOW w AS (PARTITION BY {KEY} ORDER BY MONTHS_BALANCE DESC, event_id DESC)"
    )
    cols = {"IS_CONTRACT_STATUS_COMPLETED_sum": "sum(done)"}
    for k, prefix in ((None, "all_installment_"), (6, "last_6_")):
        for c, stats in m.BUNDLES.items():
            cols |= bundle_sql(c, stats, prefix, f"rn <= {k}" if k else None)
    for k in m.TREND_PERIODS:
        for c in ("SK_DPD", "SK_DPD_DEF", "CNT_INSTALMENT_FUTURE"):
            cols[f"{k}_period_trend_{c}"] = slope_sql(c, k)
    for c, stats in m.LOAN_BUNDLES.items():
        cols |= bundle_sql(c, stats, "last_loan_", "SK_ID_PREV = newest")
    for s in st.POS_STATUSES:
        cols["NAME_CONTRACT_STATUS_" + s.replace(" ", "_").upper()] = f"count(*) FILTER (WHERE NAME_CONTRACT_STATUS = '{s}')"
    cols |= spec_sql(m.AGGREGATES)
    cols["CNT_INSTALMENT_FIRST"] = "arg_max(CNT_INSTALMENT, rn) FILTER (WHERE CNT_INSTALMENT IS NOT NULL)"
    cols["LATEST_SK_DPD_DEF"] = "arg_min(SK_DPD_DEF, rn)"
    ratio = {
        "NAME_CONTRACT_STATUS_ACTIVE_DIV_COMPLETED": "round_even(NAME_CONTRACT_STATUS_ACTIVE / (NAME_CONTRACT_STATUS_COMPLETED + 0.0001), 0)"
    }
    names = [*cols, *ratio]
    inner = f"SELECT {KEY}, {picks(cols)} FROM ({ranked}) GROUP BY {KEY}"
    return prefixed(f"SELECT *, {picks(ratio)} FROM ({inner})", names, "POS_"), ["POS_" + n for n in names]


POS_FEATURES_SQL, POS_COLUMNS = _pos_sql()


@query("pos_cash_features", typed(POS_COLUMNS), POS_FEATURES_SQL)
def _pos(spark, sf):
    return pos.pos_features(st.Native(spark, sf).pos(), ties=["event_id"], statuses=st.POS_STATUSES)


# ----------------------------------------------------------------- wide table


def native_wide(spark, sf, **changes):
    t = st.Native(spark, sf)
    train, test = t.applications()
    return wide_table(
        train, test, t.bureau(), t.credit_card(), t.installments(), t.previous(), t.pos(),
        options={
            "credit_card": {"ties": CC_TIES},
            "installments": {"ties": st.INSTALLMENT_TIES},
            "pos": {"ties": ["event_id"], "statuses": st.POS_STATUSES},
        },
        **changes,
    )


WIDE_KINDS = APP_KINDS | typed([*B_COLUMNS, *CC_COLUMNS, *IP_COLUMNS, *PA_COLUMNS, *POS_COLUMNS])
WIDE_SQL = (
    f"SELECT * FROM ({APP_SQL}) LEFT JOIN ({B_SQL}) USING ({KEY}) LEFT JOIN ({CC_SQL}) USING ({KEY}) "
    f"LEFT JOIN ({IP_SQL}) USING ({KEY}) LEFT JOIN ({PA_SQL}) USING ({KEY}) LEFT JOIN ({POS_FEATURES_SQL}) USING ({KEY})"
)


@query("wide_table", WIDE_KINDS, WIDE_SQL)
def _wide(spark, sf):
    return native_wide(spark, sf)


@query("wide_table_of_stored_blocks", WIDE_KINDS, WIDE_SQL)
def _wide_stored(spark, sf):
    """As ``wide_table``, its blocks written clustered by client first."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return native_wide(spark, sf, store=f"wide_{uuid.uuid4().hex}", buckets=buckets)


@query("post_processing_hook", f"{KEY}:int doubled:num", f"SELECT {KEY}, AMT_CREDIT * 2 AS doubled FROM ({APP_SQL})")
def _hook(spark, sf):
    return native_wide(spark, sf, written=False, post_process=lambda d: d.select(KEY, (F.col("AMT_CREDIT") * 2).alias("doubled")))
