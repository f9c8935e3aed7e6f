"""The driver's tables seen through the native schema.

Each stand-in is a list of (column, SQL expression) over one given table (or a
key join of two), so the native feature blocks run unchanged on the whole given
tables. The expressions are the same text in Spark and in the checking SQL, but
for the day difference, which the two spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER_ANCHOR = "2002-01-01"
EVENT_ANCHOR = "2024-02-01"


def spark_days(later: str, earlier: str) -> str:
    return f"datediff(CAST({later} AS DATE), CAST({earlier} AS DATE))"


def sql_days(later: str, earlier: str) -> str:
    return f"CAST(date_diff('day', CAST({earlier} AS DATE), CAST({later} AS DATE)) AS INTEGER)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _flags(names: str, key: str, first: int) -> dict[str, str]:
    return {n: f"CASE WHEN ({key} * {first + i}) % {i + 3} = 0 THEN 1 ELSE 0 END" for i, n in enumerate(names.split())}


def application(days) -> dict[str, str]:
    k, a = "c_custkey", "abs(c_acctbal)"
    share = "CAST(({k} * {m}) % 1000 AS DOUBLE) / 1000"
    return {
        "SK_ID_CURR": k,
        "CODE_GENDER": f"CASE WHEN {k} % 50 = 0 THEN 'XNA' WHEN {k} % 2 = 0 THEN 'F' ELSE 'M' END",
        "NAME_FAMILY_STATUS": f"CASE WHEN {k} % 40 = 3 THEN 'Unknown' ELSE c_mktsegment END",
        "ORGANIZATION_TYPE": "CASE WHEN c_nationkey = 0 THEN 'XNA' ELSE n_name END",
        "FLAG_OWN_CAR": f"CASE WHEN {k} % 3 = 0 THEN 'Y' ELSE 'N' END",
        "FLAG_OWN_REALTY": f"CASE WHEN {k} % 4 = 1 THEN 'Y' ELSE 'N' END",
        "DAYS_BIRTH": f"-(7500 + ({k} * 37) % 17000)",
        "DAYS_EMPLOYED": f"CASE WHEN {k} % 11 = 0 THEN 365243 ELSE -(({k} * 97) % 9000) END",
        "DAYS_ID_PUBLISH": f"-(({k} * 53) % 6000)",
        "DAYS_REGISTRATION": f"CAST(-(({k} * 61) % 15000) AS DOUBLE)",
        "DAYS_LAST_PHONE_CHANGE": f"-(({k} * 29) % 300)",
        "CNT_CHILDREN": f"({k} * 7) % 4",
        "CNT_FAM_MEMBERS": f"CASE WHEN {k} % 101 = 0 THEN NULL ELSE CAST(({k} * 7) % 4 + {k} % 3 AS DOUBLE) END",
        "AMT_INCOME_TOTAL": f"{a} * 12",
        "AMT_CREDIT": f"{a} * 40 + 1000",
        "AMT_ANNUITY": f"CASE WHEN {k} % 17 = 0 THEN NULL ELSE {a} * 2 + 100 END",
        "AMT_GOODS_PRICE": f"CASE WHEN {k} % 19 = 0 THEN NULL ELSE {a} * 36 END",
        "EXT_SOURCE_1": f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE {share.format(k=k, m=37)} END",
        "EXT_SOURCE_2": f"CASE WHEN {k} % 15 = 0 THEN NULL ELSE {share.format(k=k, m=71)} END",
        "EXT_SOURCE_3": f"CASE WHEN {k} % 6 = 0 THEN NULL ELSE {share.format(k=k, m=113)} END",
        "REGION_POPULATION_RELATIVE": f"CAST(c_nationkey AS DOUBLE) / 1000",
        "TOTALAREA_MODE": f"CASE WHEN {k} % 2 = 0 THEN NULL ELSE {share.format(k=k, m=13)} END",
        "BASEMENTAREA_AVG": f"CASE WHEN {k} % 2 = 1 THEN NULL ELSE {share.format(k=k, m=17)} END",
        "LIVINGAREA_MODE": share.format(k=k, m=19),
        "LANDAREA_MODE": share.format(k=k, m=23),
        "NONLIVINGAREA_AVG": share.format(k=k, m=29),
        "YEARS_BEGINEXPLUATATION_AVG": share.format(k=k, m=31),
        "OWN_CAR_AGE": f"CASE WHEN {k} % 3 = 0 THEN CAST({k} % 25 AS DOUBLE) ELSE NULL END",
        "OBS_60_CNT_SOCIAL_CIRCLE": f"CAST({k} % 9 AS DOUBLE)",
        "AMT_REQ_CREDIT_BUREAU_YEAR": f"CASE WHEN {k} % 8 = 0 THEN NULL ELSE CAST({k} % 7 AS DOUBLE) END",
        **_flags(" ".join(f"FLAG_DOCUMENT_{i}" for i in range(2, 22)), k, 2),
        **_flags("FLAG_MOBIL FLAG_EMP_PHONE FLAG_WORK_PHONE FLAG_CONT_MOBILE FLAG_PHONE FLAG_EMAIL", k, 5),
        **_flags(
            "REG_REGION_NOT_LIVE_REGION REG_REGION_NOT_WORK_REGION LIVE_REGION_NOT_WORK_REGION "
            "REG_CITY_NOT_LIVE_CITY REG_CITY_NOT_WORK_CITY LIVE_CITY_NOT_WORK_CITY",
            k,
            11,
        ),
        "TARGET": f"CASE WHEN c_acctbal < 0 OR {k} % 13 = 0 THEN 1 ELSE 0 END",
    }


APPLICATION_FROM = "customer JOIN nation ON c_nationkey = n_nationkey"
IS_TRAIN = "c_custkey % 5 <> 4"


def bureau(days) -> dict[str, str]:
    k, d, p = "o_orderkey", days("o_orderdate", f"DATE '{ORDER_ANCHOR}'"), "o_totalprice"
    return {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_BUREAU": k,
        "CREDIT_ACTIVE": "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE NULL END",
        "CREDIT_TYPE": "o_orderpriority",
        "DAYS_CREDIT": d,
        "DAYS_CREDIT_UPDATE": f"CASE WHEN {k} % 23 = 0 THEN -41000 ELSE {d} + {k} % 300 END",
        "DAYS_CREDIT_ENDDATE": f"CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 29 = 0 THEN -42000 "
        f"ELSE CAST({d} + ({k} * 31) % 3000 AS DOUBLE) END",
        "DAYS_ENDDATE_FACT": f"CASE WHEN {k} % 2 = 0 THEN NULL ELSE CAST({d} AS DOUBLE) END",
        "CREDIT_DAY_OVERDUE": f"({k} % 3) * ({k} % 5)",
        "CNT_CREDIT_PROLONG": f"{k} % 4",
        "AMT_CREDIT_SUM": p,
        "AMT_CREDIT_SUM_DEBT": f"CASE WHEN {k} % 6 = 0 THEN NULL WHEN {k} % 2 = 0 THEN 0 ELSE {p} / 4 END",
        "AMT_CREDIT_SUM_LIMIT": f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE {p} / 2 END",
        "AMT_CREDIT_SUM_OVERDUE": f"CASE WHEN {k} % 9 = 0 THEN {p} / 8 ELSE 0 END",
        "AMT_CREDIT_MAX_OVERDUE": f"CASE WHEN {k} % 4 = 0 THEN NULL ELSE {p} / 16 END",
    }


def previous(days) -> dict[str, str]:
    k, d, p = "o_orderkey", days("o_orderdate", f"DATE '{ORDER_ANCHOR}'"), "o_totalprice"
    return {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_PREV": k,
        "NAME_CONTRACT_STATUS": "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'P' THEN 'Refused' ELSE 'Canceled' END",
        "NAME_CONTRACT_TYPE": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Revolving loans' ELSE 'Cash loans' END",
        "DAYS_DECISION": d,
        "HOUR_APPR_PROCESS_START": f"{k} % 24",
        "AMT_ANNUITY": f"{p} / 16",
        "AMT_APPLICATION": p,
        "AMT_CREDIT": f"CASE WHEN {k} % 31 = 0 THEN 0 ELSE {p} / 8 * 7 END",
        "AMT_DOWN_PAYMENT": f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE {p} / 32 END",
        "AMT_GOODS_PRICE": f"CASE WHEN {k} % 10 = 0 THEN NULL ELSE {p} END",
        "RATE_DOWN_PAYMENT": f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE CAST({k} % 40 AS DOUBLE) / 100 END",
        "CNT_PAYMENT": f"CASE WHEN {k} % 13 = 0 THEN NULL ELSE CAST(6 * ({k} % 8 + 1) AS DOUBLE) END",
        "DAYS_FIRST_DRAWING": f"CASE WHEN {k} % 2 = 0 THEN 365243 ELSE CAST({d} + 10 AS DOUBLE) END",
        "DAYS_FIRST_DUE": f"CASE WHEN {k} % 5 = 0 THEN 365243 ELSE CAST({d} + 30 AS DOUBLE) END",
        "DAYS_LAST_DUE_1ST_VERSION": f"CASE WHEN {k} % 4 = 0 THEN 365243 ELSE CAST({d} + 300 AS DOUBLE) END",
        "DAYS_LAST_DUE": f"CASE WHEN {k} % 4 = 0 THEN 365243 ELSE CAST({d} + 320 AS DOUBLE) END",
        "DAYS_TERMINATION": f"CASE WHEN {k} % 4 = 0 THEN 365243 ELSE CAST({d} + 330 AS DOUBLE) END",
    }


def installments(days) -> dict[str, str]:
    d = days("l_shipdate", f"DATE '{ORDER_ANCHOR}'")
    unpaid = "l_partkey % 97 = 0"
    return {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_PREV": "l_orderkey",
        "NUM_INSTALMENT_VERSION": "CAST(l_linenumber AS DOUBLE)",
        "NUM_INSTALMENT_NUMBER": "l_linenumber",
        "DAYS_INSTALMENT": f"CAST({d} AS DOUBLE)",
        "DAYS_ENTRY_PAYMENT": f"CASE WHEN {unpaid} THEN NULL "
        f"ELSE CAST({d} + {days('l_shipdate', 'o_orderdate')} - 60 AS DOUBLE) END",
        "AMT_INSTALMENT": "l_extendedprice",
        "AMT_PAYMENT": f"CASE WHEN {unpaid} THEN NULL WHEN l_suppkey % 10 = 0 THEN l_extendedprice + 10 "
        "ELSE l_extendedprice * (1 - l_discount) END",
        "l_partkey": "l_partkey",
        "l_suppkey": "l_suppkey",
    }


INSTALLMENTS_FROM = "lineitem JOIN orders ON l_orderkey = o_orderkey"
INSTALLMENT_TIES = ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "l_partkey", "l_suppkey"]


def pos(days) -> dict[str, str]:
    k = "event_id"
    return {
        "SK_ID_CURR": "user_id",
        "SK_ID_PREV": f"{k} % 7",
        "MONTHS_BALANCE": days("ts", f"DATE '{EVENT_ANCHOR}'"),
        "NAME_CONTRACT_STATUS": "CASE event_type WHEN 'click' THEN 'Active' WHEN 'purchase' THEN 'Completed' "
        "WHEN 'signup' THEN 'Signed' WHEN 'view' THEN 'Demand' ELSE 'Returned to the store' END",
        "SK_DPD": "CAST(greatest(floor(value) - 60, 0) AS INTEGER)",
        "SK_DPD_DEF": "CAST(greatest(floor(value) - 120, 0) AS INTEGER)",
        "CNT_INSTALMENT": f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE CAST({k} % 36 AS DOUBLE) END",
        "CNT_INSTALMENT_FUTURE": f"CASE WHEN {k} % 50 = 0 THEN NULL ELSE CAST({k} % 24 AS DOUBLE) END",
        "event_id": k,
    }


POS_STATUSES = ["Active", "Completed", "Demand", "Returned to the store", "Signed"]


def credit_card(days) -> dict[str, str]:
    k = "event_id"
    return {
        "SK_ID_CURR": "user_id",
        "SK_ID_PREV": f"{k} % 7",
        "MONTHS_BALANCE": days("ts", f"DATE '{EVENT_ANCHOR}'"),
        "SK_DPD": "CAST(greatest(floor(value) - 60, 0) AS INTEGER)",
        "AMT_CREDIT_LIMIT_ACTUAL": f"1000 * ({k} % 4)",
        "CNT_INSTALMENT_MATURE_CUM": f"CASE WHEN {k} % 20 = 0 THEN NULL ELSE CAST({k} % 30 AS DOUBLE) END",
        "AMT_BALANCE": f"CASE WHEN {k} % 33 = 0 THEN NULL ELSE value END",
        "AMT_DRAWINGS_ATM_CURRENT": "value - 5",
        "AMT_DRAWINGS_CURRENT": "value * 2 - 8",
        "CNT_DRAWINGS_ATM_CURRENT": f"CASE WHEN {k} % 6 = 0 THEN NULL ELSE CAST({k} % 5 AS DOUBLE) END",
        "CNT_DRAWINGS_CURRENT": f"CAST({k} % 9 AS DOUBLE)",
        "AMT_PAYMENT_CURRENT": f"CASE WHEN {k} % 4 = 0 THEN NULL ELSE value / 2 END",
        "event_id": k,
    }


def documents(days) -> dict[str, str]:
    """The labelled table of the learners: quality as label, counts over the whole text."""

    def marks(ch):
        return f"CAST(length(text) - length(replace(text, '{ch}', '')) AS DOUBLE)"

    return {
        "SK_ID_CURR": "documents.doc_id",
        "TARGET": "CAST(quality AS DOUBLE)",
        "N_CHARS": "CAST(n_chars AS DOUBLE)",
        "LANG": "lang",
        "SOURCE": "source",
        "N_SPACES": marks(" "),
        "N_STOPS": marks("."),
        "N_COMMAS": marks(","),
        "N_E": marks("e"),
        "N_ONES": marks("1"),
    }


DOCUMENTS_FROM = "documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"


def select_sql(columns: dict[str, str], source: str, where: str | None = None) -> str:
    picks = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"SELECT {picks} FROM {source}" + (f" WHERE {where}" if where else "")


def _frame(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()])


class Native:
    """The native tables over one data folder."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    def applications(self) -> tuple[DataFrame, DataFrame]:
        rows = self.raw("customer").join(self.raw("nation"), on=_on("c_nationkey", "n_nationkey"))
        columns = application(spark_days)
        train = _frame(rows.filter(IS_TRAIN), columns)
        test = _frame(rows.filter(f"NOT ({IS_TRAIN})"), {c: e for c, e in columns.items() if c != "TARGET"})
        return train, test

    def bureau(self) -> DataFrame:
        return _frame(self.raw("orders"), bureau(spark_days))

    def previous(self) -> DataFrame:
        return _frame(self.raw("orders"), previous(spark_days))

    def installments(self) -> DataFrame:
        rows = self.raw("lineitem").join(self.raw("orders"), on=_on("l_orderkey", "o_orderkey"))
        return _frame(rows, installments(spark_days))

    def pos(self) -> DataFrame:
        return _frame(self.raw("events"), pos(spark_days))

    def credit_card(self) -> DataFrame:
        return _frame(self.raw("events"), credit_card(spark_days))

    def documents(self) -> DataFrame:
        """Texts are reduced to their counts before the join, so that no text is exchanged."""
        columns = documents(spark_days)
        counted = {n: e for n, e in columns.items() if n not in ("SK_ID_CURR", "TARGET")}
        rows = _frame(self.raw("documents"), {"doc_id": "doc_id", **counted}).join(self.raw("labels"), on="doc_id", how="left")
        return _frame(rows, {n: {"SK_ID_CURR": "doc_id", "TARGET": columns["TARGET"]}.get(n, f"`{n}`") for n in columns})


def _on(left: str, right: str):
    from pyspark.sql import functions as F

    return F.col(left) == F.col(right)


# The same tables as SQL text.
BUREAU_SQL = select_sql(bureau(sql_days), "orders")
PREVIOUS_SQL = select_sql(previous(sql_days), "orders")
INSTALLMENTS_SQL = select_sql(installments(sql_days), INSTALLMENTS_FROM)
POS_SQL = select_sql(pos(sql_days), "events")
CREDIT_CARD_SQL = select_sql(credit_card(sql_days), "events")
DOCUMENTS_SQL = select_sql(documents(sql_days), DOCUMENTS_FROM)
_APP = application(sql_days)
APPLICATION_SQL = (
    select_sql({**_APP, "TARGET": f"CASE WHEN {IS_TRAIN} THEN {_APP['TARGET']} ELSE NULL END"}, APPLICATION_FROM)
)
