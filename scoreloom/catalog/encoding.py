"""Binning, encoding, scaling and preparation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, scaling
from ..operators.binning import edge_bin, equal_width_bin, quantile_bin
from ..operators.profile import collect_stats
from ..session import cut_lineage
from . import standin as st
from .registry import query
from .sqltext import picks
from .standin import table

NUMBERS = ["N_CHARS", "N_SPACES", "N_STOPS", "N_COMMAS", "N_E", "N_ONES"]
LINE_KEY = "l_orderkey,l_linenumber,l_partkey,l_suppkey"
EDGES = [0, 5, 10, 20, 35, 50]


@query("explicit_edge_bins", f"{LINE_KEY},bin:int",
       f"SELECT {LINE_KEY}, CASE WHEN l_quantity <= 0 THEN NULL "
       + " ".join(f"WHEN l_quantity <= {hi} THEN {i}" for i, hi in enumerate(EDGES[1:])) + " END AS bin FROM lineitem")
def _edges(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_KEY.split(","), edge_bin(F.col("l_quantity"), EDGES).alias("bin"))


def _width_sql(x: str, low: str, high: str) -> str:
    return "1 + " + " + ".join(f"CAST({x} > {low} + {i} * (({high} - {low}) / 20) AS INTEGER)" for i in range(1, 20))


@query("equal_width_bins", "o_orderkey,bin:int",
       f"SELECT o_orderkey, {_width_sql('o_totalprice', 'lo', 'hi')} AS bin FROM orders, "
       "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")  # fmt: skip
def _width(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    s = collect_stats(orders, ["o_totalprice"])
    bins = equal_width_bin("o_totalprice", s.low["o_totalprice"], s.high["o_totalprice"])
    return orders.select("o_orderkey", bins.alias("bin"))


@query("quantile_bins", "o_orderkey,bin:int",
       "SELECT o_orderkey, 1 + " + " + ".join(f"CAST(o_totalprice > e[{i}] AS INTEGER)" for i in range(1, 20))
       + " AS bin FROM orders, (SELECT quantile_cont(o_totalprice, ["
       + ", ".join(str(i / 20) for i in range(1, 20)) + "]) AS e FROM orders)")
def _quantile(spark, sf):
    return quantile_bin(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "bin")


@query("label_encoding", "SK_ID_BUREAU,CREDIT_ACTIVE,CREDIT_TYPE:int",
       "SELECT SK_ID_BUREAU, CASE WHEN CREDIT_ACTIVE IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY CREDIT_ACTIVE NULLS LAST) - 1 END "
       "AS \"CREDIT_ACTIVE\", dense_rank() OVER (ORDER BY CREDIT_TYPE) - 1 AS \"CREDIT_TYPE\" "
       f"FROM ({st.BUREAU_SQL})")  # fmt: skip
def _label(spark, sf):
    return encode.label_encode(st.Native(spark, sf).bureau().select("SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE"))


@query("label_encoding_many_values", "c_custkey,c_name:int",
       "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer")
def _label_many(spark, sf):
    return encode.label_encode(table(spark, sf, "customer").select("c_custkey", "c_name"))


@query("label_encoding_by_cardinality", f"{LINE_KEY},l_linestatus_is_text:int l_returnflag:str",
       f"SELECT l_orderkey, dense_rank() OVER (ORDER BY l_linenumber) - 1 AS l_linenumber, l_partkey, l_suppkey, l_returnflag, "
       "CASE WHEN l_linestatus IN ('O', 'F') THEN 1 ELSE 0 END AS l_linestatus_is_text FROM lineitem")  # fmt: skip
def _label_few(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE_KEY.split(","), "l_returnflag", "l_linestatus")
    out = encode.label_encode_few(df, skip=("l_orderkey", "l_partkey", "l_suppkey"))
    return out.withColumn("l_linestatus_is_text", F.col("l_linestatus").isin("O", "F").cast("int"))


@query("one_hot_encoding", "SK_ID_CURR,LANG_de,LANG_en,LANG_es,LANG_fr,LANG_nan:int",
       "SELECT SK_ID_CURR, " + ", ".join(f"CASE WHEN LANG = '{v}' THEN 1 ELSE 0 END AS \"LANG_{v}\"" for v in ("de", "en", "es", "fr"))
       + f", CASE WHEN LANG IS NULL THEN 1 ELSE 0 END AS \"LANG_nan\" FROM ({st.DOCUMENTS_SQL})")
def _one_hot(spark, sf):
    docs = st.Native(spark, sf).documents().select("SK_ID_CURR", "LANG")
    return encode.one_hot_encode(docs, nan_as_category=True, exclude=["SK_ID_CURR"])


@query("categorical_hints", "column:str",
       'SELECT * FROM (SELECT \'l_linenumber\' AS "column", count(DISTINCT l_linenumber) AS n FROM lineitem UNION ALL '
       "SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) "
       "FROM lineitem) WHERE n <= 20")  # fmt: skip
def _hints(spark, sf):
    df = table(spark, sf, "lineitem")
    found = encode.categorical_hints(df, ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity"])
    return spark.createDataFrame([(c,) for c in found], "column string")


APP_NUMBERS = ["EXT_SOURCE_1", "AMT_ANNUITY", "AMT_GOODS_PRICE", "OWN_CAR_AGE"]
_APP_STATS = ", ".join(f"avg({c}) AS m_{c}, min({c}) AS l_{c}, max({c}) AS h_{c}" for c in APP_NUMBERS)
_APP_SOURCE = f"(SELECT *, 0 AS flat FROM ({st.APPLICATION_SQL})), (SELECT {_APP_STATS} FROM ({st.APPLICATION_SQL}))"
_APP_KINDS = {"SK_ID_CURR": "int", **{c: "num" for c in APP_NUMBERS}}


def _scaled_sql(form: str) -> str:
    cols = {c: form.format(x=f"coalesce({c}, m_{c})", m=f"m_{c}", l=f"l_{c}", h=f"h_{c}") for c in APP_NUMBERS}
    return f"SELECT SK_ID_CURR, {picks(cols)} FROM {_APP_SOURCE}"


def _clients(spark, sf):
    train, test = st.Native(spark, sf).applications()
    return train.select("SK_ID_CURR", "TARGET", *APP_NUMBERS).unionByName(
        test.select("SK_ID_CURR", F.lit(None).cast("int").alias("TARGET"), *APP_NUMBERS)
    )


@query("mean_imputation", _APP_KINDS, _scaled_sql("{x}"))
def _fill(spark, sf):
    return scaling.fill_mean(_clients(spark, sf))


@query("min_max_scaling", _APP_KINDS | {"flat": "num"},
       _scaled_sql("({x} - {l}) / nullif({h} - {l}, 0)").replace("SELECT SK_ID_CURR,", "SELECT SK_ID_CURR, CAST(NULL AS DOUBLE) AS flat,", 1))
def _min_max(spark, sf):
    return scaling.min_max_scale(_clients(spark, sf).withColumn("flat", F.lit(0)))


@query("mean_range_scaling", _APP_KINDS, _scaled_sql("({x} - {m}) / nullif({h} - {l}, 0)"))
def _norm(spark, sf):
    return scaling.norm_scale(_clients(spark, sf))


@query("log_plus_one", "c_custkey:int c_acctbal:num",
       "SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN ln(c_acctbal + 1) END AS c_acctbal FROM customer")
def _log(spark, sf):
    return scaling.log_plus_one(table(spark, sf, "customer"), ["c_acctbal"])


@query("standardisation", {"SK_ID_CURR": "int", **{c: "flat" for c in NUMBERS}},
       "SELECT SK_ID_CURR, " + ", ".join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS "{c}"' for c in NUMBERS)
       + f" FROM ({st.DOCUMENTS_SQL})")
def _standard(spark, sf):
    return scaling.standardise(st.Native(spark, sf).documents(), NUMBERS)


_PREPARED = {c: f"ln(1 + ({c} - avg({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()))" for c in NUMBERS}
_PREPARED |= {c: f"ln(dense_rank() OVER (ORDER BY {c}))" for c in ("LANG", "SOURCE")}


# a text column with missing values gets the code -1, whose logarithm is infinite, so it is dropped
@query("model_preparation", {"SK_ID_CURR": "int", "TARGET": "int", **{c: "flat" for c in _PREPARED}, "features": "str"},
       f"SELECT SK_ID_CURR, TARGET, {picks(_PREPARED)}, '{','.join(sorted(_PREPARED))}' AS features FROM ({st.DOCUMENTS_SQL})")
def _prepare(spark, sf):
    documents = st.Native(spark, sf).documents().withColumn("LANG_KNOWN", F.expr("nullif(LANG, 'de')"))
    data = scaling.prepare(cut_lineage(documents), "norm", log=True)
    return data.frame.withColumn("features", F.lit(",".join(sorted(data.features))))
