"""Weight of evidence, AUC, profiles, folds and blends over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import stack
from ..operators import evaluate, profile, scorecard
from ..session import cut_lineage
from . import standin as st
from .blocks import APP_KINDS, WIDE_KINDS, WIDE_SQL, native_wide
from .encoding import NUMBERS, _width_sql
from .registry import query, shaped, shaped_sql
from .standin import table


def binned_sql(source: str, numbers, strings) -> str:
    """(id, TARGET, feature, bin): equal-width bins above 20 distinct values, one bin per value otherwise."""
    numeric = " UNION ALL ".join(
        f"SELECT SK_ID_CURR, TARGET, '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS x FROM src" for c in numbers
    )
    text = " UNION ALL ".join(f"SELECT SK_ID_CURR, TARGET, '{c}' AS feature, \"{c}\" AS x FROM src" for c in strings)
    rank = "dense_rank() OVER (PARTITION BY feature ORDER BY x NULLS LAST)"
    return f"""
    WITH src AS MATERIALIZED ({source}), cells AS MATERIALIZED ({numeric}),
    facts AS MATERIALIZED (SELECT feature, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS n FROM cells GROUP BY 1)
    SELECT SK_ID_CURR, TARGET, c.feature, CASE WHEN x IS NULL THEN -1 WHEN n > 20 THEN {_width_sql('x', 'lo', 'hi')} ELSE rk END AS bin
    FROM (SELECT *, {rank} AS rk FROM cells) c JOIN facts f ON c.feature = f.feature
    UNION ALL
    SELECT SK_ID_CURR, TARGET, feature, CASE WHEN x IS NULL THEN -1 ELSE {rank} END AS bin FROM ({text})
    """


def woe_sql(binned: str) -> str:
    return f"""
    SELECT feature, bin, count(*) FILTER (WHERE TARGET = 0) AS good, count(*) FILTER (WHERE TARGET = 1) AS bad,
      CASE WHEN bin = -1 THEN 0 ELSE round(ln(greatest(count(*) FILTER (WHERE TARGET = 0) / any_value(g), 1e-100)
        / greatest(count(*) FILTER (WHERE TARGET = 1) / any_value(b), 1e-100)), 5) END AS woe
    FROM ({binned}), (SELECT count(*) FILTER (WHERE TARGET = 0) AS g, count(*) FILTER (WHERE TARGET = 1) AS b
                      FROM (SELECT DISTINCT SK_ID_CURR, TARGET FROM ({binned})))
    GROUP BY feature, bin
    """


STRINGS = ["LANG", "SOURCE"]
DOCS_BINNED = binned_sql(st.DOCUMENTS_SQL, NUMBERS, STRINGS)


def _binned(spark, sf):
    docs = cut_lineage(st.Native(spark, sf).documents())
    bins, sizes = scorecard.bin_columns(docs, [*NUMBERS, *STRINGS])
    return scorecard.with_bins(docs, bins, ["SK_ID_CURR", "TARGET"]), sizes


@query("weight_of_evidence", "feature:str bin,good,bad:int woe:num", woe_sql(DOCS_BINNED))
def _woe(spark, sf):
    binned, sizes = _binned(spark, sf)
    return scorecard.woe_table(binned, list(sizes))


@query("weight_of_evidence_encoding", {"SK_ID_CURR": "int", **{c: "num" for c in [*NUMBERS, *STRINGS]}},
       "SELECT SK_ID_CURR, " + ", ".join(f"max(woe) FILTER (WHERE b.feature = '{c}') AS \"{c}\"" for c in [*NUMBERS, *STRINGS])
       + f" FROM ({DOCS_BINNED}) b JOIN ({woe_sql(DOCS_BINNED)}) w ON b.feature = w.feature AND b.bin = w.bin GROUP BY 1")
def _encoding(spark, sf):
    return scorecard.woe_encode(cut_lineage(st.Native(spark, sf).documents()))


_OUT_OF_FOLD_SQL = f"""
WITH bins AS MATERIALIZED ({DOCS_BINNED}),
parts AS (SELECT SK_ID_CURR, (row_number() OVER (PARTITION BY TARGET ORDER BY md5(concat_ws('|', CAST(SK_ID_CURR AS VARCHAR), '1')),
          SK_ID_CURR) - 1) % 5 AS fold FROM (SELECT DISTINCT SK_ID_CURR, TARGET FROM bins WHERE TARGET IS NOT NULL)),
cells AS (SELECT b.*, coalesce(fold, -1) AS fold FROM bins b LEFT JOIN parts p ON b.SK_ID_CURR = p.SK_ID_CURR),
shares AS (
  SELECT f, feature, bin, count(*) FILTER (WHERE TARGET = 0) AS good, count(*) FILTER (WHERE TARGET = 1) AS bad
  FROM cells, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f) WHERE fold <> f OR f = -1 GROUP BY ALL),
weights AS (
  SELECT f, feature, bin, CASE WHEN bin = -1 THEN 0 ELSE round(ln(greatest(good / sum(good) OVER (PARTITION BY f, feature), 1e-100)
    / greatest(bad / sum(bad) OVER (PARTITION BY f, feature), 1e-100)), 5) END AS woe FROM shares)
SELECT SK_ID_CURR, {", ".join(f"coalesce(max(woe) FILTER (WHERE c.feature = '{c}'), 0) AS \"{c}\"" for c in [*NUMBERS, *STRINGS])}
FROM cells c LEFT JOIN weights w ON c.feature = w.feature AND c.bin = w.bin AND c.fold = w.f GROUP BY 1
"""


@query("weight_of_evidence_out_of_fold", {"SK_ID_CURR": "int", **{c: "num" for c in [*NUMBERS, *STRINGS]}}, _OUT_OF_FOLD_SQL)
def _out_of_fold(spark, sf):
    return scorecard.woe_encode_out_of_fold(cut_lineage(st.Native(spark, sf).documents()))


@query("scores_by_table_prefix", "SK_ID_CURR:int WOE_SCORE_B,WOE_SCORE_CC,WOE_SCORE_TR_TE,WOE_SCORE_ALL_BUT_TR_TE:num",
       "SELECT SK_ID_CURR, sum(woe) FILTER (WHERE b.feature IN ('N_CHARS', 'N_SPACES')) AS \"WOE_SCORE_B\", "
       "sum(woe) FILTER (WHERE b.feature = 'N_E') AS \"WOE_SCORE_CC\", "
       "sum(woe) FILTER (WHERE b.feature NOT IN ('N_CHARS', 'N_SPACES', 'N_E')) AS \"WOE_SCORE_TR_TE\", "
       "sum(woe) FILTER (WHERE b.feature IN ('N_CHARS', 'N_SPACES', 'N_E')) AS \"WOE_SCORE_ALL_BUT_TR_TE\" "
       f"FROM ({DOCS_BINNED}) b JOIN ({woe_sql(DOCS_BINNED)}) w ON b.feature = w.feature AND b.bin = w.bin GROUP BY 1")  # fmt: skip
def _scores(spark, sf):
    names = {"N_CHARS": "B_N_CHARS", "N_SPACES": "B_N_SPACES", "N_E": "CC_N_E"}
    return scorecard.scorecard(cut_lineage(st.Native(spark, sf).documents().withColumnsRenamed(names)))


@query("continuous_or_categorical", "column,kind:str",
       " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) > 20 THEN 'continuous' ELSE 'categorical' END AS kind "
                          f"FROM ({st.DOCUMENTS_SQL})" for c in [*NUMBERS, *STRINGS]))  # fmt: skip
def _kinds(spark, sf):
    many, few = scorecard.split_by_distinct(st.Native(spark, sf).documents(), [*NUMBERS, *STRINGS])
    rows = [(c, "continuous") for c in many] + [(c, "categorical") for c in few]
    return spark.createDataFrame(rows, "column string, kind string")


WIDE_SOURCE = shaped_sql(WIDE_SQL, WIDE_KINDS)
WIDE_STRINGS = [c for c, k in APP_KINDS.items() if k == "str"]
WIDE_NUMBERS = [c for c in WIDE_KINDS if c not in ("SK_ID_CURR", "TARGET", *WIDE_STRINGS)]
_HEADS = {"B": "B", "CC": "CC", "IP": "IP", "PA": "PA", "POS": "POS"}
_OF = "regexp_extract(b.feature, '^(B|CC|IP|PA|POS)_', 1)"


@query("wide_scorecard",
       "SK_ID_CURR:int WOE_SCORE_B,WOE_SCORE_CC,WOE_SCORE_IP,WOE_SCORE_PA,WOE_SCORE_POS,WOE_SCORE_ALL_BUT_TR_TE,WOE_SCORE_TR_TE:num",
       f"WITH bins AS MATERIALIZED ({binned_sql(WIDE_SOURCE, WIDE_NUMBERS, WIDE_STRINGS)}) SELECT SK_ID_CURR, "
       + ", ".join(f"sum(woe) FILTER (WHERE {_OF} = '{h}') AS \"WOE_SCORE_{n}\"" for n, h in _HEADS.items())
       + f", sum(woe) FILTER (WHERE {_OF} <> '') AS \"WOE_SCORE_ALL_BUT_TR_TE\", sum(woe) FILTER (WHERE {_OF} = '') AS \"WOE_SCORE_TR_TE\" "
       f"FROM bins b JOIN ({woe_sql('SELECT * FROM bins')}) w ON b.feature = w.feature AND b.bin = w.bin GROUP BY 1")  # fmt: skip
def _wide_scorecard(spark, sf):
    # The wide table is written once; the scorecard reads it several times.
    return scorecard.scorecard(cut_lineage(shaped(native_wide(spark, sf), WIDE_KINDS)))


FIXED_SCORE = "CAST((doc_id * 37 + quality * 11) % 101 AS DOUBLE) / 101"


def _scored(spark, sf):
    return table(spark, sf, "labels").selectExpr("doc_id", "quality", "toxic", f"{FIXED_SCORE} AS score")


def auc_sql(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"SELECT {keys}(sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2) "
        "/ nullif(count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0), 0) AS auc FROM "
        f"(SELECT *, rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2 AS r FROM ({source})) "
        + (f"GROUP BY {by}" if by else "")
    )


_SCORED_SQL = f"SELECT *, {FIXED_SCORE} AS score FROM labels"


@query("roc_auc", "auc:num", auc_sql(_SCORED_SQL))
def _auc(spark, sf):
    return evaluate.roc_auc(_scored(spark, sf), "quality", "score")


@query("roc_auc_per_group", "toxic:int auc:num", auc_sql(_SCORED_SQL, "toxic"))
def _auc_group(spark, sf):
    return evaluate.roc_auc(_scored(spark, sf), "quality", "score", by=["toxic"])


FOLDED_SQL = (
    f"SELECT *, (row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '1')), doc_id) - 1) % 5 AS fold "
    f"FROM ({_SCORED_SQL})"
)


@query("stratified_folds", "doc_id,quality,fold:int", FOLDED_SQL)
def _folds(spark, sf):
    return evaluate.stratified_folds(table(spark, sf, "labels"), "doc_id", "quality")


@query("cross_validated_score", "mean_auc,std_auc:num",
       f"SELECT avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc FROM ({auc_sql(FOLDED_SQL, 'fold')})")
def _cv(spark, sf):
    folded = evaluate.stratified_folds(_scored(spark, sf), "doc_id", "quality")
    return stack.fold_summary(evaluate.roc_auc(folded, "quality", "score", by=["fold"]))


_PROFILED = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query("column_profile", "column,dtype,min,max:str nunique,count,isnull_sum:int",
       " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(min({c}) AS VARCHAR) AS \"min\", CAST(max({c}) AS VARCHAR) AS \"max\", "
           f"count(DISTINCT {c}) AS nunique, count({c}) AS \"count\", count(*) - count({c}) AS isnull_sum FROM customer"
           for c, t in _PROFILED.items()))
def _profile(spark, sf):
    return profile.column_profile(table(spark, sf, "customer"), list(_PROFILED))


@query("transposed_head", "column,row_1,row_2:str",
       " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", max(CAST({c} AS VARCHAR)) FILTER (WHERE n = 1) AS row_1, max(CAST({c} AS VARCHAR)) FILTER (WHERE n = 2) AS row_2 "
           "FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer)"
           for c in _PROFILED))
def _head(spark, sf):
    customer = table(spark, sf, "customer").select(*_PROFILED)
    return profile.transposed_head(customer, [F.desc("c_acctbal"), F.asc("c_custkey")], 2)


_MODELS = {"first": "CAST(doc_id % 7 AS DOUBLE) / 7", "second": "CAST(doc_id % 11 AS DOUBLE) / 11", "third": "CAST(n_chars % 13 AS DOUBLE) / 13"}


def _score_tables(spark, sf):
    docs = table(spark, sf, "documents")
    return {m: docs.selectExpr("doc_id AS SK_ID_CURR", f"{e} AS {m}") for m, e in _MODELS.items()}


@query("stacking_table", "SK_ID_CURR:int first,second,third:num",
       "SELECT doc_id AS SK_ID_CURR, " + ", ".join(f'{e} AS "{m}"' for m, e in _MODELS.items()) + " FROM documents")
def _stack(spark, sf):
    return stack.stacking_table(list(_score_tables(spark, sf).values()))


@query("weighted_blend", "SK_ID_CURR:int TARGET:num",
       f"SELECT doc_id AS SK_ID_CURR, 0.5 * ({_MODELS['first']}) + 0.3 * ({_MODELS['second']}) + 0.2 * ({_MODELS['third']}) AS \"TARGET\" FROM documents")
def _blend(spark, sf):
    return stack.blend(_score_tables(spark, sf), {"first": 0.5, "second": 0.3, "third": 0.2})
