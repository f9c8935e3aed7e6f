"""Learners where their answer is known: the same fits on few columns, beside SQL that finds the optimum or grows the trees itself.

The logistic learners and the sigmoid are convex, so Newton steps of plain aggregates end at the same place. Trees without random
choices are determined by their rows; the SQL adds up cells (model, node, column, value), picks the best cut and moves the rows down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..models import ensembles, learners, stack
from ..models.histograms import Rule
from ..operators.evaluate import stratified_folds
from ..operators.ordered import first_rows
from ..operators.scaling import Prepared
from ..session import cut_lineage
from ..sources import tables as src
from . import standin as st
from .learners import COLUMNS, ID, LABEL
from .registry import query
from .scoring import FOLDED_SQL
from .tables import scratch

# ------------------------------------------- convex fits of two parameters

STEPS = 12
SIZE = "ln(1 + N_CHARS)"


def _newton_sql(rows: str, penalty: str = "0") -> str:
    """Slope and level ``a, b`` with the least mean loss of ``x``, target ``t`` and weight ``w`` plus ``penalty`` a^2 / 2."""
    steps = [f"rows AS MATERIALIZED ({rows})", "s0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)"]
    for k in range(1, STEPS + 1):
        steps.append(
            f"s{k} AS MATERIALIZED (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b "
            "FROM (SELECT a, b, sum(w * (q - t) * x) / sum(w) + p * a AS ga, sum(w * (q - t)) / sum(w) AS gb, sum(w * q * (1 - q) * x * x) / sum(w) + p AS haa, "
            "sum(w * q * (1 - q) * x) / sum(w) AS hab, sum(w * q * (1 - q)) / sum(w) AS hbb FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS q, "
            f"{penalty} AS p FROM rows, s{k - 1}) GROUP BY a, b, p))"
        )
    return "WITH " + ", ".join(steps)


def _fitted_sql(weight: str, penalty: str) -> str:
    rows = f"SELECT {SIZE} AS x, TARGET AS t, {weight} AS w FROM ({st.DOCUMENTS_SQL}) WHERE TARGET IS NOT NULL"
    return f"{_newton_sql(rows, penalty)} SELECT SK_ID_CURR, 1 / (1 + exp(-(a * {SIZE} + b))) AS score FROM ({st.DOCUMENTS_SQL}), s{STEPS}"


def _sized(spark, sf) -> Prepared:
    rows = st.Native(spark, sf).documents().selectExpr(ID, LABEL, f"{SIZE} AS SIZE")
    return Prepared(cut_lineage(rows), ["SIZE"])


_LOW, _HIGH = learners.CLASS_WEIGHTS


@query("logistic_regression_of_one_column", f"{ID}:int score:flat",
       _fitted_sql(f"CASE WHEN TARGET = 1 THEN {_HIGH} ELSE {_LOW} END", f"1 / ({learners.INVERSE_L2} * (SELECT sum(w) FROM rows))"))
def _logistic(spark, sf):
    return learners.logistic_regression(_sized(spark, sf), "score", tol=1e-12)


@query("sgd_logistic_regression_of_one_column", f"{ID}:int score:flat", _fitted_sql("1.0", str(learners.SGD_ALPHA)))
def _sgd(spark, sf):
    return learners.sgd_logistic(_sized(spark, sf), "score", tol=1e-12)


_SMOOTHED = "CASE WHEN TARGET = 1 THEN (p + 1.0) / (p + 2.0) ELSE 1.0 / (n + 2.0) END"


@query("sigmoid_of_margins", f"{ID}:int score:flat",
       _newton_sql(f"SELECT {SIZE} AS x, {_SMOOTHED} AS t, 1.0 AS w FROM ({st.DOCUMENTS_SQL}) d, (SELECT count(*) FILTER (WHERE quality = 1) AS p, "
                   "count(*) FILTER (WHERE quality = 0) AS n FROM documents JOIN labels USING (doc_id)) c WHERE TARGET IS NOT NULL")
       + f" SELECT SK_ID_CURR, 1 / (1 + exp(-(a * {SIZE} + b))) AS score FROM ({st.DOCUMENTS_SQL}), s{STEPS}")
def _sigmoid(spark, sf):
    """The sigmoid that turns margins into probabilities, of one given margin."""
    data = _sized(spark, sf)
    slope, level = learners.sigmoid(data.labelled, "SIZE", LABEL)
    return data.frame.select(ID, (1 / (1 + F.exp(F.col("SIZE") * slope + level))).alias("score"))


# ------------------------------------------------------------------- trees

# Columns of few values: every value has its own bin.
STAIRS = {
    "CHARS": "least(floor(N_CHARS / 512), 60)",
    "STOPS": "least(floor(N_STOPS / 4), 40)",
    "COMMAS": "least(floor(100 * N_COMMAS / (N_CHARS + 1)), 40)",
    "ES": "least(floor(200 * N_E / (N_CHARS + 1)), 60)",
    "ONES": "least(N_ONES, 20)",
}
_PLACES = list(range(len(STAIRS)))
_XS = "[" + ", ".join(f"x{k}" for k in _PLACES) + "]"
_STAIRS_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS x{k}" for k, e in enumerate(STAIRS.values()))


def _stairs(spark, sf) -> Prepared:
    rows = st.Native(spark, sf).documents().selectExpr(ID, LABEL, *[f"CAST({e} AS DOUBLE) AS `{n}`" for n, e in STAIRS.items()])
    return Prepared(cut_lineage(rows), list(STAIRS))


@dataclass
class _Grown:
    """SQL of trees grown one after the other: ``worth`` and ``value`` are functions of the texts of ``g`` and ``h``."""

    depth: int
    worth: object
    value: object
    min_split: int = 2
    min_leaf: int = 1

    def tree(self, tag: str, rows: str) -> list[str]:
        """CTEs for one tree of each model ``i``: ``{tag}`` has each row's ``id, i`` and its leaf's ``value``.

        ``rows`` has ``id, i, g, h, n`` and the columns; ``n`` is 0 for a row that the model doesn't learn from.
        """
        out = [f"{tag}_r0 AS MATERIALIZED (SELECT *, 0 AS node FROM ({rows}))"]
        gain = f"{self.worth('lg', 'lh')} + {self.worth('(ag - lg)', '(ah - lh)')} - {self.worth('ag', 'ah')}"
        here, every = "OVER (PARTITION BY i, node, col ORDER BY v)", "OVER (PARTITION BY i, node, col)"
        for level in range(self.depth):
            r = f"{tag}_r{level}"
            cells = (f"SELECT i, node, col, v, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM (SELECT i, node, g, h, n, unnest({_PLACES}) AS col, unnest({_XS}) AS v "
                     f"FROM {r} WHERE n > 0) GROUP BY 1, 2, 3, 4")  # fmt: skip
            sums = ", ".join(f"sum({c}) {here} AS l{c}, sum({c}) {every} AS a{c}" for c in "ghn")
            out.append(
                f"{tag}_s{level} AS MATERIALIZED (SELECT i, node, col, cut FROM (SELECT *, row_number() OVER (PARTITION BY i, node ORDER BY gain DESC, col, v) AS place FROM "
                f"(SELECT *, {gain} AS gain FROM (SELECT i, node, col, v, {sums} FROM ({cells})) JOIN edges USING (col, v) "
                f"WHERE cut IS NOT NULL AND an >= {self.min_split} AND ln >= {self.min_leaf} AND an - ln >= {self.min_leaf})) WHERE place = 1 AND gain > 1e-12)"
            )
            out.append(
                f"{tag}_r{level + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN s.cut IS NULL THEN r.node WHEN list_extract({_XS}, s.col + 1) > s.cut "
                f"THEN 2 * r.node + 2 ELSE 2 * r.node + 1 END AS node FROM {r} r LEFT JOIN {tag}_s{level} s ON r.i = s.i AND r.node = s.node)"
            )
        leaves = f"SELECT i, node, {self.value('sum(g)', 'sum(h)')} AS value FROM {tag}_r{self.depth} WHERE n > 0 GROUP BY 1, 2"
        out.append(f"{tag} AS MATERIALIZED (SELECT id, r.i, value FROM {tag}_r{self.depth} r JOIN ({leaves}) l ON r.i = l.i AND r.node = l.node)")
        return out


_D = f"""d AS MATERIALIZED (SELECT SK_ID_CURR AS id, TARGET AS y, {_STAIRS_SQL} FROM ({st.DOCUMENTS_SQL})),
edges AS MATERIALIZED (SELECT col, v, (v + lead(v) OVER (PARTITION BY col ORDER BY v)) / 2 AS cut FROM
(SELECT DISTINCT unnest({_PLACES}) AS col, unnest({_XS}) AS v FROM d WHERE y IS NOT NULL))"""


def _share(g: str, h: str) -> str:
    return f"({g} / {h})"


def _entropy(g: str, h: str) -> str:
    def part(p):
        return f"CASE WHEN {p} > 0 THEN ({p}) * log2(greatest({p}, 1e-300)) ELSE 0 END"

    return f"{h} * ({part(f'{g} / {h}')} + {part(f'1 - {g} / {h}')})"


def _gini(g: str, h: str) -> str:
    return f"(-2 * {g} * (1 - {g} / {h}))"


TREE = Rule(depth=4, criterion="entropy", min_split=100)
_KNOWN = "y IS NOT NULL"


def _tree_sql() -> str:
    rows = f"SELECT *, 0 AS i, CASE WHEN {_KNOWN} THEN y ELSE 0 END AS g, CASE WHEN {_KNOWN} THEN 1.0::DOUBLE ELSE 0 END AS h, ({_KNOWN})::INT AS n FROM d"
    steps = [_D, *_Grown(TREE.depth, _entropy, _share, TREE.min_split).tree("t", rows)]
    return f"WITH {', '.join(steps)} SELECT id AS SK_ID_CURR, value AS score FROM t"


@query("decision_tree_on_all_columns", f"{ID}:int score:num", _tree_sql())
def _tree(spark, sf):
    """The entropy tree with the 100-row rule, every node choosing from all columns."""
    return ensembles.decision_tree(_stairs(spark, sf), "score", TREE)


ADA = Rule(depth=2, criterion="gini")
ADA_ROUNDS = 3


def _ada_sql() -> str:
    grower = _Grown(ADA.depth, _gini, _share)
    eps = 2.220446049250313e-16
    steps = [_D, f"w0 AS (SELECT id, CASE WHEN {_KNOWN} THEN 1 / sum(({_KNOWN})::INT) OVER () ELSE 0 END AS w, 0.0::DOUBLE AS total FROM d)"]
    for r in range(ADA_ROUNDS):
        rows = f"SELECT d.*, 0 AS i, w * coalesce(y, 0) AS g, w AS h, ({_KNOWN})::INT AS n FROM d JOIN w{r} USING (id)"
        steps += grower.tree(f"t{r}", rows)
        odds = f"(ln(least(greatest(value, {eps}), 1 - {eps})) - ln(1 - least(greatest(value, {eps}), 1 - {eps})))"
        steps.append(f"o{r} AS MATERIALIZED (SELECT id, w, total + {odds} AS total, w * exp(-0.5 * CASE WHEN y = 1 THEN {odds} ELSE -{odds} END) AS raw "
                     f"FROM d JOIN w{r} USING (id) JOIN t{r} USING (id))")  # fmt: skip
        steps.append(f"w{r + 1} AS MATERIALIZED (SELECT id, raw / sum(raw) OVER () AS w, total FROM o{r})")
    return f"WITH {', '.join(steps)} SELECT id AS SK_ID_CURR, 1 / (1 + exp(-total / {ADA_ROUNDS})) AS score FROM w{ADA_ROUNDS}"


@query("ada_boost_three_rounds", f"{ID}:int score:num", _ada_sql())
def _ada(spark, sf):
    return ensembles.ada_boosted(_stairs(spark, sf), "score", ADA_ROUNDS, ADA)


BOOST_PRESET, BOOST_ROUNDS = "catboost", 3
BOOST_RULE = {"depth": 3, "min_leaf": 20}  # in small nodes two columns may part the rows alike


def _boost_sql() -> str:
    rule, _, step, *_ = ensembles.BOOSTING[BOOST_PRESET]
    grower = _Grown(
        BOOST_RULE["depth"], lambda g, h: f"({g} * {g} / ({h} + {rule.l2}) / 2)", lambda g, h: f"(-{g} / ({h} + {rule.l2}) * {step})",
        min_leaf=BOOST_RULE["min_leaf"],
    )
    learns = f"({_KNOWN} AND fold <> i)"
    steps = [_D, f"folded AS MATERIALIZED (SELECT doc_id AS id, fold FROM ({FOLDED_SQL}))",
             "m AS MATERIALIZED (SELECT d.*, fold, k.i::INT AS i FROM d LEFT JOIN folded USING (id), range(5) k(i))",
             f"z0 AS MATERIALIZED (SELECT id, i, ln(rate / (1 - rate)) AS z FROM m JOIN (SELECT i, avg(y) AS rate FROM m WHERE {learns} GROUP BY 1) USING (i))"]
    for r in range(BOOST_ROUNDS):
        p = "(1 / (1 + exp(-z)))"
        rows = (f"SELECT m.*, CASE WHEN {learns} THEN {p} - y ELSE 0 END AS g, CASE WHEN {learns} THEN {p} * (1 - {p}) ELSE 0 END AS h, "
                f"coalesce({learns}, false)::INT AS n FROM m JOIN z{r} USING (id, i)")  # fmt: skip
        steps += grower.tree(f"t{r}", rows)
        steps.append(f"z{r + 1} AS MATERIALIZED (SELECT id, i, z + value AS z FROM z{r} JOIN t{r} USING (id, i))")
    p = "1 / (1 + exp(-z))"
    return (f"WITH {', '.join(steps)} SELECT id AS SK_ID_CURR, any_value(fold) AS fold, avg({p}) AS average, max(CASE WHEN fold = i THEN {p} END) AS held_out "
            f"FROM z{BOOST_ROUNDS} JOIN m USING (id, i) GROUP BY 1")  # fmt: skip


@query("boosted_trees_three_rounds", f"{ID},fold:int average,held_out:num", _boost_sql())
def _boosted(spark, sf):
    """Second-order boosting of one preset, a model for each fold, ended after three rounds at depth 3."""
    return ensembles.boosted_trees(_stairs(spark, sf), BOOST_PRESET, rounds=BOOST_ROUNDS, **BOOST_RULE).scores


# -------------------------------------------------------------- importances

_WITHOUT = " UNION ALL ".join(
    f"SELECT i, '{c}' AS feature, abs(corr({c}, TARGET)) AS importance FROM rows, range(5) k(i) WHERE fold <> i GROUP BY 1" for c in COLUMNS
)


@query("importance_sink_of_correlations", "feature:str importance:num",
       f"WITH rows AS MATERIALIZED (SELECT d.*, f.fold FROM ({st.DOCUMENTS_SQL}) d JOIN ({FOLDED_SQL}) f ON d.SK_ID_CURR = f.doc_id) "
       f"SELECT feature, avg(importance) AS importance FROM ({_WITHOUT}) GROUP BY 1")  # fmt: skip
def _importances(spark, sf):
    """A learner whose importances are known: the correlation of each column with the label, averaged over the folds' training rows."""
    folded = cut_lineage(stratified_folds(st.Native(spark, sf).documents().filter(F.col(LABEL).isNotNull()), ID, LABEL))
    cells = [F.struct(F.lit(c).alias("feature"), F.abs(F.corr(c, LABEL)).alias("importance")) for c in COLUMNS]
    tables = [folded.filter(F.col("fold") != k).agg(F.array(*cells).alias("cells")).selectExpr("inline(cells)") for k in range(5)]
    path = scratch(spark, "importance")
    src.write_csv_table(first_rows(stack.mean_importance(tables), ["feature"], [F.desc("importance")]), path)
    return src.read_csv_table(spark, path, "feature string, importance double")
