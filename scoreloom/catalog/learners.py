"""Learners, components, neighbours and propagation over the given tables.

Tree counts, depths and rounds are the presets'. Rows and texts are always the whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import components, discriminant, ensembles, learners, neighbors, perceptron, stack
from ..operators.clean import split_by_label
from ..operators.evaluate import roc_auc, stratified_folds
from ..operators.ordered import first_rows
from ..operators.scaling import Prepared, prepare
from ..session import cut_lineage
from ..sources import tables as src
from . import standin as st
from .blocks import native_wide
from .registry import query
from .scoring import FOLDED_SQL
from .standin import table
from .tables import scratch

ID, LABEL = "SK_ID_CURR", "TARGET"


def _data(spark, sf, scaler="norm", log=False) -> Prepared:
    return prepare(cut_lineage(st.Native(spark, sf).documents()), scaler, log)


def _learner(name: str, scaler: str = "norm", log: bool = False):
    def keep(build):
        @query(name, {ID: "int", "score": "num"})
        def run(spark, sf):
            data = _data(spark, sf, scaler, log)
            made = build(data)
            return learners.fit_and_score(data, made, "score") if hasattr(made, "fit") else made.toDF(ID, "score")

        return run

    return keep


_learner("logistic_regression", log=True)(learners.logistic_regression)
_learner("sgd_logistic_regression", log=True)(learners.sgd_logistic)
_learner("decision_tree")(lambda d: ensembles.decision_tree(d, "score"))
_learner("random_forest")(lambda d: ensembles.random_forest(d, "score"))
_learner("bagged_trees", "min_max")(lambda d: ensembles.bagged_trees(d, "score"))
_learner("ada_boost", "min_max")(lambda d: ensembles.ada_boosted(d, "score"))
for _name, _preset, _scaler in (
    ("lightgbm", "lightgbm", "none"), ("litegbm", "litegbm", "none"), ("xgboost", "xgboost", "none"), ("catboost", "catboost", "min_max"),
    ("gradient", "gradient_boosting", "norm"),
):
    _learner(f"boosted_trees_{_name}_preset", _scaler)(lambda d, p=_preset: ensembles.boosted_trees(d, p).scores.select(ID, "average"))
_learner("multilayer_perceptron", "min_max")(lambda d: perceptron.perceptron(d, "score"))
_learner("gaussian_mixture")(learners.gaussian_mixture)


# ---------------------------------------------------- discriminants, with SQL

COLUMNS = ["N_CHARS", "N_SPACES", "N_STOPS", "N_COMMAS", "N_E", "N_ONES"]  # all numbers of the table
_D = range(len(COLUMNS))


def _class_sql(source: str, by: str = "") -> str:
    """Moments of both classes, columns ``{n, m, s}{class}_...``, a row for each ``by``."""
    def of(c):
        where = f"FILTER (WHERE TARGET = {c})"
        means = [f"avg({x}) {where} AS m{c}_{i}" for i, x in enumerate(COLUMNS)]
        cross = [f"covar_pop({COLUMNS[i]}, {COLUMNS[j]}) {where} AS s{c}_{i}_{j}" for i in _D for j in range(i + 1)]
        return [f"CAST(count(*) {where} AS DOUBLE) AS n{c}", *means, *cross]

    picks = [by] if by else []
    return f"SELECT {', '.join(picks + of(0) + of(1))} FROM ({source}) WHERE TARGET IS NOT NULL" + (f" GROUP BY {by}" if by else "")


def _posterior_sql(moments: str, rows: str, cov: dict[int, str], pooled: bool, join: str, picks: str) -> str:
    """Class 1 share of each row from Cholesky factors of the covariances (``cov``: entry i, j of a class as text)."""
    steps = []
    for c in (0,) if pooled else (0, 1):
        for i in _D:
            for j in range(i + 1):
                rest = "".join(f" - l{c}_{i}_{k} * l{c}_{j}_{k}" for k in range(j))
                entry = cov[c].format(i=i, j=j)
                steps.append(f"sqrt({entry}{rest}) AS l{c}_{i}_{i}" if i == j else f"({entry}{rest}) / l{c}_{j}_{j} AS l{c}_{i}_{j}")
    solved = []
    for c in (0, 1):
        factor = 0 if pooled else c
        for i, x in enumerate(COLUMNS):
            rest = "".join(f" - l{factor}_{i}_{k} * z{c}_{k}" for k in range(i))
            solved.append(f"({x} - m{c}_{i}{rest}) / l{factor}_{i}_{i} AS z{c}_{i}")

    def half(c):
        factor = 0 if pooled else c
        return f"(ln(n{c}) - ({' + '.join(f'ln(l{factor}_{i}_{i})' for i in _D)}) - 0.5 * ({' + '.join(f'z{c}_{i} * z{c}_{i}' for i in _D)}))"

    return (f"SELECT {picks}, 1 / (1 + exp(greatest(-700, least(700, {half(0)} - {half(1)})))) AS score FROM (SELECT *, {', '.join(solved)} FROM ({rows}) r "
            f"{join} (SELECT *, {', '.join(steps)} FROM ({moments})) f)")  # fmt: skip


def _pooled(divisor: str) -> dict[int, str]:
    return {0: f"((n0 * s0_{{i}}_{{j}} + n1 * s1_{{i}}_{{j}}) / ({divisor}))"}


_OWN = {c: f"(s{c}_{{i}}_{{j}} * n{c} / (n{c} - 1))" for c in (0, 1)}


def _whole_sql(cov: dict[int, str], pooled: bool) -> str:
    return _posterior_sql(_class_sql(st.DOCUMENTS_SQL), st.DOCUMENTS_SQL, cov, pooled, "CROSS JOIN", "SK_ID_CURR")


def _plain(spark, sf) -> Prepared:
    return Prepared(st.Native(spark, sf).documents().select(ID, LABEL, *COLUMNS), COLUMNS)


@query("linear_discriminant_svd", f"{ID}:int score:flat", _whole_sql(_pooled("n0 + n1 - 2"), True))
def _lda_svd(spark, sf):
    return discriminant.linear_discriminant(_plain(spark, sf), "svd", "score")


@query("linear_discriminant_lsqr", f"{ID}:int score:flat", _whole_sql(_pooled("n0 + n1"), True))
def _lda_lsqr(spark, sf):
    return discriminant.linear_discriminant(_plain(spark, sf), "lsqr", "score")


@query("quadratic_discriminant", f"{ID}:int score:flat", _whole_sql(_OWN, False))
def _qda(spark, sf):
    return discriminant.quadratic_discriminant(_plain(spark, sf), "score")


_FOLDED_DOCUMENTS = f"SELECT d.*, f.fold FROM ({st.DOCUMENTS_SQL}) d JOIN ({FOLDED_SQL}) f ON d.SK_ID_CURR = f.doc_id"


@query("out_of_fold_discriminant", f"{ID},fold:int score:flat", _posterior_sql(
    _class_sql(f"SELECT d.*, i FROM ({_FOLDED_DOCUMENTS}) d, range(5) k(i) WHERE d.fold <> i", "i"), _FOLDED_DOCUMENTS, _pooled("n0 + n1 - 2"), True,
    "JOIN", f"{ID}, fold").replace(") f)", ") f ON r.fold = f.i)"))
def _lda_held_out(spark, sf):
    data = _plain(spark, sf)
    folded = stratified_folds(data.labelled, ID)
    return discriminant.held_out(Prepared(folded, COLUMNS), "fold", "linear", "score")


# ------------------------------------------------------------- components


def _vectors(spark, sf) -> Prepared:
    rows = table(spark, sf, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"x{i}" for i in range(width)]
    label = "CASE WHEN vec_id % 5 = 0 THEN NULL WHEN label < 5 THEN 1D ELSE 0D END"
    cells = [f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in range(width)]
    return Prepared(rows.selectExpr(f"vec_id AS {ID}", f"{label} AS {LABEL}", *cells), names)


@query("principal_components", {ID: "int", **{f"pc{i}": "flat" for i in range(1, 21)}})
def _pca(spark, sf):
    return components.principal_components(_vectors(spark, sf), 20).scores


@query("components_keep_distances", f"{ID}:int square:flat",
       "SELECT vec_id AS SK_ID_CURR, sum(pow(x - m, 2)) AS square FROM (SELECT vec_id, x, avg(x) FILTER (WHERE vec_id % 5 <> 0) OVER (PARTITION BY i) AS m FROM "
       "(SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY 1")  # fmt: skip
def _distances(spark, sf):
    """All components together keep each point's distance to the mean of the rows they were fitted on."""
    data = _vectors(spark, sf)
    scores = components.principal_components(data, len(data.features)).scores
    names = [c for c in scores.columns if c != ID]
    return scores.select(ID, F.expr(" + ".join(f"`{c}` * `{c}`" for c in names)).alias("square"))


@query("cosine_components_keep_distances", f"{ID}:int square:flat",
       "SELECT vec_id AS SK_ID_CURR, sum(pow(x - m, 2)) AS square FROM (SELECT vec_id, x, avg(x) FILTER (WHERE vec_id % 5 <> 0) OVER (PARTITION BY i) AS m FROM "
       "(SELECT vec_id, unnest(v) / sqrt(list_inner_product(v, v)) AS x, generate_subscripts(v, 1) AS i FROM "
       "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))) GROUP BY 1")  # fmt: skip
def _cosine_distances(spark, sf):
    """As ``components_keep_distances``, of the rows scaled to unit length."""
    data = _vectors(spark, sf)
    scores = components.principal_components(data, len(data.features), "kernel_pca_cosine", "cosine").scores
    names = [c for c in scores.columns if c != ID]
    return scores.select(ID, F.expr(" + ".join(f"`{c}` * `{c}`" for c in names)).alias("square"))


@query("linear_svm_on_components", {ID: "int", "score": "num"})
def _svm(spark, sf):
    return learners.linear_svm(components.reduced(_vectors(spark, sf), 20), "score")


@query("kernel_components_cosine", f"{ID}:int kernel_pca_cosine1,kernel_pca_cosine2:flat")
def _kernel(spark, sf):
    return components.principal_components(_vectors(spark, sf), 2, "kernel_pca_cosine", "cosine").scores


# ---------------------------------------------- neighbours and propagation

COUNTS = neighbors.NEIGHBOR_COUNTS
_POINT = "vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y"
_SHARES = {f"knn_{n}_neighbors": f"avg(y) FILTER (WHERE rn <= {n})" for n in COUNTS}


@query("nearest_neighbor_shares", {"vec_id": "int", **{c: "num" for c in _SHARES}},
       "SELECT vec_id, " + ", ".join(f'{e} AS "{n}"' for n, e in _SHARES.items()) + " FROM (SELECT q.vec_id, p.y, "
       "row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, p.v), p.vec_id) AS rn "
       f"FROM (SELECT {_POINT} FROM embeddings) q, (SELECT {_POINT} FROM embeddings WHERE vec_id % 5 <> 0) p) GROUP BY 1")  # fmt: skip
def _shares(spark, sf):
    rows = table(spark, sf, "embeddings").selectExpr("vec_id", "embedding", "CASE WHEN label < 5 THEN 1 ELSE 0 END AS y")
    return neighbors.neighbor_shares(rows, rows.filter("vec_id % 5 <> 0"), "vec_id", "embedding", "y", COUNTS)


@query("approximate_neighbor_pairs", "vec_id,neighbor:int distance:num")
def _approximate(spark, sf):
    rows = table(spark, sf, "embeddings")
    return neighbors.approximate_neighbors(rows, rows.filter("vec_id % 5 <> 0"), "vec_id", "embedding", 1.1)


ROUNDS = 30  # fixed value: most rounds
_GRAPH_SQL = (
    f"edges AS MATERIALIZED (SELECT i, j FROM (SELECT q.vec_id AS i, p.vec_id AS j, row_number() OVER (PARTITION BY q.vec_id "
    f"ORDER BY list_distance(q.v, p.v), p.vec_id) AS rn FROM (SELECT {_POINT} FROM embeddings) q, (SELECT {_POINT} FROM embeddings) p) "
    "WHERE rn <= 7), seeds AS (SELECT vec_id AS i, vec_id % 5 <> 0 AS known, CASE WHEN vec_id % 5 = 0 THEN 0.0 WHEN label < 5 "
    "THEN 1.0 ELSE 0.0 END AS p1, CASE WHEN vec_id % 5 = 0 THEN 0.0 WHEN label < 5 THEN 0.0 ELSE 1.0 END AS p0 FROM embeddings)"
)


def _propagation_sql() -> str:
    steps = ["s0 AS (SELECT i, p0, p1 FROM seeds)"]
    for r in range(1, ROUNDS + 1):
        steps.append(
            f"s{r} AS MATERIALIZED (SELECT s.i, CASE WHEN known THEN s.p0 WHEN m0 + m1 > 0 THEN m0 / (m0 + m1) ELSE 0 END AS p0, "
            "CASE WHEN known THEN s.p1 WHEN m0 + m1 > 0 THEN m1 / (m0 + m1) ELSE 0 END AS p1 FROM seeds s LEFT JOIN "
            f"(SELECT e.i, avg(p0) AS m0, avg(p1) AS m1 FROM edges e JOIN s{r - 1} t ON e.j = t.i GROUP BY 1) m ON s.i = m.i)"
        )
    return f"WITH {_GRAPH_SQL}, {', '.join(steps)} SELECT i AS vec_id, p1 / nullif(p0 + p1, 0) AS score FROM s{ROUNDS}"


def _spreading_sql() -> str:
    steps = [
        "others AS (SELECT * FROM edges WHERE i <> j)",
        "deg AS (SELECT j AS k, CAST(count(*) AS DOUBLE) AS d FROM others GROUP BY 1)",
        "w AS MATERIALIZED (SELECT o.i, o.j, 1 / sqrt(a.d * coalesce(b.d, 1)) AS w FROM others o JOIN deg a ON o.j = a.k "
        "LEFT JOIN deg b ON o.i = b.k)",
        "s0 AS (SELECT i, p0, p1 FROM seeds)",
    ]
    for r in range(1, ROUNDS + 1):
        steps.append(
            f"s{r} AS MATERIALIZED (SELECT s.i, 0.2 * coalesce(m0, 0) + 0.8 * s.p0 AS p0, 0.2 * coalesce(m1, 0) + 0.8 * s.p1 AS p1 "
            f"FROM seeds s LEFT JOIN (SELECT w.i, sum(w * p0) AS m0, sum(w * p1) AS m1 FROM w JOIN s{r - 1} t ON w.j = t.i GROUP BY 1) m "
            "ON s.i = m.i)"
        )
    return f"WITH {_GRAPH_SQL}, {', '.join(steps)} SELECT i AS vec_id, p1 / nullif(p0 + p1, 0) AS score FROM s{ROUNDS}"


@query("descent_neighbor_graph", "vec_id,neighbor:int")
def _descent(spark, sf):
    return neighbors.descent_graph(table(spark, sf, "embeddings"), "vec_id", "embedding", neighbors.GRAPH_NEIGHBORS)


def _graph(spark, sf):
    rows = table(spark, sf, "embeddings")
    labels = rows.selectExpr("vec_id", "CASE WHEN vec_id % 5 = 0 THEN NULL WHEN label < 5 THEN 1 ELSE 0 END AS y")
    return neighbors.neighbor_graph(rows, "vec_id", "embedding"), labels


@query("label_propagation", "vec_id:int score:flat", _propagation_sql())
def _propagation(spark, sf):
    return neighbors.label_propagation(*_graph(spark, sf), "vec_id", "y", rounds=ROUNDS, name="score")


@query("label_spreading", "vec_id:int score:flat", _spreading_sql())
def _spreading(spark, sf):
    return neighbors.label_spreading(*_graph(spark, sf), "vec_id", "y", rounds=ROUNDS, name="score")


# ------------------------------------------------- folds, stack and reports


def _crossed(spark, sf):
    data = _data(spark, sf)
    labelled, unlabelled = split_by_label(data.frame)
    return stack.cross_fit(labelled, unlabelled, ensembles.forest_learner(data.features))


def _group_means(labelled):
    """A learner with a closed form: the mean label of each language."""
    means = labelled.groupBy("LANG").agg(F.avg(LABEL).alias("_mean"))
    return lambda rows, name: rows.join(means, "LANG", "left").withColumn(name, F.col("_mean")).drop("_mean")


_FOLD_MEANS = f"""
WITH folded AS MATERIALIZED (SELECT doc_id, quality, fold FROM ({FOLDED_SQL})),
d AS (SELECT doc_id, lang, quality, fold FROM documents LEFT JOIN folded USING (doc_id)),
m AS (SELECT i, lang, avg(quality) AS mean FROM d, range(5) k(i) WHERE fold <> i GROUP BY 1, 2)
"""


def _crossed_means(spark, sf):
    labelled, unlabelled = split_by_label(st.Native(spark, sf).documents())
    return stack.cross_fit(labelled, unlabelled, _group_means)


@query("out_of_fold_group_means", f"{ID},{LABEL},fold:int held_out:num",
       _FOLD_MEANS + "SELECT doc_id AS SK_ID_CURR, quality AS TARGET, fold, mean AS held_out FROM d JOIN m ON m.lang = d.lang AND m.i = d.fold")
def _held_out_means(spark, sf):
    return _crossed_means(spark, sf).filter(F.col("fold").isNotNull())


@query("fold_averaged_group_means", f"{ID},{LABEL}:int average:num",
       _FOLD_MEANS + "SELECT doc_id AS SK_ID_CURR, any_value(quality) AS TARGET, avg(mean) AS average FROM d JOIN m ON m.lang = d.lang GROUP BY 1")
def _averaged_means(spark, sf):
    return _crossed_means(spark, sf)


@query("out_of_fold_prediction", f"{ID},{LABEL},fold:int held_out:num")
def _held_out(spark, sf):
    return _crossed(spark, sf).filter(F.col("fold").isNotNull())


@query("fold_averaged_prediction", f"{ID},{LABEL}:int average:num")
def _averaged(spark, sf):
    return _crossed(spark, sf)


@query("fold_and_overall_auc", "part:str auc:num")
def _aucs(spark, sf):
    scored = cut_lineage(_crossed(spark, sf))
    folds = stack.fold_aucs(scored).selectExpr("concat('fold ', fold) AS part", "auc")
    return folds.unionByName(roc_auc(scored, LABEL, "held_out").selectExpr("'all' AS part", "auc"))


def _fold_importances(spark, sf):
    data = _data(spark, sf)
    folded = stratified_folds(data.labelled, ID)
    for i in range(5):
        yield ensembles.forest_importances(folded.filter(F.col("fold") != i), data.features)


@query("feature_importance", "feature:str importance:num")
def _importance(spark, sf):
    return stack.mean_importance(list(_fold_importances(spark, sf))).limit(30)


@query("importance_table_sink", "feature:str importance:num")
def _importance_sink(spark, sf):
    ranked = stack.mean_importance(list(_fold_importances(spark, sf)))
    path = scratch(spark, "importance")
    src.write_csv_table(first_rows(ranked, ["feature"], [F.desc("importance")]), path)
    return src.read_csv_table(spark, path, "feature string, importance double")


@query("run_parameter_sink", "value:str",
       f"SELECT 'regParam:{learners.SGD_ALPHA},' AS value UNION ALL SELECT concat('rows:', count(*), ',') FROM documents")
def _parameters(spark, sf):
    data = _data(spark, sf)
    scored = learners.logistic_regression(data, "score").join(data.frame.select(ID, LABEL), ID)
    auc = roc_auc(scored, LABEL, "score").first()["auc"]
    path = scratch(spark, "parameters")
    src.write_parameters(spark, {"regParam": learners.SGD_ALPHA, "rows": data.frame.count()}, path, auc)
    return spark.read.text(path).select("value")


@query("stack_and_blend", f"{ID}:int TARGET:num")
def _stack_and_blend(spark, sf):
    """Three base scores over the wide table, a row for each client."""
    data = prepare(cut_lineage(native_wide(spark, sf)), "norm")
    data = Prepared(cut_lineage(data.frame), data.features)
    scores = {
        "logistic": learners.logistic_regression(data, "logistic"),
        "forest": ensembles.random_forest(data, "forest"),
        "boosted": ensembles.boosted_trees(data, "lightgbm").scores.select(ID, F.col("average").alias("boosted")),
    }
    return stack.blend(scores, {"logistic": 0.3, "forest": 0.3, "boosted": 0.4})


@query("grouped_map_function", "user_id,n:int spread:num",
       "SELECT user_id, count(*) AS n, max(value) - min(value) AS spread FROM events GROUP BY 1")
def _grouped_map(spark, sf):
    from ..functions.user import grouped_aggregate

    def update(state, rows):
        n, low, high = state
        return n + len(rows), min(low, rows["value"].min()), max(high, rows["value"].max())

    events = table(spark, sf, "events").select("user_id", "value")
    return grouped_aggregate(
        events, "user_id", lambda: (0, float("inf"), float("-inf")), update, lambda a, b: (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2])),
        lambda s: {"n": s[0], "spread": s[2] - s[1]}, "n bigint, spread double",
    )
