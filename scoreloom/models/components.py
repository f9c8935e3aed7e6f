"""Principal components, fitted on labelled rows and applied to all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.scaling import Prepared
from .learners import FEATURES, with_vector


@dataclass
class Components:
    scores: DataFrame
    explained: list[float]
    columns: list[str]


def principal_components(
    data: Prepared, k: int, prefix: str = "pc", kernel: str = "linear", keep: tuple[str, ...] = ()
) -> Components:
    """``{prefix}1..k`` per row and the explained share per component.

    ``kernel='cosine'`` first scales every row to unit length, which makes the
    plain components those of the cosine kernel.
    """
    rows = with_vector(data.frame, data.features)
    if kernel == "cosine":
        rows = Normalizer(p=2.0, inputCol=FEATURES, outputCol="_unit").transform(rows)
    elif kernel == "linear":
        rows = rows.withColumn("_unit", F.col(FEATURES))
    else:
        raise ValueError(f"kernel {kernel!r} is not available")
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_unit", outputCol="_centred")
    known = rows.filter(F.col(data.label).isNotNull())
    centred = centre.fit(known)
    model = PCA(k=k, inputCol="_centred", outputCol="_pcs").fit(centred.transform(known))
    names = [f"{prefix}{i + 1}" for i in range(k)]
    values = vector_to_array("_pcs")
    out = model.transform(centred.transform(rows)).select(
        data.id, *keep, *[values[i].alias(n) for i, n in enumerate(names)]
    )
    return Components(out, [float(v) for v in model.explainedVariance.toArray()], names)


def reduced(data: Prepared, k: int) -> Prepared:
    """The same table with k components as its features."""
    parts = principal_components(data, k, keep=(data.label,))
    return Prepared(parts.scores, parts.columns, data.id, data.label)
