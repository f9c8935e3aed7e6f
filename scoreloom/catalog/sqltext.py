"""Text blocks of the checking SQL: statistics written out for a SQL engine."""

from __future__ import annotations


def stat_sql(name: str, col: str, where: str | None = None) -> str:
    """One group statistic; ``where`` restricts the rows it sees."""
    f = f" FILTER (WHERE {where})" if where else ""
    c = f'"{col}"'
    rows = f"count(*){f}"
    known = f"count({c}){f}"
    complete = f"{known} = {rows}"
    varies = f"min({c}){f} < max({c}){f}"
    simple = {
        "mean": f"avg({c}){f}",
        "max": f"max({c}){f}",
        "min": f"min({c}){f}",
        "std": f"stddev_samp({c}){f}",
        "var": f"var_samp({c}){f}",
        "count": known,
        "size": rows,
        "nunique": f"count(DISTINCT {c}){f}",
        "median": f"quantile_cont({c}, 0.5){f}",
    }
    if name in simple:
        return simple[name]
    if name == "sum":
        total = f"coalesce(sum({c}){f}, 0)"
        return f"CASE WHEN {rows} > 0 THEN {total} END" if where else total
    if name == "skew":  # back from the sample-corrected form to the population form
        scale = f"({known} - 2) / sqrt({known} * ({known} - 1))"
        return (
            f"CASE WHEN {complete} AND {varies} THEN "
            f"CASE WHEN {known} = 2 THEN 0 ELSE skewness({c}){f} * {scale} END END"
        )
    if name == "kurt":
        return f"CASE WHEN {complete} AND {varies} THEN kurtosis_pop({c}){f} END"
    if name == "iqr":
        return f"CASE WHEN {complete} THEN quantile_cont({c}, 0.75){f} - quantile_cont({c}, 0.25){f} END"
    raise KeyError(name)


def bundle_sql(col: str, stats, prefix: str = "", where: str | None = None) -> dict[str, str]:
    return {f"{prefix}{col}_{s}": stat_sql(s, col, where) for s in stats}


def spec_sql(spec, prefix: str = "", where: str | None = None) -> dict[str, str]:
    return {f"{prefix}{c}_{s.upper()}": stat_sql(s, c, where) for c, ss in spec.items() for s in ss}


def slope_sql(col: str, k: int | None = None, rank: str = "rn") -> str:
    f = f" FILTER (WHERE {rank} <= {k})" if k else ""
    c = f'"{col}"'
    return (
        f"CASE WHEN count({c}){f} = count(*){f} THEN CASE WHEN count(*){f} = 1 THEN 0.0 "
        f"ELSE regr_slope({c}, {rank} - 1){f} END END"
    )


def picks(columns: dict[str, str]) -> str:
    return ",\n  ".join(f'{e} AS "{n}"' for n, e in columns.items())


def ratio_sql(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


def kind_of(name: str) -> str:
    """Comparison kind of a feature column by its name."""
    low = name.lower()
    if any(t in low for t in ("_skew", "_kurt", "_trend_")):
        return "flat"
    return "num"
