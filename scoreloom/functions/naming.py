"""Column naming: safe spellings of formula-like names, prefixes, patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

# How the operator signs of formula-like names are spelled.
SIGN_WORDS = {"/": "_DIV_", "-": "_MINUS_", ">": "_GT_", "*": "_TIMES_"}


def safe_name(name: str) -> str:
    """``A/B`` -> ``A_DIV_B`` and so on, so no backticks are needed."""
    return "".join(SIGN_WORDS.get(ch, ch) for ch in name)


def tidy_value(value) -> str:
    """A data value as part of a column name: trimmed, spaces to _, upper case."""
    return str(value).strip().replace(" ", "_").upper()


def tidy_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: tidy_value(c) for c in df.columns})


def with_prefix(df: DataFrame, prefix: str, keys: Iterable[str]) -> DataFrame:
    """Prefix every column that is not a key."""
    keys = set(keys)
    return df.toDF(*[c if c in keys else prefix + c for c in df.columns])


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names that contain a match of the pattern."""
    return [c for c in df.columns if re.search(pattern, c)]


def of_period(names: Iterable[str], period: int) -> list[str]:
    """Sorted names that carry ``_{period}_``."""
    return sorted(n for n in names if f"_{period}_" in n)


# Columns that are never model features.
NOT_FEATURES = ("TARGET", "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV")


def feature_names(df: DataFrame, exclude: Iterable[str] = NOT_FEATURES) -> list[str]:
    skip = set(exclude)
    return [c for c in df.columns if c not in skip]


def drop_existing(df: DataFrame, *names: str) -> DataFrame:
    """Drop the named columns where present; absent names are ignored."""
    return df.drop(*[n for n in names if n in df.columns])
