"""The joins of the wide table: left joins on one key, unions, id binds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def left_join_blocks(entity: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join feature blocks (one row per key each) onto the entity table.

    Every block comes out of a ``groupBy(key)``, so all sides are already hash
    partitioned on the key and only the entity table is exchanged.
    """
    return reduce(lambda left, block: left.join(block, key, "left"), blocks, entity)


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bind_by_id(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Put the columns of several tables side by side, matched by id; an id that one table lacks has nulls there."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)
