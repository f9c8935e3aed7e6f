"""The open surface for user functions over groups.

Nothing in this package uses it: the feature blocks are plain aggregates. ``grouped_map`` gives a user
function its group as an iterator of frames, so a group of any size passes
through one task in bounded memory; ``grouped_aggregate`` takes functions whose states merge, and no group goes through one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from itertools import groupby, islice

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame


def _segments(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Runs of equal keys of each batch; the rows come sorted by key."""
    for batch in batches:
        keys = batch[key]
        run = ((keys != keys.shift()) & ~(keys.isna() & keys.shift().isna())).cumsum()
        for _, rows in batch.groupby(run, sort=False):
            value = rows[key].iloc[0]
            yield None if pd.isna(value) else value, rows


def grouped_map(df: DataFrame, key: str, function: Callable[[Iterator[pd.DataFrame]], Mapping], schema: str) -> DataFrame:
    """Apply ``function`` (frames of one group -> {name: value}) per key; one output row per key.

    Rows are exchanged and sorted by key; the order inside a group is not defined.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for value, segments in groupby(_segments(batches, key), lambda s: s[0]):
            frames = (rows for _, rows in segments)
            found = function(frames)
            for _ in frames:  # what the function has not read
                pass
            yield pd.DataFrame({key: [value], **{n: [found.get(n)] for n in names}})

    kind = dict(df.dtypes)[key]
    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, f"{key} {kind}, {schema}")


STATES = 100_000  # states a task holds before it hands them on


ROWS = 4096  # rows of a frame that a task gives out
WHOLE = ("bigint", "int", "smallint", "tinyint")


def _keys(values, kind: str) -> pd.Series:
    return pd.Series(list(values), dtype="Int64" if kind in WHOLE else object)


def _emitted(states: dict, key: str, kind: str, salt: int) -> pd.DataFrame:
    return pd.DataFrame({key: _keys(states, kind), "_salt": salt, "_state": [pickle.dumps(s) for s in states.values()]})


def grouped_aggregate(
    df: DataFrame, key: str, init: Callable[[], object], update: Callable[[object, pd.DataFrame], object], merge: Callable[[object, object], object],
    finish: Callable[[object], Mapping], schema: str, salts: int = 64,
) -> DataFrame:
    """One row per key from states that merge: ``init()``, ``update(state, rows of the key)``, ``merge(a, b)``, ``finish(state)``.

    Every task reduces its rows to a state per key before anything is exchanged. States are merged by key and salt and then by key, so
    a key that holds a large part of the table meets in no task: what is exchanged of it is a state for each task.
    """
    kind = dict(df.dtypes)[key]
    names = [part.strip().split()[0] for part in schema.split(",")]

    def plain(value):
        return None if pd.isna(value) else int(value) if kind in WHOLE else value

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = TaskContext.get().partitionId() % salts
        states: dict = {}
        for batch in batches:
            for value, rows in batch.groupby(key, dropna=False, sort=False):
                value = plain(value)
                states[value] = update(states[value] if value in states else init(), rows)
            if len(states) >= STATES:
                yield _emitted(states, key, kind, salt)
                states = {}
        yield _emitted(states, key, kind, salt)

    def runs(batches: Iterator[pd.DataFrame]):
        """(key, salt, state) of each run of rows that share key and salt."""
        every = ((plain(k), int(s), pickle.loads(x)) for batch in batches for k, s, x in zip(batch[key], batch["_salt"], batch["_state"], strict=True))
        for (value, salt), group in groupby(every, lambda r: r[:2]):
            yield value, salt, reduce(merge, (state for *_, state in group))

    def merge_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = ((value, state) for value, _, state in runs(batches))
        while some := list(islice(every, ROWS)):  # a key may come with two salts, so not as a dict
            yield pd.DataFrame({key: _keys((v for v, _ in some), kind), "_salt": 0, "_state": [pickle.dumps(s) for _, s in some]})

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = ((value, finish(state)) for value, _, state in runs(batches))
        while some := list(islice(every, ROWS)):
            yield pd.DataFrame({key: _keys((v for v, _ in some), kind), **{n: [found.get(n) for _, found in some] for n in names}})

    held = f"`{key}` {kind}, _salt int, _state binary"
    states = df.mapInPandas(reduce_rows, held)
    salted = states.repartition(key, "_salt").sortWithinPartitions(key, "_salt").mapInPandas(merge_states, held)
    return salted.repartition(key).sortWithinPartitions(key).mapInPandas(finished, f"`{key}` {kind}, {schema}")
