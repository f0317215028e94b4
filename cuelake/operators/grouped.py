"""Folds over groups of rows, many groups an Arrow batch: a task reads its rows in order and cuts them where a group begins.

What applyInArrow costs a group, a stream of its own, is paid once a batch here; groups of a few rows are what that is for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def key_changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Of every row, whether a key differs from the row's before; nulls are equal. The first row: False."""
    out = np.zeros(rows.num_rows, dtype=bool)
    for key in keys:
        column = rows.column(key).combine_chunks()
        a, b = column[:-1], column[1:]
        out[1:] |= pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], begins: Callable[[pa.Table], np.ndarray], least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups, of `least` rows or more but for the last. begins: of every row but the first, whether a group begins there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        before = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 1)
        at = np.flatnonzero(begins(pa.Table.from_batches([before, batch]))[1:])
        if len(at) and sum(b.num_rows for b in held) + int(at[-1]) >= least:
            cut = int(at[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def by_group(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """fold takes a table of whole groups, in the order of keys and `order`, and returns what they become: rows of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, lambda t: key_changes(t, keys)):
            yield from fold(table).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
