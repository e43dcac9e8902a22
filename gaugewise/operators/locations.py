"""Work on whole locations inside tasks, as NumPy arrays: for what does not merge over rows or cells.

All rows of a location lie in one partition, in order; a task sees them as Arrow tables of whole groups, some
ten thousand rows each, or a single larger group. Locations that hold a large share of all rows are kept apart:
they are not gathered, and stay with the plans that spread a group over tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.operators.moments import Cells
from gaugewise.operators.skew import crowding, settle

#: Rows and locations of one task at most, on average.
TASK_ROWS, TASK_LOCATIONS = 100_000, 250


def by_location(matched: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``matched`` with all rows of a location in one partition, and apart from it those of hot locations as they lie."""
    rows = settle(matched)
    sizes = settle(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    crowd = crowding(sizes)
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(parallel, -(-crowd.total // TASK_ROWS), -(-sizes.count() // TASK_LOCATIONS))
    if not crowd.any_hot:
        return rows.repartition(tasks, key), None
    hot = F.broadcast(sizes.where(F.col("n") > crowd.threshold).select(F.col(key).alias("_hot")))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return rows.join(hot, same, "left_anti").repartition(tasks, key), rows.join(hot, same, "left_semi")


def whole_groups(batches: Iterable[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches in the order of ``by``, each with the rows at which its groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and _key(held[-1], held[-1].num_rows - 1, by) != _key(batch, 0, by):
            yield _joined(held, by)
            held = []
        last = _starts(batch, by)[-1]
        if last:
            yield _joined([*held, batch.slice(0, last)], by)
            held = []
        held.append(batch.slice(last))
    if held:
        yield _joined(held, by)


def _key(batch: pa.RecordBatch, row: int, by: Sequence[str]) -> str:
    return repr([batch.column(k)[row].as_py() for k in by])


def _joined(batches: list[pa.RecordBatch], by: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table, _starts(table, by)


def _starts(rows: pa.RecordBatch | pa.Table, by: Sequence[str]) -> np.ndarray:
    return np.flatnonzero(np.any([changes(rows.column(k)) for k in by], axis=0))


def changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether a value differs from the one before; the first does."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], coded[1:] != coded[:-1]])


def doubles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, nulls as 0, and which are present."""
    return column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy()


def shared_windows(present: Sequence[int | None], cells: Cells | None) -> list[tuple[list[str | None], list[int]]]:
    """The windows of a group whose cells are ``present``, as (names, numbers of the cells); windows that hold the
    same cells hold the same rows, and stand together."""
    if cells is None:
        return [([], list(range(len(present))))]
    holds: dict[str | None, list[int]] = {}
    for number, cell in enumerate(present):
        for name in cells.names(cell):
            holds.setdefault(name, []).append(number)
    shared: dict[tuple[int, ...], list[str | None]] = {}
    for name, numbers in holds.items():
        shared.setdefault(tuple(numbers), []).append(name)
    return [(names, list(numbers)) for numbers, names in shared.items()]


def segments(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Runs of one cell inside one group: where they begin, where each group's runs begin, and the cells."""
    new = changes(table.column("_cell"))
    new[starts] = True
    runs = np.flatnonzero(new)
    return runs, np.searchsorted(runs, starts), table.column("_cell").take(pa.array(runs)).to_pylist()
