"""Sequential folds over the ordered rows of groups, in time linear in the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_sorted(df: DataFrame, group: str, order: list[str], start: tuple, step: Callable, schema: str) -> DataFrame:
    """One exchange and one sort, then a pass that holds a batch of rows and the state of one group.

    step(state, row) gives the next state and a row of the schema; a row has the columns of df, and a group begins with
    the state `start`, which step mustn't change.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))
    at = df.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, start, False
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or row[at] != key:
                    key, state, begun = row[at], start, True
                state, made = step(state, row)
                out.append(made)
            columns = zip(*out, strict=True) if out else [[] for _ in kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
