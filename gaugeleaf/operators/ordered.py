"""A fold over ordered rows whose state its own output feeds, as a stream through Arrow tasks.

For steps that no window expresses, since what a row does hangs on what earlier rows have been made into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], start: Callable, step: Callable, adds: str) -> DataFrame:
    """rows with columns that step(state, *reads) gives, called for the rows of each key in order with the state that start() made.

    A task sorts (and spills) its rows and holds a batch and one state, so a key may have any number of
    rows.  Null keys are a key of their own.  Rows that are equal in order come in any order: make it total.
    """
    added = T._parse_datatype_string(adds)
    schema = T.StructType([*rows.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name)).to_pylist()
            made = []
            for own, values in zip(zip(*map(column, keys), strict=True), zip(*map(column, reads), strict=True), strict=True):
                if state is None or own != key:
                    key, state = own, start()
                made.append(step(state, *values))
            if made:
                extra = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*made, strict=True), added.fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.fieldNames())

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
