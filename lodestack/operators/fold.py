"""Ordered folds: state that passes from row to row of a key, in tasks that stream sorted rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def sorted_fold(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Callable], fields: str) -> DataFrame:
    """``rows`` with new ``fields`` (DDL), found row by row in ``order`` within ``keys``.

    ``start()`` gives a function for a new key, which gets a row's ``inputs`` and returns the
    values of the new fields. A key's rows pass one task in Arrow batches; what is held is
    the function's state, so a key may have any number of rows, and time is linear in them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T._parse_datatype_string(fields)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields] + added.fields)
    arrow, width = to_arrow_schema(schema), len(rows.schema.fields)

    def run(batches):
        import pyarrow as pa

        now, step = None, None
        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            found = []
            for k, values in zip(key, zip(*(batch.column(c).to_pylist() for c in inputs))):
                if step is None or k != now:
                    now, step = k, start()
                found.append(step(*values))
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(width)]
            columns += [pa.array([x[j] for x in found], type=arrow.field(width + j).type) for j in range(len(added.fields))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
