"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestack.storage import hadoop_path, materialize, remove, scratch, shared_dir, shared_path  # noqa: F401

#: Rows and characters of text that a Python worker turns into objects at once.
SLICE_ROWS, SLICE_CHARS = 256, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded rows and text, in order; a part has a row at least."""
    sizes = batch.column(text_at)
    rows = batch.num_rows
    start = 0
    while start < rows:
        stop, chars = start, 0
        while stop < rows and stop - start < SLICE_ROWS and (chars < SLICE_CHARS or stop == start):
            value = sizes[stop]
            chars += value.as_buffer().size if value.is_valid else 0
            stop += 1
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str]], list[list]]],
    text: str = "text",
) -> DataFrame:
    """``keep`` columns of ``df`` and new ``fields`` computed from whole texts.

    ``make()`` runs once a task and gives a function from a list of texts
    (null read as empty) to one list of values per field. Only the named columns
    are read, so other columns of ``df`` can have any names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for name in keep for f in df.schema.fields if f.name == name]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept] + list(fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in slices(batch, len(keep)):
                texts = [x or "" for x in part.column(len(keep)).to_pylist()]
                values = function(texts)
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                columns += [pa.array(v, type=arrow.field(len(keep) + i).type) for i, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(run, schema)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], tuple[list[bool] | None, list[str] | None]]],
    text: str = "text",
    length: str | None = None,
) -> DataFrame:
    """``df`` with some rows dropped or their texts replaced; its columns stay as they are.

    ``make()`` gives a function from texts to (rows kept or None, new texts or
    None). ``length``: a column that holds the text's code points and follows it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.schema)
    at = df.columns.index(text)
    length_at = df.columns.index(length) if length and length in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                keep, new = function([x or "" for x in texts])
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(arrow))]
                if new is not None:
                    changed = [None if old is None else x for old, x in zip(texts, new)]
                    columns[at] = pa.array(changed, type=arrow.field(at).type)
                    if length_at is not None:
                        counts = part.column(length_at).to_pylist()
                        counts = [c if x is None or x == old else len(x) for c, x, old in zip(counts, changed, texts)]
                        columns[length_at] = pa.array(counts, type=arrow.field(length_at).type)
                out = pa.RecordBatch.from_arrays(columns, schema=arrow)
                yield out if keep is None else out.filter(pa.array(keep, type=pa.bool_()))

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; ``LODESTACK_TOKENIZERS`` can name another folder."""
    folder = os.environ.get("LODESTACK_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
