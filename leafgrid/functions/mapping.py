"""Python callables over documents and batches, for what DataFrame operators can't express."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Document = dict[str, Any]


def _schema(df: DataFrame, schema: StructType | str | None) -> StructType:
    return df.schema if schema is None else StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _results(value: Any) -> Iterator[Document]:
    """One document, those of a generator, or none for None."""
    if inspect.isgenerator(value):
        yield from value
    elif value is not None:
        yield value


def _batch(rows: list[Document], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch: columns that a row lacks are null, others than the schema's go."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def map_documents(df: DataFrame, f: Callable[..., Any], schema: StructType | str | None = None, kwargs: Mapping[str, Any] | None = None, rows_per_batch: int = 256) -> DataFrame:
    """f(document, **kwargs) for each row as a dict: a dict gives one row, a generator many, None none.

    schema is that of the result, the input's if not given.  Results go on every rows_per_batch, so a
    document that gives very many is never held whole.  Nothing is shuffled.
    """
    out, more = _schema(df, schema), dict(kwargs or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(out), []
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                for row in batch.slice(at, rows_per_batch).to_pylist():
                    for result in _results(f(row, **more)):
                        held.append(result)
                        if len(held) >= rows_per_batch:
                            yield _batch(held, arrow)
                            held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, out)


def map_batches(df: DataFrame, f: Callable[..., Any], batch_size: int, schema: StructType | str | None = None, kwargs: Mapping[str, Any] | None = None) -> DataFrame:
    """f(documents, **kwargs) for consecutive lists of batch_size rows of a partition; it returns an iterable of dicts.

    A partition's last batch may be shorter; a partition without rows calls nothing.
    """
    if batch_size < 1:
        raise ValueError("batch_size is at least 1")
    out, more = _schema(df, schema), dict(kwargs or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(out), []
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                held += batch.slice(at, batch_size).to_pylist()
                while len(held) >= batch_size:
                    yield _batch(list(f(held[:batch_size], **more)), arrow)
                    held = held[batch_size:]
        if held:
            yield _batch(list(f(held, **more)), arrow)

    return df.mapInArrow(run, out)
