"""Adding columns that are computed text by text in Python, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_BYTES = 4_000_000


def text_slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about ``limit`` characters; a longer text is alone in its list."""
    part: list[str | None] = []
    size = 0
    for text in texts:
        length = len(text) if text else 0
        if part and size + length > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += length
    if part:
        yield part


def with_text_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    start: Callable[[], Callable[[list[str | None]], list[list]]],
) -> DataFrame:
    """Add ``fields`` that a Python function computes from column ``text``; other columns pass unchanged.

    ``start`` is called once per task and returns a function from a list of texts to one list per
    field. Input columns with a field's name are replaced.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    source = df.select(*kept) if text in kept else df.select(*kept, text)
    schema = T.StructType([f for f in source.schema.fields if f.name in kept] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for part in text_slices(batch.column(text).to_pylist()):
                for column, values in zip(columns, compute(part)):
                    column.extend(values)
            arrays = [batch.column(c) for c in kept] + [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
