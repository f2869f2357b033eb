"""Helpers that the operators on texts share: Arrow batches with added columns, folds, sizes of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a task holds in work arrays at a time (a single longer text is taken alone).
BATCH_BYTES = 2_000_000


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key's text, modulo `parts`; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def text_groups(texts: Sequence, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about `limit` characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def add_columns(
    df: DataFrame,
    fields: str,
    compute: Callable[[list[str]], dict[str, Sequence]],
    keep: Sequence[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """`df` with the columns that `compute` derives from whole texts (null: empty); `keep` names the columns to return.

    Batches stay Arrow on both sides, so that the other columns pass through untouched, and are worked
    on in groups of about `BATCH_BYTES` characters.
    """
    added = StructType.fromDDL(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    source = df.select(*dict.fromkeys([*[f"`{c}`" for c in kept], f"`{text}`"]))
    schema = StructType([*source.select(*[f"`{c}`" for c in kept]).schema.fields, *added.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for start, end in text_groups(texts):
                made = compute(texts[start:end])
                part = batch.slice(start, end - start)
                arrays = [part.column(c) for c in kept] + [pa.array(made[n], type=kind) for n, kind in types]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(n for n, _ in types)])

    return source.mapInArrow(work, schema)


def keeping_columns(*read: str):
    """For operators that return the columns of `docs`: all but those they `read` get names that none of their own clashes with."""

    def wrap(operator):
        @wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            names = docs.columns
            inner = docs.toDF(*[c if c in read else f"_extra_{i}" for i, c in enumerate(names)])
            return operator(inner, *args, **kwargs).toDF(*names)

        return run

    return wrap


def documents(spark, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns or ("doc_id", "text"))
