"""Shared plumbing: written tables, Arrow streaming and text access."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.sources.shared import shared_path


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that survive executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow schema Spark expects back from ``mapInArrow`` for ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tidy() -> None:
    """Give memory that a task no longer needs back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has the call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of ``column`` reach ``most``, so that what is derived from it stays small."""
    col = batch.column(column)
    sizes = col.cast(pa.large_binary()) if pa.types.is_string(col.type) else col
    at = size = 0
    for i, s in enumerate(sizes):
        size += len(s.as_buffer()) if s.is_valid else 0
        if size >= most:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def packed(names: list[str]) -> Column:
    """Columns in one, named ``__tw_rest``, so that no name of theirs meets one made on the way."""
    return F.struct(F.lit(0).alias("__tw_none"), *[F.col(f"`{c}`") for c in names]).alias("__tw_rest")


def unpacked(names: list[str]) -> list[Column]:
    """The columns of ``packed``."""
    return [F.col("__tw_rest").getField(c).alias(c) for c in names]


def raw(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x if x is not None else b"" for x in col.cast(pa.large_binary()).to_pylist()]


def extend(df: DataFrame, text_col: str, added: T.StructType, compute: Callable[[], Callable[[pa.Array], list]], keep_text: bool = True) -> DataFrame:
    """Add columns computed from whole texts, batch by batch in Arrow.

    ``compute()`` runs once in each task and returns a function from a slice of the text column to one array per added
    column. The text itself stays only if asked, since what comes back from Python cannot be pruned. A column of ``df``
    that has the name of an added one is replaced.
    """
    names = set(added.names)
    rest = [f for f in df.schema.fields if f.name not in names and f.name != text_col]
    keep = [df.schema[text_col]] if keep_text and text_col not in names else []
    src = df.select(F.col(f"`{text_col}`"), *[F.col(f"`{f.name}`") for f in rest])
    out = T.StructType([*keep, *rest, *added.fields])
    arrow = arrow_schema(out)
    skip = 0 if keep else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = compute()
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                cols = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(f(part.column(0)), (arrow.field(n).type for n in added.names), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[skip:], *cols], schema=arrow)
        tidy()

    found = src.mapInArrow(run, out)
    order = [c for c in df.columns if c not in names and (c != text_col or keep)]
    return found.select(*[F.col(f"`{c}`") for c in order], *added.names)
