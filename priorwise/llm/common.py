"""What the document operators share: shared storage, row packing and byte helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.session import cut_lineage

Batches = Iterator[pa.RecordBatch]

#: Both alphabets, for lower-casing A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the checkpoint folder of a local test session."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            cut_lineage(spark.range(1))  # sets the session's own folder, on a local master only
        root = context._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/priorwise-{uuid.uuid4().hex}"


def stored(df: DataFrame, sort_within: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, lost executors lose nothing."""
    path = shared_folder(df.sparkSession) + "/table"
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct column ``doc``, so that no column an operator adds can clash with one of the table."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[v.alias(k) for k, v in more.items()])


def text_key(id_col: str, text_col: str) -> Column:
    """A key that any later scan computes again: the id and a hash of the text. Repeated rows share it."""
    return F.concat_ws(":", F.coalesce(F.hex(F.col(id_col).cast("long")), F.lit("-")), F.hex(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by five; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes; null counts as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of consecutive items whose sizes add up to about ``limit``; an item is never cut."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
