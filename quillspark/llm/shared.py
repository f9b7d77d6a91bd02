"""What several operators of this package need: shared storage, Arrow helpers."""
from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

_staged: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors, stays columnar."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _staged:
        atexit.register(_clean, 0)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is staged inside goes at its end, but for what is staged by the function that this yields."""
    mark, kept = len(_staged), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made = stage(df, name)
        kept.append(_staged.pop())
        return made

    try:
        yield keep
    finally:
        _clean(mark)
        _staged.extend(kept)


def _clean(mark: int) -> None:
    for spark, path in _staged[mark:]:
        with contextlib.suppress(Exception):
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _staged[mark:]


def two(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text) with types that every kernel here expects; null text is empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch], list[str]], Iterator[pa.RecordBatch]], **added: T.DataType) -> DataFrame:
    """df, with columns added behind, through a kernel of batches and of the names its batches must have.

    Columns travel under plain names, so that those of df may be any."""
    plain = [f"c{i}" for i in range(len(df.columns) + len(added))]
    kinds = [*(f.dataType for f in df.schema.fields), *added.values()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(plain, kinds)])
    made = df.toDF(*plain[: len(df.columns)]).mapInArrow(lambda batches: kernel(batches, plain), schema)
    return made.toDF(*df.columns, *added)


@contextlib.contextmanager
def borrowed(*caches: dict) -> Iterator[None]:
    """Caches that a kernel fills: emptied at its end, and memory handed back, as the Python worker lives on for other operators."""
    try:
        yield
    finally:
        for c in caches:
            c.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: bounds what a kernel holds besides its input."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sized(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches whose texts have at most so many bytes together, or one row."""
    for b in batches:
        upto = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            until = max(at + 1, int(np.searchsorted(upto, most + (upto[at - 1] if at else 0), "right")))
            yield b.slice(at, until - at)
            at = until
