"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task works on at a time.
BLOCK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % parts, F.lit(-1))


def pick(docs: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named columns under the given names; other columns of ``docs`` cannot clash."""
    return docs.select(*((docs[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def blocks(batches: Iterator[pa.RecordBatch], text_at: int, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds much more than ``size`` bytes of text (or one single text)."""
    for batch in batches:
        pieces = max(1, round(batch.column(text_at).get_total_buffer_size() / size))
        step = max(1, -(-batch.num_rows // pieces))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_blocks(rows: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose tasks get their rows in batches of about ``BLOCK_BYTES`` (or one single row).

    Spark's own bound is 64 MB: each task would hold several such batches, in the JVM and in its Python worker, which both keep the room.
    Workers outlive the job that started them: a task drops what other operators kept there, and gives free room back at its end.
    """
    owner = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = _shelf()
        if getattr(shelf, "owner", owner) != owner:
            shelf.__dict__.clear()
        shelf.owner = owner
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
    return rows.mapInArrow(task, schema)


def _shelf() -> types.ModuleType:
    return sys.modules.setdefault("_corpus_worker_shelf", types.ModuleType("_corpus_worker_shelf"))


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """A value built once per Python worker and reused by its later tasks, until another operator's task runs there."""
    shelf = _shelf()
    if not hasattr(shelf, name):
        setattr(shelf, name, make())
    return getattr(shelf, name)

