"""Small helpers shared by the operators: Arrow batches, shared folders, table sizes."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, shared_dir


#: Bytes of texts, binaries and lists that are worked on at once.
SLICE = 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in turn, cut into parts of at most :data:`SLICE` bytes or one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            size += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    upto, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: What modules keep in a worker between tasks.
_KEPT = {"bpe_replay": ("_CODERS", "_BYTES"), "token_counts": ("_COUNTERS",), "token_align": ("_ALIGNERS",)}


def _only(module: str) -> None:
    """Drop what other operators left in this worker, which serves the tasks of all of them in turn."""
    package = __name__.rsplit(".", 1)[0]
    for name, kept in _KEPT.items():
        loaded = sys.modules.get(f"{package}.{name}")
        if loaded is not None and loaded.__name__ != module:
            for cache in kept:
                getattr(loaded, cache).clear()


def _returned() -> None:
    """Give the memory that a task has freed back, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterable[dict | None]],
                ) -> DataFrame:
    """``df.mapInArrow`` where ``work`` turns one record batch into dicts of columns.

    ``work`` gets slices of :data:`SLICE` bytes, so that a task's Python memory follows that size
    (or one longer row) and neither the partition nor the rows that Spark puts into a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _only(work.__module__)
        for batch in batches:
            for part in slices(batch):
                for columns in work(part):
                    yield pa.RecordBatch.from_pydict(columns)
        _returned()
    return df.mapInArrow(run, schema)


def rows_where(df: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text ``keep`` accepts."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _only(keep.__module__)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part.column(place).to_pylist()), pa.bool_()))
        _returned()
    return df.mapInArrow(run, df.schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of ``frames`` is called so, in whatever case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Folders that this process has written and not deleted, oldest first.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share (see :func:`churnlens.session.shared_dir`)."""
    _MADE.append(f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives
    lost executors, and is not computed again by its second reader."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, kept: DataFrame | None = None) -> int:
    """Delete the folders written so far, but for those that ``kept`` reads; how many went.  For the
    end of a job, when its results have been written: a frame that reads a deleted folder fails."""
    held = kept.inputFiles() if kept is not None else []
    gone = [path for path in _MADE if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in held)]
    for path in gone:
        delete_path(spark, path)
        _MADE.remove(path)
    return len(gone)


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
