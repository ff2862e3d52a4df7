"""Walking whole texts inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import ARROW, arrow_schema, to_batch  # noqa: F401 - the operators take them from here

CHUNK_CHARS = 1_000_000


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[list[dict]]:
    """Rows in lists of about CHUNK_CHARS characters; a null text stays None. At the
    end the worker, which Spark keeps for later tasks, gives unused memory back."""
    rows, held = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            for row in batch.slice(start, 64).to_pylist():
                rows.append(row)
                held += len(row[text] or "")
                if held >= CHUNK_CHARS:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows
    give_back()


def give_back() -> None:
    """Unused memory, of Arrow's pool and of the C library's heap where it can, goes back
    to the system: a worker waits for its next task with what it needs alone."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_chunks(df: DataFrame, work: Callable[[list[dict]], list[tuple]], ddl: str, done: Callable[[], None] | None = None) -> DataFrame:
    """df through work, which turns a chunk of rows into tuples of ddl's columns;
    done is called at the end of a partition."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            yield to_batch(work(rows), schema)
        if done:
            done()

    return df.mapInArrow(run, ddl)


ROWS_PER_TASK = 50_000


def gathered(df: DataFrame) -> tuple[DataFrame, int]:
    """A written df in as many partitions as its counted rows need, and their number: a
    shuffle of few rows then costs few files, not one a task."""
    rows = df.count()
    parts = max(1, -(-rows // ROWS_PER_TASK))
    return df.coalesce(parts), rows


def fold(doc_id: str, parts: int):
    """crc32 of the id's text, modulo parts."""
    return F.crc32(F.col(doc_id).cast("string")) % parts
