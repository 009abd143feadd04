"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What words are separated by: the space and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only a session that names none (a local test) gets a temporary folder, and only if its master is local.
    """
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if not shared:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    if not set_.isDefined():
        sc.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of `df` by writing it to the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def record_batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts with "" for null."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of `key`; all rows if there are no more. Same rows each time."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts stand in a task as Python strings at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def runs(batches: Iterator[pa.RecordBatch], columns: int, at_once: int | None = None) -> Iterator[list[np.ndarray]]:
    """The first columns of batches sorted by the first one, as arrays that end only where its value changes.

    With `at_once`, more rows of one value than that come in several arrays.
    """
    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if not len(new[0]):
            continue
        cut = int(np.searchsorted(new[0], new[0][-1]))  # the last value may go on in the next batch
        if cut or (held and held[-1][0][-1] != new[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in new], strict=True)]
            held = []
        held.append([x[cut:] for x in new])
        if at_once and sum(len(x[0]) for x in held) > at_once:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def positional(rows: DataFrame) -> DataFrame:
    """`rows` with its columns named c0, c1, ... by place: no name of theirs then clashes or needs quoting."""
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Task) -> Task:
    """`run`, and then what it has freed goes back to the system: Spark keeps the Python process for later tasks."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return task
