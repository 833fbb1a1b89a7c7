"""Arrow batches as numpy buffers, in blocks of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 2 << 20


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its len + 1 offsets, which start at 0."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: dict[tuple, object] = {}


def _stage() -> int | None:
    task = TaskContext.get()
    return task.stageId() if task else None


def _drop_others() -> None:
    """Drop what another stage kept in this worker."""
    if any(stage != _stage() for stage, _ in _kept):
        _kept.clear()
        gc.collect()
        release()


def kept(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, shared by the tasks of one stage in a worker; the first ``blocks`` of another stage drop it."""
    _drop_others()
    if (_stage(), key) not in _kept:
        _kept[_stage(), key] = make()
    return _kept[_stage(), key]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    _drop_others()
    try:
        for batch in batches:
            _, at = strings(batch.column(text))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
                yield batch.slice(start, end - start)
                start = end
            del batch, at
    finally:
        release()


#: The type of a column that keeps its own, such as ids.
OWN = pa.null()


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """Columns as a batch of ``schema``; those of type ``OWN`` are arrays and stay as they are."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    arrays = [a if f.type in (OWN, a.type) else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def with_id(frame: DataFrame, id_col: str, fields: str, name: str = "doc_id") -> T.StructType:
    """The schema of ``name``, of the type that ``frame`` has for ``id_col``, and the fields."""
    return T.StructType([T.StructField(name, frame.schema[id_col].dataType), *T.StructType.fromDDL(fields).fields])


def unused(name: str, columns: list[str]) -> str:
    """``name``, or with underscores behind it if a column is called so, in whatever case."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
JOIN = np.uint64(0x9E3779B97F4A7C15)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One value of two. Both are mixed already, and the result is, so no pattern of repeats cancels out over several steps."""
    return mix(x * JOIN + y)


class Doubling:
    """Hashes of byte ranges of a buffer, from hashes of all runs of 1, 2, 4 .. bytes, each joined from two of half its length."""

    def __init__(self, data: np.ndarray, *sizes: int):
        """Ranges of ``sizes`` bytes or more can be hashed; of each size the largest power of two up to it is kept."""
        wanted = {1 << s.bit_length() - 1 for s in sizes}
        self.runs: dict[int, np.ndarray] = {}
        have, size = BYTE_HASH[data], 1
        while True:
            if size in wanted:
                self.runs[size] = have
            if size >= max(wanted) or len(have) <= size:
                break
            have = joined(have[: len(have) - size], have[size:])
            size *= 2

    def windows(self, k: int) -> np.ndarray:
        """The hash of every k bytes that stand together."""
        size = 1 << k.bit_length() - 1
        run = self.runs.get(size, np.zeros(0, np.uint64))
        n = max(len(run) - (k - size), 0)
        return joined(run[:n], run[k - size : k - size + n])

    def ranges(self, starts: np.ndarray, ends: np.ndarray, least: int, most: int) -> np.ndarray:
        """The hash of each range, of ``least`` to ``most`` bytes: runs that cover it, spread evenly, and its length."""
        size = 1 << least.bit_length() - 1
        run, length = self.runs[size], ends - starts
        steps = max(1, -(-most // size) - 1)
        total = length.astype(np.uint64)
        for i in range(steps + 1):
            total = joined(total, run[starts + (length - size) * i // steps])
        return total
