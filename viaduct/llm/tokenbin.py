"""Token-ID output: one concatenated id array with Elias-Fano encoded document boundaries.

Method. The boundaries 0 = b0 <= b1 <= .. <= bn of n documents over u ids take n * (2 + log2(u / n)) bits:
each boundary's low ``l`` bits stand packed in one array, its high part in unary in a bit vector. A
directory holds the bit position of every 256th one (32-bit), so ``select`` scans at most 256 ones to
return a boundary; no 64-bit offset table exists.

A shard is one row of a Parquet table, ``part, block, before, n_docs, n_tokens, doc_ids, payload``, and
``payload`` is the file format: header, directory, high bits, low bits, ids. Shards follow ascending
ids: the table is range-partitioned by id, and a part's shards hold at most ``SHARD_TOKENS`` ids, or one
document. Spark's commit protocol makes the shards whole or absent, on any file system; ``export`` gives
plain files. Only one number a partition, its count of ids, comes to the driver.

Nulls: a null text is an empty document (the end id alone). A null id sorts first. Rows with the same id
stay separate documents, in the order of a hash of their texts. An empty table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaduct.llm import tokens
from viaduct.llm.batches import OWN, blocks, release, table
from viaduct.session import shared_folder, shuffle_partitions

MAGIC, STEP = b"VTB1", 256
HEADER = struct.Struct("<4sBBxxIIIII")  # magic, id width, low bits, documents, ids, bytes of directory, of high, of low
SHARD_TOKENS = 1 << 21


def encode_boundaries(bounds: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Low-bit width, directory, high bits and low bits of nondecreasing integers below 2**32."""
    n, top = len(bounds), int(bounds[-1]) if len(bounds) else 0
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    b = bounds.astype(np.uint64)
    ones = (b >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    low = ((b[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
    return width, ones[::STEP].astype("<u4").tobytes(), pack(high), pack(low)


class Boundaries:
    """Select over an encoded shard."""

    def __init__(self, width: int, directory: bytes, high: bytes, low: bytes, n: int):
        self.width, self.n = width, n
        self.directory = np.frombuffer(directory, "<u4")
        self.high, self.low = np.frombuffer(high, np.uint8), np.frombuffer(low, np.uint8)

    def _lows(self, first: int, last: int) -> np.ndarray:
        bits = np.unpackbits(self.low[first * self.width // 8 : -(-last * self.width // 8)], bitorder="little")
        skip = first * self.width % 8
        bits = bits[skip : skip + (last - first) * self.width].reshape(last - first, self.width).astype(np.int64)
        return bits @ (1 << np.arange(self.width, dtype=np.int64)) if self.width else np.zeros(last - first, np.int64)

    def select(self, i: int) -> int:
        """The i-th boundary, from the directory and the ones after its entry."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.directory[i // STEP])
        left, byte = i % STEP, at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i << self.width) + int(self._lows(i, i + 1)[0])

    def selected(self, which: np.ndarray) -> np.ndarray:
        """Many boundaries, whose numbers ascend: ``select`` of all of them, over the bits between the first one's and the last one's entries."""
        if not len(which):
            return np.zeros(0, np.int64)
        first, last = int(which[0]) // STEP, int(which[-1]) // STEP
        begin = int(self.directory[first]) // 8
        stop = int(self.directory[last + 1]) // 8 + 1 if last + 1 < len(self.directory) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:stop], bitorder="little")) + begin * 8
        ones = ones[np.searchsorted(ones, int(self.directory[first])) :][which - first * STEP]
        low = self._lows(int(which[0]), int(which[-1]) + 1)[which - which[0]]
        return (ones - which << self.width) + low


def write_shard(docs: list[bytes], width: int) -> bytes:
    bounds = np.cumsum([0, *(len(d) // width for d in docs)])
    low_bits, directory, high, low = encode_boundaries(bounds)
    head = HEADER.pack(MAGIC, width, low_bits, len(docs), int(bounds[-1]), len(directory), len(high), len(low))
    return b"".join([head, directory, high, low, *docs])


class Shard:
    """A shard's payload, read in place."""

    def __init__(self, payload):
        view = memoryview(payload)
        magic, width, low_bits, n, total, *sizes = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("no token shard")
        at, parts = HEADER.size, []
        for size in sizes:
            parts.append(view[at : at + size])
            at += size
        self.bounds = Boundaries(low_bits, *parts, n + 1)
        self.ids = np.frombuffer(view, f"<u{width}", total, at)
        self.n = n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


SHARDS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", OWN), ("payload", pa.binary())])
SHARDS_SQL = "part int, block int, before bigint, n_docs bigint, n_tokens bigint"


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the ids of all texts, each with the end id, in ascending order of ``id_col``; returns the path."""
    spark, name = docs.sparkSession, tokenizer or tokens.default_path()
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

    def encode(batches):
        part, ids, held, size, block, before = TaskContext.get().partitionId(), [], [], 0, 0, 0
        coder = tokens.encoder(name)
        end = end_id.to_bytes(coder.width, "little")

        def shard(kind):
            row = [[part], [block], [before], [len(held)], [size], pa.array([ids], pa.list_(kind)), [write_shard(held, coder.width)]]
            return table(SHARDS, *row)

        for batch in blocks(batches, "text"):
            kind = batch.column("id").type
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc = coder.ids(text) + end
                if held and size + len(doc) // coder.width > shard_tokens:
                    yield shard(kind)
                    before, block = before + size, block + 1
                    ids, held, size = [], [], 0
                ids.append(key)
                held.append(doc)
                size += len(doc) // coder.width
        if held:
            yield shard(kind)

    # a common id, or none, doesn't gather in one task: the texts' hash and a number of the row go on
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("n"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "id", "h", "n").sortWithinPartitions("id", "h", "n").select("id", "text")
    kind = T.ArrayType(docs.schema[id_col].dataType)
    schema = T.StructType([*T.StructType.fromDDL(SHARDS_SQL).fields, T.StructField("doc_ids", kind), T.StructField("payload", T.BinaryType())])
    rows.mapInArrow(encode, schema).write.parquet(path)
    return path


READ = pa.schema([("doc_id", OWN), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(spark, path: str) -> DataFrame:
    """Per document, from the shards: ``doc_id, start, n_tokens, ids_crc32`` (of the ids as 32-bit integers)."""
    shards = spark.read.parquet(path)
    sums = dict(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row a partition
    base, total = {}, 0
    for part in sorted(sums):
        base[part], total = total, total + sums[part]

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column("payload")[row].as_buffer())
                bounds = shard.bounds.selected(np.arange(shard.n + 1))
                sums = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                start = bounds[:-1] + (base[batch.column("part")[row].as_py()] + batch.column("before")[row].as_py())
                yield table(READ, batch.column("doc_ids")[row].values, start, np.diff(bounds), sums)
            release()

    ids = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", ids), *T.StructType.fromDDL("start bigint, n_tokens bigint, ids_crc32 bigint").fields])
    return shards.select("part", "before", "doc_ids", "payload").mapInArrow(decode, schema)


def export(shard_row, path: str) -> None:
    """One shard as a plain file for loaders that map files."""
    with open(path, "wb") as f:
        f.write(shard_row["payload"])
