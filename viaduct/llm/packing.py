"""Best-fit packing of token sequences, bulk-synchronous.

Method. Documents are cut into pieces of at most ``capacity`` tokens; pieces and the gaps left in open
sequences are kept in sorted order, every piece's successor is the smallest gap that holds it, conflicts
for one gap go by rank, gaps are updated, and the sweep repeats for the pieces that are left. Lengths and
gaps are integers up to ``capacity``, so both sorted lists are held as runs (value, count): a sweep moves
over at most ``capacity`` runs and settles whole runs at once, however many documents stand in them.
The sweep yields a plan of O(capacity) rows, "pieces of length L with ranks a to b fill sequences s.., t
in each, from offset o", independent of the corpus; each piece finds its own row by its length and rank,
on the executors. Ranks come from prefix sums of counts by (length, partition), so no length, not even that
of the full pieces, is ever gathered in one task. The result is what best-fit decreasing gives.

The pieces are written once to the shared folder, so ranks stay fixed if executors are lost. A null text
is an empty document (the end id alone). Ids may be null or repeated: each row is a document.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm import tokens
from viaduct.llm.batches import OWN, blocks, table, with_id
from viaduct.session import materialize

PIECES = pa.schema([("doc_id", OWN), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])
PIECES_SQL = "piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"


def cut(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, with ``part`` and ``local``, the piece's rank among those of its length in that part."""
    name = tokenizer or tokens.default_path()

    def pieces(batches):
        coder = tokens.encoder(name)
        end, part = end_id.to_bytes(coder.width, "little"), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in blocks(batches, "text"):
            keys: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.frombuffer(coder.ids(text) + end, f"<u{coder.width}").astype("<u4")
                for n, at in enumerate(range(0, len(ids), capacity)):
                    one = ids[at : at + capacity]
                    keys.append(i)
                    rows.append((n, at, len(one), zlib.crc32(one), part, int(seen[len(one)])))
                    seen[len(one)] += 1
            yield table(PIECES, batch.column("id").take(pa.array(keys)), *zip(*rows, strict=True))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, with_id(docs, id_col, PIECES_SQL))


def sweep(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The plan: rows ``length, first rank, ranks, first sequence, in each sequence, offset``."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes of gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # size -> (first sequence, sequences)
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)  # the successor
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            whole = min(n, left // each)
            if whole:
                plan.append((length, rank, whole * each, first, each, capacity - gap))
                leave(gap - each * length, first, whole)
                rank, left, first, n = rank + whole * each, left - whole * each, first + whole, n - whole
            if n and left:
                plan.append((length, rank, left, first, left, capacity - gap))
                leave(gap - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            leave(gap, first, n)
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


PLACED = pa.schema([("doc_id", OWN), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``."""
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_part = materialize(by_part, "packing-counts")
    counts = dict(by_part.groupBy("length").agg(F.sum("n")).collect())  # at most capacity rows
    plan = sweep(counts, capacity)
    keys = plan[:, 0] << 44 | plan[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the counts grow with the partitions, so they are not broadcast; a length and part is no hot key
    ranked = pieces.join(base.hint("shuffle_hash"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first, _, sequence, each, offset = plan[np.searchsorted(keys, length << 44 | rank, side="right") - 1].T
            nth = rank - first
            yield table(PLACED, *(batch.column(c) for c in PLACED.names[:5]), sequence + nth // each, offset + nth % each * length)

    return ranked.mapInArrow(assign, with_id(pieces, "doc_id", "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"))


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, one row a piece."""
    return place(materialize(cut(docs, capacity, tokenizer, end_id, id_col, text_col), "packing-pieces"), capacity)
