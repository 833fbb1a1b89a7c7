"""Benchmark decontamination by winnowing.

Method. Of the hashes of all runs of ``K`` words, the least one in every window of ``SPAN - K + 1`` such runs is kept
as a fingerprint, with all its ties. A span of ``SPAN`` words that a document shares with a benchmark item
holds exactly one such window, so both sides keep the same fingerprint from it: fingerprints of documents
are joined with those of the items, and around each hit the windows of ``SPAN`` words that hold it are looked up among the
items' windows; hits that overlap make up the whole shared span. So every shared span of ``SPAN`` words or more is found,
and nothing is compared but what a fingerprint has met. An item of fewer words is a window of its own length.

A benchmark of at most ``BLOCK_WORD_BYTES`` of text, which its measured size decides, goes to the executors as one index of fixed size
bound, and documents are read once, narrow, without a shuffle. A larger one stays in tables: fingerprints, then windows, are joined on the
cluster, and nothing of it comes to the driver. Both ways give the same rows. No pairs of places are made, so
repeated items and texts cost a row a place. Words and windows are compared by 64-bit hashes, texts are addressed by theirs.

A null or wordless text has no hits and is not contaminated. Items without words never occur; a null
item id counts as the id ``null``, and repeated ids are one item. An empty benchmark finds nothing. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaduct.llm.batches import OWN, blocks, strings, table, unused, with_id
from viaduct.llm.words import Words, gram_hashes, grams, spans
from viaduct.session import materialize

K, SPAN, BLOCK_WORD_BYTES = 5, 13, 8 << 20


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over each w consecutive values, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(hashes: np.ndarray, begin: np.ndarray, w: int) -> np.ndarray:
    """Positions of the hashes that are least in a window of w; windows stay inside begin[d] .. begin[d + 1]."""
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    least = _slide(hashes, w, np.minimum).copy()
    for b in begin[1:-1]:
        least[max(0, b - w + 1) : b] = 0  # windows that reach into the next text
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero((_slide(padded, w, np.maximum) == hashes) & (hashes != 0))


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word (in the block) of every fingerprint."""
    gram, begin = words.grams(K)
    at = winnow(gram, begin, SPAN - K + 1)
    text = np.searchsorted(begin, at, side="right") - 1
    return gram[at], text, at - begin[text] + words.first[text]


def windows_around(words: Words, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of the windows of ``SPAN`` words that hold a fingerprint at ``place``, each once."""
    low = np.maximum(place - (SPAN - K), words.first[text])
    high = np.minimum(place, words.first[text + 1] - SPAN)
    start = np.unique(spans(low, np.maximum(high - low + 1, 0)))
    return gram_hashes(words.hash, start, SPAN), np.searchsorted(words.first, start, side="right") - 1, start


def item_windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and length of every window of items, shorter items being one each."""
    gram, begin = words.grams(SPAN)
    found = [(gram, np.repeat(np.arange(len(words.counts)), np.diff(begin)), np.full(len(gram), SPAN))]
    for m in range(1, SPAN):
        rows = np.flatnonzero(words.counts == m)
        found.append((gram_hashes(words.hash, words.first[rows], m), rows, np.full(len(rows), m)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows_of_length(words: Words, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of all runs of m words."""
    gram, begin = grams(words.hash, words.first, m)
    text = np.repeat(np.arange(len(words.counts)), np.diff(begin))
    return gram, text, np.arange(len(gram)) - begin[text] + words.first[text]


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, ids: list[str], texts: pa.Array):
        words = Words(*strings(texts))
        self.ids, number = np.unique(np.array(ids, object), return_inverse=True)
        self.prints = np.unique(fingerprints(words)[0])
        key, item, length = item_windows(words)
        item = number[item]
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        key, self.items = key[new], item[new]
        self.windows, first = np.unique(key, return_index=True)
        self.first = np.append(first, len(key))
        self.short = [m for m in range(1, SPAN) if (length == m).any()]

    def find(self, words: Words) -> tuple[np.ndarray, ...]:
        """Text, first word (in the block), length and window number of every hit."""
        key, text, place = fingerprints(words)
        met = _among(key, self.prints)
        met = met >= 0
        found = [(*windows_around(words, text[met], place[met]), SPAN)]
        found += [(*windows_of_length(words, m), m) for m in self.short]
        out = []
        for key, text, start, m in found:
            at = _among(key, self.windows)
            hit = np.flatnonzero(at >= 0)
            out.append((text[hit], start[hit], np.full(len(hit), m), at[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Where each value stands among others; -1 if it doesn't."""
    at = np.minimum(np.searchsorted(ascending, values), max(len(ascending) - 1, 0))
    return np.where(ascending[at] == values, at, -1) if len(ascending) else np.full(len(values), -1)


class Hits:
    """Of each text of a block: its words, the shared spans (in words, apart and ascending) and the items that occur."""

    def __init__(self, n_words: np.ndarray, spans: list[list[tuple[int, int]]], items: list[list[str]]):
        self.n_words, self.spans, self.items = n_words, spans, items
        self.n_hit = np.array([sum(n for _, n in x) for x in spans], np.int64)

    def contaminated(self, share: int) -> np.ndarray:
        return (self.n_hit > 0) & (share * self.n_hit >= self.n_words)


def _merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, n in sorted(places):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n - out[-1][0])
        else:
            out.append([start, n])
    return [tuple(x) for x in out]


def _items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` of the items, each once."""
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()


def _by_index(docs: DataFrame, items: DataFrame, text_col: str, finish: Callable, schema: T.StructType) -> DataFrame:
    rows = items.toArrow().combine_chunks()  # at most BLOCK_WORD_BYTES of text
    column = rows.column("text")
    index = Index(rows.column("id").to_pylist(), column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)) if rows.num_rows else None

    def search(batches: Iterator[pa.RecordBatch]):
        for batch in blocks(batches, text_col):
            words = Words(*strings(batch.column(text_col)))
            places: list[list] = [[] for _ in range(batch.num_rows)]
            named: list[set] = [set() for _ in range(batch.num_rows)]
            if index is not None:
                text, start, length, window = index.find(words)
                for t, s, n in zip(text.tolist(), (start - words.first[text]).tolist(), length.tolist(), strict=True):
                    places[t].append((s, n))
                for t, w in np.unique(np.stack([text, window]), axis=1).T.tolist():
                    named[t].update(index.items[index.first[w] : index.first[w + 1]].tolist())
            yield finish(batch, Hits(words.counts, [_merged(x) for x in places], [sorted(index.ids[i] for i in x) for x in named]))

    return docs.mapInArrow(search, schema)


PLACES = "t bigint, start int, n int, key bigint"
_places = pa.schema([("t", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64())])


def _by_join(docs: DataFrame, items: DataFrame, text_col: str, finish: Callable, schema: T.StructType) -> DataFrame:
    kinds = pa.schema([("id", pa.string()), ("key", pa.int64()), ("n", pa.int32())])

    def describe(batches):
        """Windows (n is their length) and fingerprints (n is 0) of items."""
        for batch in blocks(batches, "text"):
            words = Words(*strings(batch.column("text")))
            key, item, length = item_windows(words)
            prints, text, _ = fingerprints(words)
            row = np.concatenate([item, text])
            yield table(kinds, batch.column("id").take(pa.array(row)), np.concatenate([key, prints]).view(np.int64), np.concatenate([length, np.zeros(len(prints), np.int64)]))

    wanted = materialize(items.mapInArrow(describe, "id string, key bigint, n int").distinct(), "benchmark-windows")
    short = sorted(r[0] for r in wanted.where(f"n between 1 and {SPAN - 1}").select("n").distinct().collect())  # at most SPAN - 1 lengths

    def row(words: Words, batch: pa.RecordBatch, found: tuple, n: int) -> pa.RecordBatch:
        key, text, start = found
        return table(_places, batch.column("t").take(pa.array(text)), start - words.first[text], np.full(len(text), n), key.view(np.int64))

    def first(batches):
        """Fingerprints (n is 0), and all runs that are as long as a short item."""
        for batch in blocks(batches, "text"):
            words = Words(*strings(batch.column("text")))
            yield row(words, batch, fingerprints(words), 0)
            for m in short:
                yield row(words, batch, windows_of_length(words, m), m)

    def second(batches):
        """The windows around fingerprints that were met."""
        for batch in blocks(batches, "text"):
            words = Words(*strings(batch.column("text")))
            met = batch.column("met")
            text = np.repeat(np.arange(batch.num_rows), np.diff(met.offsets.to_numpy()))
            yield row(words, batch, windows_around(words, text, met.flatten().to_numpy().astype(np.int64) + words.first[text]), SPAN)

    address = F.xxhash64(F.col(text_col))
    texts = docs.select(address.alias("t"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).dropDuplicates(["t"])
    places = materialize(texts.mapInArrow(first, PLACES).join(wanted.select("key", "n").distinct(), ["key", "n"], "left_semi").select("t", "start", "n", "key"), "benchmark-places")
    met = places.where("n = 0").groupBy("t").agg(F.collect_set("start").alias("met"))
    around = texts.join(met, "t").mapInArrow(second, PLACES)
    hits = materialize(places.where("n > 0").unionByName(around).join(wanted.where("n > 0").select("key", "n").distinct(), ["key", "n"], "left_semi"), "benchmark-hits")
    spots = hits.groupBy("t").agg(F.collect_set(F.struct("start", "n")).alias("spots"))
    ids = hits.select("t", "key", "n").distinct().join(wanted, ["key", "n"]).groupBy("t").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # as many as the benchmark has
    t, spot, named = (unused(x, docs.columns) for x in ("hit_text", "hit_spots", "hit_ids"))
    found = materialize(spots.join(ids, "t").toDF(t, spot, named), "benchmark-found")
    joined = docs.withColumn(t, address).join(found, t, "left").drop(t)

    def end(batches):
        for batch in blocks(batches, text_col):
            words = Words(*strings(batch.column(text_col)))
            spots, ids = (batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))
            own = pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2])
            yield finish(own, Hits(words.counts, [_merged([(s["start"], s["n"]) for s in x or ()]) for x in spots], [x or [] for x in ids]))

    return joined.select(*docs.columns, spot, named).mapInArrow(end, schema)


def scan(docs: DataFrame, benchmark: DataFrame, finish: Callable, schema: T.StructType, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``finish(batch, hits)`` of all documents, as rows of ``schema``."""
    items = _items_of(benchmark, item_id_col, item_text_col)
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    way = _by_index if size <= BLOCK_WORD_BYTES else _by_join
    return way(docs, items, text_col, finish, schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **item_columns) -> tuple[DataFrame, str, str]:
    """``docs`` with the shared spans and item ids of each text in two more columns, whose names are returned.

    Spans are ``array<struct<start, length>>`` in words of the text; both are null without a hit.
    """
    hits, items = unused("hits", docs.columns), unused("hit_items", docs.columns)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{hits}` array<struct<start:int,length:int>>, `{items}` array<string>").fields])
    kinds = (pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])), pa.list_(pa.string()))

    def attach(batch: pa.RecordBatch, found: Hits) -> pa.RecordBatch:
        spans = [[{"start": s, "length": n} for s, n in x] or None for x in found.spans]
        columns = [*batch.columns, pa.array(spans, kinds[0]), pa.array([x or None for x in found.items], kinds[1])]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, hits, items])

    return scan(docs, benchmark, attach, schema, text_col, **item_columns), hits, items


DIGEST = pa.schema([("doc_id", OWN), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: hit words are a share-th of the words or more."""

    def digest(batch: pa.RecordBatch, found: Hits) -> pa.RecordBatch:
        sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found.items]
        return table(DIGEST, batch.column("doc_id"), found.n_words, found.n_hit, [len(x) for x in found.items], sums, found.contaminated(share))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scan(rows, benchmark, digest, with_id(rows, "doc_id", "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int = 20, **item_columns) -> DataFrame:
    """The documents that aren't contaminated, all columns as they are."""

    def clean(batch: pa.RecordBatch, found: Hits) -> pa.RecordBatch:
        return batch.filter(pa.array(~found.contaminated(share)))

    return scan(docs, benchmark, clean, docs.schema, text_col, **item_columns)
