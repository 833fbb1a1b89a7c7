"""Removal of byte strings that stand anywhere else, by maximal repeats of an enhanced suffix array.

Method. A suffix array (suffixes in order, with the length of the prefix that neighbours share) is scanned
with a stack; every interval of suffixes with a common prefix of ``LENGTH`` bytes or more, whose occurrences differ in
the byte before them, is a maximal repeat, and all its occurrences are known, not just neighbours.

One array over a corpus would not fit a machine, so suffixes are dealt by content. In each ``LENGTH``-byte window
the ``KEY``-byte string with the least hash is the window's anchor; equal windows have equal anchors at equal
offsets, so they meet under the anchor's hash. A document has an anchor for some 60 bytes on average.
Anchors whose whole surroundings (all windows that belong to them) agree with another's are repeats at
once; this is settled inside each block of text first, which leaves one row a block of a hot passage or a
periodic text, then over all documents in a sorted stream that looks one row back and ahead. What is left
are anchors near the ends of repeats: their surroundings are fetched and go through the suffix array.

Documents are addressed by a 64-bit hash of id and text. A null text is empty. Two rows with the same id
and the same text are two documents whose bytes occur in each other. Anchors and surroundings are compared
by 64-bit hashes, suffixes by ranks, that is by bytes. A sorted stream of anchors takes no memory in
proportion to a group; a task of the suffix array holds ``TASK_BYTES`` of surroundings and at most ``KEY_ROWS`` of one key. A key of
more, such as that of a passage that very many texts hold, is settled window by window instead: windows are counted by
their hash with map-side combining, in no task of its own. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.batches import OWN, Doubling, blocks, mix, strings, table, with_id
from viaduct.llm.skew import HOT_SHARE, split_join
from viaduct.llm.words import spans as ranges_of
from viaduct.session import materialize, shuffle_partitions

LENGTH, KEY, TASK_BYTES, KEY_ROWS = 200, 72, 1 << 20, 8192


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """Text, first window, anchor, last window (places in the block), hash of the anchor and of its surroundings."""
    each = np.maximum(np.diff(at) - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not each.sum():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    runs = Doubling(data, key, length)
    gram = runs.windows(key)
    # the hash's high half and the place: the leftmost of those with the least high half, in whatever block a window stands
    bits = np.uint64((1 << 32) - 1)
    least = (gram & ~bits) | np.arange(len(gram), dtype=np.uint64)
    have, w = 1, length - key + 1
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    window = ranges_of(at[:-1], each)
    place = (least[window] & bits).astype(np.int64)
    text = np.repeat(np.arange(len(each)), each)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(window)]]) - 1
    low, high = window[first], window[last]
    return text[first], low, place[first], high, gram[place[first]], runs.ranges(low, high + length, length, 2 * length - key)


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges that are ordered by owner and start, with ends that don't fall inside an owner."""
    if not len(start):
        return owner, start, end
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])])
    head = np.flatnonzero(new)
    return owner[head], start[head], end[np.append(head[1:], len(start)) - 1]


DEALT = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("doc", pa.int64()), ("a", pa.int64())])


def _pack(low, anchor, high, twice):
    return low << 24 | (anchor - low) << 16 | (high - low) << 8 | twice


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to be dealt by ``k``: anchors, one of each kind in a block, and (h null) ranges that the block itself repeats."""
    for batch in blocks(batches, "text"):
        data, at = strings(batch.column("text"))
        text, low, anchor, high, k, h = anchors(data, at)
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        order = np.lexsort((h, k))
        same = (k[order][1:] == k[order][:-1]) & (h[order][1:] == h[order][:-1])
        head = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(head), len(order)))
        twice = np.zeros(len(order), bool)
        twice[order] = np.repeat(size > 1, size)
        one = np.sort(order[head])
        owner, start, end = merged(text[twice], low[twice], high[twice] + LENGTH)
        begin = at[text[one]]
        yield table(DEALT, k[one].view(np.int64), h[one].view(np.int64), doc[text[one]], _pack(low[one] - begin, anchor[one] - begin, high[one] - begin, twice[one]))
        if len(owner):
            base = at[owner]
            yield table(DEALT, mix(doc[owner].view(np.uint64) + start.astype(np.uint64)).view(np.int64), pa.nulls(len(owner), pa.int64()), doc[owner], (start - base) << 32 | (end - base))


ROUTED = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("k", pa.int64()), ("anchor", pa.int64())])
ROUTED_SQL = "doc bigint, start bigint, end bigint, k bigint, anchor bigint"


def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (k, h): repeated ranges (k null), and surroundings that the suffix array has to see."""
    before: tuple | None = None  # the last two rows' keys, and the row that waits for the one after it
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        done = batch.column("h").is_null().to_numpy(zero_copy_only=False)
        a = batch.column("a").to_numpy()
        doc = batch.column("doc").to_numpy()
        if done.any():
            yield table(ROUTED, doc[done], a[done] >> 32, a[done] & 0xFFFFFFFF, pa.nulls(int(done.sum()), pa.int64()), pa.nulls(int(done.sum()), pa.int64()))
        keep = ~done
        rows = np.stack([batch.column("k").to_numpy()[keep], batch.column("h").fill_null(0).to_numpy()[keep], doc[keep], a[keep]])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        if rows.shape[1] > 1:
            yield from _decide(before, rows, None)
            before, held = tuple(rows[:2, -2]), rows[:, -1:]
        else:
            held = rows if rows.shape[1] else held
    if held is not None:
        yield from _decide(before, held, ())


def _decide(before: tuple | None, rows: np.ndarray, after) -> Iterator[pa.RecordBatch]:
    """Decide all rows but the last, or all if nothing comes after."""
    k, h, doc, a = rows
    n = len(k) if after is not None else len(k) - 1
    same_k, same_h = k[1:] == k[:-1], (k[1:] == k[:-1]) & (h[1:] == h[:-1])
    first_k, first_h = before is not None and before[0] == k[0], before is not None and before == (k[0], h[0])
    back_k, back_h = np.concatenate([[first_k], same_k])[:n], np.concatenate([[first_h], same_h])[:n]
    next_k, next_h = np.concatenate([same_k, [False]])[:n], np.concatenate([same_h, [False]])[:n]
    k, doc, a = k[:n], doc[:n], a[:n]
    low = a >> 24
    anchor, end = low + (a >> 16 & 255), low + (a >> 8 & 255) + LENGTH
    full = back_h | next_h | (a & 1 == 1)
    # one of each kind under a key with several kinds: the kind's first row if a kind came before, its last if one follows
    ask = (~back_h & back_k) | (~next_h & next_k)
    nothing = pa.nulls(int(full.sum()), pa.int64())
    yield table(ROUTED, doc[full], low[full], end[full], nothing, nothing)
    yield table(ROUTED, doc[ask], low[ask], end[ask], k[ask], anchor[ask])


def enhanced_suffix_array(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``least`` bytes or more in order, and the length of the prefix that each shares with the one before.

    ``ends[i]`` is the end of the string that byte i belongs to; a suffix ends there. Ranks double in length from
    seven bytes on, and the ranks of all levels give the shared prefixes without comparing bytes again.
    """
    n = len(data)
    left = ends - np.arange(n)
    symbols = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    code = np.zeros(n, np.uint64)
    for j in range(7):  # nine bits a byte; nothing stands behind the end
        code = code << np.uint64(9) | np.where(left > j, symbols[j : j + n], np.uint64(0))
    levels = []
    length, rank = 7, np.unique(code, return_inverse=True)[1].astype(np.int64)
    levels.append((length, rank))
    most = int(left.max(initial=0))
    while length < most:
        behind = np.zeros(n, np.int64)
        behind[: max(n - length, 0)] = rank[length:] + 1
        behind[left <= length] = 0
        rank = np.unique(rank << 32 | behind, return_inverse=True)[1].astype(np.int64)
        length *= 2
        levels.append((length, rank))
    start = np.flatnonzero(left >= least)
    order = start[np.argsort(rank[start], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    x, y = order[1:], order[:-1]
    common = np.zeros(len(x), np.int64)
    for size, rank in levels[::-1]:
        i, j = x + common, y + common
        ok = (ends[x] - i >= size) & (ends[y] - j >= size)
        ok[ok] = rank[i[ok]] == rank[j[ok]]
        common[ok] += size
    for _ in range(6):
        i, j = x + common, y + common
        ok = (ends[x] > i) & (ends[y] > j)
        ok[ok] = data[i[ok]] == data[j[ok]]
        common[ok] += 1
    shared[1:] = common
    return order, shared


def maximal_repeats(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Suffixes in order, and the repeats as intervals (first, last, length) of it.

    A repeat's occurrences differ in the byte before them, or one stands at its string's start.
    """
    order, shared = enhanced_suffix_array(data, ends, least)
    if len(order) < 2:
        return order, []
    head = np.concatenate([[True], ends[1:] != ends[:-1]])
    before = np.where(head[order], 256 + np.arange(len(order)), data[np.maximum(order - 1, 0)].astype(np.int64))
    differ = np.concatenate([[0], np.cumsum(np.concatenate([[False], before[1:] != before[:-1]]))])
    joined = shared >= least
    first = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]])) - 1
    last = np.flatnonzero(joined & ~np.concatenate([joined[1:], [False]]))
    out: list[tuple[int, int, int]] = []
    diverse = differ[last + 1] > differ[first + 1]
    for a, b in zip(first[diverse].tolist(), last[diverse].tolist(), strict=True):
        stack: list[tuple[int, int]] = []  # (shared prefix, left end)
        for i, s in enumerate([*shared[a + 1 : b + 1].tolist(), -1], a + 1):
            left = i - 1
            while stack and stack[-1][0] > s:
                size, left = stack.pop()
                if differ[i] > differ[left + 1]:
                    out.append((left, i - 1, size))
            if s >= least and (not stack or stack[-1][0] < s):
                stack.append((s, left))
    return order, out


def covered(data: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Which bytes stand in a repeated string of ``least`` bytes or more."""
    order, repeats = maximal_repeats(data, ends, least)
    longest = np.zeros(len(order), np.int64)
    for first, last, size in sorted(repeats, key=lambda r: r[2]):
        longest[first : last + 1] = size
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, order, longest > 0)
    np.add.at(change, order + longest, -(longest > 0).astype(np.int64))
    return np.cumsum(change[:-1]) > 0


CONTEXTS = pa.schema([("k", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("around", pa.binary())])
SPANS = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("window", pa.int64())])
SPANS_SQL = "doc bigint, start bigint, end bigint, window bigint"


def windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All windows of ``around``, which stands at ``start`` of ``doc``, with their hashes."""
    data, at = strings(batch.column("around"))
    each = np.maximum(np.diff(at) - LENGTH + 1, 0)
    place = ranges_of(at[:-1], each)
    row = np.repeat(np.arange(len(each)), each)
    start = batch.column("start").to_numpy()[row] + place - at[row]
    return table(SPANS, batch.column("doc").take(pa.array(row)), start, start + LENGTH, Doubling(data, LENGTH).windows(LENGTH)[place].view(np.int64))


def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        data, at = strings(batch.column("text"))
        asked = batch.column("asked")
        text = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
        k, start, end = (asked.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        raw = data.tobytes()
        around = [raw[s:e] for s, e in zip((start + at[text]).tolist(), (end + at[text]).tolist(), strict=True)]
        yield table(CONTEXTS, k, batch.column("doc").take(pa.array(text)), start, pa.array(around, pa.binary()))


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of surroundings that are sorted by key; whole keys go through one suffix array.

    Of a key of more than ``KEY_ROWS``, all windows with their hashes instead.
    """

    def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        data, at = strings(rows.column("around"))
        size = np.diff(at)
        mark = covered(data, np.repeat(at[1:], size), LENGTH)
        owner = np.repeat(np.arange(len(size)), size)
        edge = np.flatnonzero(mark & ~np.concatenate([[False], mark[:-1] & (owner[1:] == owner[:-1])]))
        stop = np.flatnonzero(mark & ~np.concatenate([mark[1:] & (owner[1:] == owner[:-1]), [False]])) + 1
        shift = rows.column("start").to_numpy()[owner[edge]] - at[owner[edge]]
        return table(SPANS, rows.column("doc").take(pa.array(owner[edge])), edge + shift, stop + shift, pa.nulls(len(edge), pa.int64()))

    whole: list[pa.RecordBatch] = []  # rows of keys that have ended
    last: list[pa.RecordBatch] = []  # those of the key that may go on
    last_key, many = None, False
    for batch in blocks(batches, "around", TASK_BYTES // 4):
        k = batch.column("k").to_numpy()
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        if last_key is not None and k[0] == last_key:
            head = batch.slice(0, int(change[0]) if len(change) else len(k))
            if many:
                yield windows_of(head)
            else:
                last.append(head)
        else:
            change = np.concatenate([[0], change])
        if len(change):  # another key begins: the one before has ended
            whole += last
            whole.append(batch.slice(int(change[0]), int(change[-1] - change[0])))
            last, last_key, many = [batch.slice(int(change[-1]))], k[-1], False
        if not many and sum(x.num_rows for x in last) > KEY_ROWS:
            yield from map(windows_of, last)
            last, many = [], True
        if sum(x.get_total_buffer_size() if x.num_rows else 0 for x in whole) >= TASK_BYTES or sum(x.num_rows for x in whole) * LENGTH >= TASK_BYTES:
            yield settle(whole)
            whole = []
    whole += last
    if sum(x.num_rows for x in whole):
        yield settle(whole)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``doc, spans`` from ``doc, text``: sorted byte ranges, which may overlap, of the documents that have any."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    dealt = rows.select("doc", "text").mapInArrow(deal, "k bigint, h bigint, doc bigint, a bigint")
    routed = materialize(dealt.repartition(n, "k").sortWithinPartitions("k", "h").mapInArrow(route, ROUTED_SQL), "repeat-routes")
    left = routed.where(F.col("k").isNotNull())
    total = left.count()
    hot = materialize(left.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > F.greatest(F.lit(KEY_ROWS), F.lit(total / HOT_SHARE))).select("k"), "repeat-hot")  # at most HOT_SHARE keys
    ask = lambda part: part.groupBy("doc").agg(F.collect_set(F.struct("k", "start", "end")).alias("asked"))
    cut = lambda part: rows.join(ask(part), "doc").select("doc", "text", "asked").mapInArrow(surroundings, "k bigint, doc bigint, start bigint, around binary")
    around = cut(left.join(F.broadcast(hot), "k", "left_anti"))
    found = materialize(around.repartition(n, "k").sortWithinPartitions("k").mapInArrow(resolve, SPANS_SQL), "repeat-found")
    windows = found.where("window is not null")
    if not hot.isEmpty():
        hot_rows = materialize(cut(left.join(F.broadcast(hot), "k")), "repeat-hot-rows")
        windows = windows.unionByName(hot_rows.mapInArrow(lambda batches: map(windows_of, blocks(batches, "around", TASK_BYTES)), SPANS_SQL))
    spans = routed.where(F.col("k").isNull()).select("doc", "start", "end").unionByName(found.where("window is null").select("doc", "start", "end"))
    if not windows.isEmpty():
        windows = materialize(windows, "repeat-windows")
        twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
        spans = spans.unionByName(split_join(windows, twice, ["window"], "n", windows.count()).select("doc", "start", "end"))
    return spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def address(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))


REMOVED = pa.schema([("doc_id", OWN), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: every document and the bytes that are left of it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(address(id_col, text_col).alias("doc"), F.col(id_col).alias("doc_id"), text.alias("text"))
    joined = rows.join(repeated_spans(rows), "doc", "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in blocks(batches, "text"):
            data, at = strings(batch.column("text"))
            raw = data.tobytes()
            n_spans, kept = [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                own, parts, end, n = raw[at[i] : at[i + 1]], [], -1, 0
                for s in spans or ():
                    if s["start"] > end:
                        parts.append(own[max(end, 0) : s["start"]])
                        n += 1
                    end = max(end, s["end"])
                parts.append(own[max(end, 0) :])
                n_spans.append(n)
                kept.append(b"".join(parts))
            left = np.array([len(x) for x in kept], np.int64)
            yield table(REMOVED, batch.column("doc_id"), np.diff(at), np.diff(at) - left, n_spans, pa.array(kept, pa.binary()))

    return joined.mapInArrow(cut, with_id(rows, "doc_id", "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    kept = remove_repeats(docs, id_col, text_col)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """Removed bytes, ranges and the digest of the rest, from the definition: for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        n = int(np.count_nonzero(gone[1:] > gone[:-1])) + int(gone[0])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    return out
