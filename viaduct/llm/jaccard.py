"""N-gram Jaccard join of whole texts by PartEnum signatures.

Method. Sets of word shingles fall into size bands. Two sets of a band (or of neighbouring ones) that link
differ in at most d elements, so if a hash deals the domain into d + 1 + s parts, they agree wholly in at
least s + 1 of them: a signature is the hash of one part of a set. Parts of few elements (``weak_parts``)
make poor signatures; a set with at most s of them leaves them out, and still one strong part
is shared; a set with more signs all its parts. No linked pair is lost.

Copies. Documents with equal sets are one class, and classes are joined. Under each signature the least
class is compared with all others (a star, not all pairs). Components of these links are found on the
cluster; then, in a few rounds, only classes of different components that share a signature are compared with each other, and a
sketch of parities, a bit an element, whose Hamming distance never exceeds the true difference, drops nearly all
of these pairs before any set is read. Pairs that are left are compared on their whole sets. So the
components are exact, while a group of near copies costs about one comparison a member and signature. Members of a signature
are dealt to cells of ``CELL`` on a side, so no task holds a hot signature; its largest component is never compared with itself.

Nulls: a null, empty or wordless text has an empty set, links with nothing and is its own component (its
id, which may be null). Rows are addressed by a hash of id and text; repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.llm.batches import OWN, blocks, mix, release, strings, table, unused, with_id
from viaduct.llm.components import components
from viaduct.llm.skew import salted_join, split_join
from viaduct.llm.words import NOT_SPACE, Words, grams, spans
from viaduct.session import Tables, materialize, shuffle_partitions

SPARES = (0.1, 0.15, 0.2, 0.25, 0.3)  # shares of parts beyond what the guarantee needs, to leave weak ones out


def weak_parts(percent: int) -> tuple[int, float]:
    """How many elements make a weak part at most, and the share of spare parts.

    The largest limit for which a spare share leaves out what is expected of weak parts in a set of random elements,
    with half as much to spare; 0 (empty parts) always.
    """
    per_part = 0.85 * (100 + percent) / (2 * (100 - percent)) if percent < 100 else math.inf
    for weak in (2, 1, 0):
        for spare in SPARES:
            mean = per_part / (1 + spare)
            expected = sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(weak + 1)) if mean < 700 else 0.0
            if 1.5 * expected <= spare / (1 + spare):
                return weak, spare
    return 0, SPARES[-1]


@dataclass(frozen=True)
class Bands:
    """Size bands and each band's number of parts, for similarity ``percent`` / 100."""

    percent: int
    low: np.ndarray  # least size of each band
    parts: np.ndarray  # parts of the domain
    spare: np.ndarray  # weak parts that may be left out
    weak: int  # a part of so few elements or less is a weak signature

    @staticmethod
    def of(percent: int, most: int = 1 << 40) -> Bands:
        low = [1]
        while low[-1] <= most:
            low.append(low[-1] * 10_000 // percent**2 + 1)
        high = np.array(low[1:], np.int64) - 1
        # sets that link differ in at most (a + b) (100 - t) / (100 + t) elements
        differ = 2 * high * (100 - percent) // (100 + percent)
        weak, share = weak_parts(percent)
        spare = np.ceil((differ + 1) * share).astype(np.int64) * (differ > 0)
        return Bands(percent, np.array(low[:-1], np.int64), differ + 1 + spare, spare, weak)

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of k words (of all its words if there are fewer), sorted, and where each set begins."""
    words = Words(data, at, NOT_SPACE)
    runs, begin = words.grams(k)
    owner = np.repeat(np.arange(len(words.counts)), np.diff(begin))
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    whole = [grams(words.hash[words.first[d] : words.first[d + 1]], np.array([0, words.counts[d]]), int(words.counts[d]))[0] for d in few]
    if whole:
        runs, owner = np.concatenate([runs, *whole]), np.concatenate([owner, few])
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[new], np.searchsorted(owner[new], np.arange(len(words.counts) + 1))


def set_classes(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One hash of each whole set; 0 for empty ones."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets), dtype=np.uint64)])
    size = np.diff(begin)
    return np.where(size > 0, mix(total[begin[1:]] - total[begin[:-1]] + size.astype(np.uint64)), np.uint64(0))


def signatures(sets: np.ndarray, begin: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hash of every signature of every set, and each set's slack.

    A set may do without so many more of its signatures and still share one with every set that links; -1 if
    even weak parts had to sign.
    """
    size = np.diff(begin)
    owner_of = np.repeat(np.arange(len(size)), size)
    owners, hashes = [], []
    slack = np.full(len(size), 1 << 30, np.int64)
    mixed = mix(sets ^ np.uint64(0xC2B2AE3D27D4EB4F))
    own = bands.band(np.maximum(size, 1))
    for up in (0, 1):
        band = own + up
        # the next band too, if it may hold a larger set that links
        live = (size > 0) & ((up == 0) | (size * 100 // bands.percent >= bands.low[own + 1]))
        parts = np.where(live, bands.parts[band], 0)
        base = np.cumsum(parts) - parts
        total, n = np.zeros(int(parts.sum()), np.uint64), None
        element = live[owner_of]
        slot = base[owner_of[element]] + (sets[element] % parts[owner_of[element]].astype(np.uint64)).astype(np.int64)
        np.add.at(total, slot, mixed[element])
        n = np.bincount(slot, minlength=len(total))
        doc = np.repeat(np.arange(len(size)), parts)
        weak = n <= bands.weak
        left = bands.spare[band] - np.bincount(doc[weak], minlength=len(size))
        many = left < 0
        slack = np.where(live, np.minimum(slack, np.maximum(left, -1)), slack)
        keep = np.flatnonzero(~weak | many[doc])
        part = (keep - base[doc[keep]]).astype(np.uint64)
        hashes.append(mix(total[keep] + mix(part << np.uint64(8) | band[doc[keep]].astype(np.uint64))))
        owners.append(doc[keep])
    return np.concatenate(owners), np.concatenate(hashes), slack


LEAST_BITS, PAIRS = 256, 500_000


def sketches(sets: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Parity bits of each set, the next power of two above twice its size: two sets' distance is at most the number of elements they differ in."""
    size = np.diff(begin)
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), size)
    place = base[owner] + (mix(sets ^ np.uint64(0x165667B19E3779F9)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    whole = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [whole[s // 8 : e // 8] for s, e in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


class Sketches:
    """Sketches of many sets in one buffer."""

    def __init__(self, *columns: pa.Array | pa.ChunkedArray):
        chunks = [strings(c) for column in columns for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
        self.words = np.concatenate([data for data, _ in chunks]).view(np.uint64)
        self.size = np.concatenate([np.diff(at) for _, at in chunks]) // 8
        self.start = np.cumsum(self.size) - self.size

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Hamming distances of pairs of rows; the longer sketch is folded to the shorter one's length."""
        out = np.zeros(len(x), np.int64)
        kind = np.maximum(self.size[x], self.size[y]) << 32 | np.minimum(self.size[x], self.size[y])
        for k in np.unique(kind).tolist():
            long, short = k >> 32, k & 0xFFFFFFFF
            at = np.flatnonzero(kind == k)
            swap = self.size[x[at]] < self.size[y[at]]
            for part in np.array_split(np.arange(len(at)), 1 + len(at) * long // (1 << 21)):
                i, j = np.where(swap, y[at], x[at])[part], np.where(swap, x[at], y[at])[part]
                a, b = self.words[self.start[i][:, None] + np.arange(long)], self.words[self.start[j][:, None] + np.arange(short)]
                while a.shape[1] > short:
                    half = a.shape[1] // 2
                    a = a[:, :half] ^ a[:, half:]
                out[at[part]] = np.bitwise_count(a ^ b).sum(axis=1)
        return out


COARSE_BYTES = 64


def coarse(sketch: bytes) -> bytes:
    """A quarter of a sketch's length, but ``COARSE_BYTES`` at least: what travels with every member of a signature."""
    words = np.frombuffer(sketch, np.uint64)
    for _ in range(2):
        if 8 * len(words) > COARSE_BYTES:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words.tobytes()


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements sets of sizes a, b that link can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def may_link(n: np.ndarray, sketch: Sketches, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of rows x, y those whose sets, of sizes n, can link, with their distances in sketches."""
    near = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
    x, y = x[near], y[near]
    far = sketch.distance(x, y)
    ok = far <= most_apart(n[x], n[y], percent)
    return x[ok], y[ok], far[ok]


BROADCAST_ROWS, HEAVY, FORESTS, SPARSE = 500_000, 32, 1, 2
SETS = pa.schema([("doc_id", OWN), ("doc", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sketch", pa.binary()), ("coarse", pa.binary())])


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def describe(batches):
        for batch in blocks(batches, "text"):
            sets, begin = shingle_sets(*strings(batch.column("text")), k)
            found = sketches(sets, begin)
            yield table(SETS, batch.column("doc_id"), batch.column("doc"), np.diff(begin), set_classes(sets, begin).view(np.int64), pa.array(found, pa.binary()), pa.array(map(coarse, found), pa.binary()))

    return docs.mapInArrow(describe, with_id(docs, "doc_id", "doc bigint, n bigint, cls bigint, sketch binary, coarse binary"))


def _stars(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``sig, head, cls, slack, head_slack``: under each signature the least class and every other one."""
    bands = Bands.of(percent)
    signed = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("slack", pa.int32())])
    starred = pa.schema([("sig", pa.int64()), ("head", pa.int64()), ("cls", pa.int64()), ("slack", pa.int32()), ("head_slack", pa.int32())])

    def sign(batches):
        for batch in blocks(batches, "text"):
            sets, begin = shingle_sets(*strings(batch.column("text")), k)
            cls = set_classes(sets, begin)
            once = np.zeros(len(cls), bool)
            once[np.unique(cls, return_index=True)[1]] = True  # copies in the block sign once
            keep = np.repeat(once, np.diff(begin))
            sizes = np.where(once, np.diff(begin), 0)
            owner, sig, slack = signatures(sets[keep], np.concatenate([[0], np.cumsum(sizes)]), bands)
            yield table(signed, sig.view(np.int64), cls[owner].view(np.int64), slack[owner])

    def star(batches: Iterator[pa.RecordBatch]):
        last = None  # signature, its head, the head's slack, the last class
        for batch in batches:
            sig, cls, slack = (batch.column(c).to_numpy() for c in signed.names)
            if not len(sig):
                continue
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            same = np.zeros(len(sig), bool)
            same[1:] = ~first[1:] & (cls[1:] == cls[:-1])
            at = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
            head, head_slack = cls[at], slack[at]
            if last is not None and last[0] == sig[0]:
                stop = int(np.flatnonzero(first)[1]) if first.sum() > 1 else len(sig)
                head[:stop], head_slack[:stop] = last[1], last[2]
                first[0], same[0] = False, last[3] == cls[0]
            last = (sig[-1], head[-1], head_slack[-1], cls[-1])
            keep = ~first & ~same
            yield table(starred, sig[keep], head[keep], cls[keep], slack[keep], head_slack[keep])

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select("text").mapInArrow(sign, "sig bigint, cls bigint, slack int")
    return rows.repartition(n, "sig").sortWithinPartitions("sig", "cls").mapInArrow(star, "sig bigint, head bigint, cls bigint, slack int, head_slack int")


def _members(stars: DataFrame, tables: Tables) -> DataFrame:
    """``sig, cls``: the places at which members still have to be compared with each other (the head is done).

    A signature of more than ``HEAVY`` classes is heavy, such as one that a common passage makes by itself. A class that
    can spare all its heavy signatures shares a light one with all its links, so under heavy signatures only
    the others are compared. Whether a signature is heavy is the same for all its members.
    """
    big = stars.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY).select("sig")
    big = tables.write(big, "jaccard-heavy")
    hot = tables.write(stars.join(big, "sig", "left_semi"), "jaccard-heavy-rows")
    light = stars.join(big, "sig", "left_anti").select("sig", "cls")
    places = hot.select("cls", "slack").union(hot.select("head", "head_slack", "sig").distinct().select("head", "head_slack"))
    over = places.groupBy("cls").agg(F.count("*").alias("n"), F.min("slack").alias("slack")).where("n > slack").select("cls")
    return light.union(hot.select("sig", "cls").join(over, "cls", "left_semi").select("sig", "cls"))


def _pruned(pairs: DataFrame, info: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs of classes ``a, b``, ``total`` in number, that can link by size and whole sketch."""
    a, b = (info.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def prune(batches):
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
            sketch = Sketches(batch.column("s_a"), batch.column("s_b"))
            x, _, _ = may_link(n, sketch, np.arange(m), np.arange(m) + m, percent)
            yield table(schema, batch.column("a").take(pa.array(x)), batch.column("b").take(pa.array(x)))

    both = salted_join(salted_join(pairs, b, "b", total), a, "a", total)
    return both.select("n_a", "n_b", "s_a", "s_b", "a", "b").mapInArrow(prune, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, info: DataFrame, k: int, percent: int, tables: Tables) -> DataFrame:
    """The pairs of classes ``a, b`` whose whole sets link."""
    pairs = tables.write(_pruned(pairs, info, percent, pairs.count()), "jaccard-pairs")
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    needed = tables.write(needed.join(info.select("cls", "rep"), "cls"), "jaccard-needed")
    few = needed.count() <= BROADCAST_ROWS
    chosen = docs.select("doc", "text").join(F.broadcast(needed) if few else needed, F.col("doc") == F.col("rep")).select("cls", "text")
    schema = pa.schema([("cls", pa.int64()), ("elements", pa.binary())])

    def elements(batches):
        seen: set[int] = set()
        for batch in blocks(batches, "text"):
            fresh = [c not in seen and not seen.add(c) for c in batch.column("cls").to_pylist()]  # repeated rows once a task
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            sets, begin = shingle_sets(*strings(batch.column("text")), k)
            raw, at = sets.tobytes(), (begin * 8).tolist()
            yield table(schema, batch.column("cls"), pa.array([raw[s:e] for s, e in zip(at, at[1:], strict=False)], pa.binary()))

    # a row of each class: copies in several tasks give it more than once
    sets = tables.write(chosen.mapInArrow(elements, "cls bigint, elements binary").dropDuplicates(["cls"]), "jaccard-sets")
    total = pairs.count()
    both = salted_join(salted_join(pairs, sets.select(F.col("cls").alias("b"), F.col("elements").alias("y")), "b", total), sets.select(F.col("cls").alias("a"), F.col("elements").alias("x")), "a", total)
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield table(linked, *(batch.column(c).filter(pa.array(keep, pa.bool_())) for c in linked.names))

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _forest(root: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of the pairs x, y those that join new components, the relatively nearest pairs first."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    keep = []
    for i in np.argsort(far / (n[x] + n[y]), kind="stable").tolist():
        a, b = find(int(root[x[i]])), find(int(root[y[i]]))
        if a != b:
            parent[a] = b
            keep.append(i)
    return np.array(keep, np.int64)


CELL = 1024
#: A member's part in its cell: it is compared with the members (of the largest component, or of all in a cell of many), it is one of those, or both.
LEFT, RIGHT, BOTH = 1, 2, 3


def _cells(members: DataFrame, total: int) -> DataFrame:
    """``sig, cls, root, i, j, role``: members of signatures with several components, in their cells.

    Members outside a signature's largest component are compared with all the others. Up to ``CELL`` of them and of all members make one
    cell; more are dealt to blocks by the hash of their class, and each block of the one side meets each of the other side in a cell.
    """
    by_root = members.groupBy("sig", "root").agg(F.count("*").alias("n"))
    sizes = by_root.groupBy("sig").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    sizes = sizes.select("sig", "all", F.col("main.root").alias("main"), F.ceil(F.col("all") / CELL).cast("int").alias("columns"), F.ceil((F.col("all") - F.col("main.n")) / CELL).cast("int").alias("rows"))
    placed = split_join(members, sizes, ["sig"], "all", total)
    rest, own = F.col("root") != F.col("main"), F.xxhash64("cls")
    at = lambda n: F.pmod(own, F.col(n)).cast("int")
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    right = F.transform(upto("rows"), lambda i: cell(i, at("columns"), RIGHT))
    left = F.transform(upto("columns"), lambda j: cell(at("rows"), j, LEFT))
    zero = F.lit(0)
    one = F.when(rest, F.array(cell(zero, zero, BOTH))).otherwise(F.array(cell(zero, zero, RIGHT)))
    cells = F.when((F.col("rows") == 1) & (F.col("columns") == 1), one).when(rest, F.concat(left, right)).otherwise(right)
    return placed.select("sig", "cls", "root", F.inline(cells))


def _cell_pairs(new: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to compare, in blocks of some ``PAIRS``; ``new`` marks each cell's first row, and those that aren't ``RIGHT`` come first."""
    n = len(new)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    end = np.repeat(head + size, size)
    lefts = np.repeat(np.add.reduceat((role != RIGHT).astype(np.int64), head), size)
    start = np.where(role == BOTH, np.arange(n) + 1, end - size.repeat(size) + lefts)
    later = np.where(role == RIGHT, 0, end - start)
    total = np.cumsum(later)
    cuts = np.searchsorted(total, np.arange(PAIRS, total[-1] + PAIRS, PAIRS)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
        rows = np.arange(s, min(e, n))
        if len(rows) and later[rows].any():
            yield np.repeat(rows, later[rows]), spans(start[rows], later[rows])


def _rest(members: DataFrame, info: DataFrame, percent: int, forest: bool, total: int) -> DataFrame:
    """``a, b, open``: pairs of classes of different components under one signature that can link, null for open.

    ``forest``: where a batch has more than ``SPARSE`` of them a member, only as many as join its components, so that a large group of near copies
    costs some rows a member. The signatures of pairs that were left out are ``open``, in rows of their own; the others are done.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.int64())])

    def compare(rows: pa.Table) -> pa.RecordBatch:
        sig, i, j, role, cls, root, n = (rows.column(c).to_numpy() for c in ("sig", "i", "j", "role", "cls", "root", "n"))
        sketch = Sketches(rows.column("sketch"))
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        found = [np.zeros((3, 0), np.int64)]
        still = np.zeros(0, np.int64)
        for x, y in _cell_pairs(new, role):
            apart = root[x] != root[y]
            found.append(np.stack(may_link(n, sketch, x[apart], y[apart], percent)))
            if forest and sum(f.shape[1] for f in found) > SPARSE * len(sig):
                x, y, far = np.concatenate(found, axis=1)
                keep = _forest(root, n, x, y, far)
                still = np.union1d(still, sig[np.delete(x, keep)])
                found = [np.stack([x[keep], y[keep], far[keep]])]
        x, y, _ = np.concatenate(found, axis=1)
        a, b = np.unique(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])]), axis=1)
        none = lambda m: pa.nulls(m, pa.int64())
        return table(schema, pa.concat_arrays([pa.array(a), none(len(still))]), pa.concat_arrays([pa.array(b), none(len(still))]), pa.concat_arrays([none(len(a)), pa.array(still)]))

    def cells(batches):
        held: list[pa.RecordBatch] = []
        key = lambda batch, row: tuple(batch.column(c)[row].as_py() for c in ("sig", "i", "j"))
        for batch in batches:
            if not batch.num_rows:
                continue
            # whole cells only: the last one of a batch waits for its rest
            sig, i, j = (batch.column(c).to_numpy() for c in ("sig", "i", "j"))
            other = np.flatnonzero((sig != sig[-1]) | (i != i[-1]) | (j != j[-1]))
            stop = int(other[-1]) + 1 if len(other) else 0
            if held and not stop and key(batch, 0) == key(held[-1], 0):
                held.append(batch)
                continue
            done = [*held, batch.slice(0, stop)]
            held = [batch.slice(stop)]
            if sum(b.num_rows for b in done):
                yield compare(pa.Table.from_batches(done))
        if held:
            yield compare(pa.Table.from_batches(held))
        release()

    n = shuffle_partitions(members.sparkSession)
    keys = ("sig", "i", "j")
    described = _cells(members, total).join(info.select("cls", "n", F.col("coarse").alias("sketch")), "cls")
    dealt = described.repartition(n, *keys).sortWithinPartitions(*keys, F.col("role") == RIGHT, "cls")
    return dealt.mapInArrow(cells, "a bigint, b bigint, open bigint").distinct()


def _address(id_col: str, text_col: str) -> Column:
    """A hash of id and text in which nulls are unlike empty ones."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col))


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, doc, n_shingles, cls, component_id, keeper``; ``doc`` addresses the row and ``cls`` its set.

    ``component_id`` is the component's least id, which is no key: ids may be null or repeated. ``keeper`` is the address of
    the component's row with the least id, nulls last, and of those the least address.
    """
    address = _address(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), address.alias("doc"), F.col(text_col).alias("text"))
    tables = Tables(docs.sparkSession)
    sets = tables.write(_sets(rows, k), "jaccard-classes")
    info = sets.where("n > 0").groupBy("cls").agg(F.min("doc").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("coarse").alias("coarse"), F.count("*").alias("copies"))
    info = tables.write(info, "jaccard-info")
    stars = tables.write(_stars(rows, k, percent), "jaccard-stars")

    heads = tables.write(stars.select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct(), "jaccard-heads")
    links = tables.write(_verified(heads, rows, info, k, percent, tables), "jaccard-links")
    roots = components(links)

    # what the stars can't tell: members of a signature that are still apart; forests first, then all pairs that are left
    places = tables.write(_members(stars, tables), "jaccard-places")
    total = places.count()
    for forest in (*[True] * FORESTS, False):
        members = places.join(roots, F.col("cls") == F.col("node"), "left").select("sig", "cls", F.coalesce("root", "cls").alias("root"))
        members = tables.write(members, "jaccard-members")
        rest = tables.write(_rest(members, info, percent, forest, total), "jaccard-rest")
        pairs = rest.where("open is null").select("a", "b")
        if pairs.isEmpty():
            break
        more = tables.write(_verified(pairs, rows, info, k, percent, tables), "jaccard-links")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
        # only signatures with pairs that were left out are looked at again
        still = rest.where("open is not null").select(F.col("open").alias("sig")).distinct()
        if not forest or still.isEmpty():
            break
        places = tables.write(places.join(still, "sig", "left_semi"), "jaccard-places")

    # a class of many copies is a hot key
    of_class = tables.write(info.join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "copies"), "jaccard-roots")
    some = split_join(sets.where("n > 0"), of_class, ["cls"], "copies", sets.count()).select("doc_id", "doc", F.col("n").alias("n_shingles"), "cls", "root")
    none = sets.where("n = 0").select("doc_id", "doc", F.col("n").alias("n_shingles"), "cls", F.lit(None).cast("bigint").alias("root"))
    named = materialize(some.union(none), "jaccard-named")
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc")).alias("first"), F.count("*").alias("members"))
    least = materialize(least.select("root", "component_id", F.col("first.doc").alias("keeper"), "members"), "jaccard-least")
    tables.drop()
    filled = split_join(named.where("root is not null"), least, ["root"], "members", named.count())
    out = ["doc_id", "doc", "n_shingles", "cls", "component_id", "keeper"]
    return filled.select(*out).union(named.where("root is null").select("doc_id", "doc", "n_shingles", "cls", F.col("doc_id").alias("component_id"), F.col("doc").alias("keeper")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the least id of each component, all columns as they are; of repeated rows one stays."""
    found = join(docs, k, percent, id_col, text_col)
    name = unused("doc", docs.columns)
    kept = found.where("doc = keeper").select(F.col("doc").alias(name)).distinct()
    address = _address(id_col, text_col)
    # repeated rows are one before they meet the kept ones, so they are no hot key
    return docs.withColumn(name, address).dropDuplicates([name]).join(kept, name, "left_semi").select(*docs.columns)
