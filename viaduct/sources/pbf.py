"""The binary map format: blobs of protocol-buffer messages, decoded on the executors, a blob a row.

A file is a chain of blobs. Each is cut out and dealt to a task of its own, where it is unpacked and decoded to rows. A file is one
row of Spark's binary source, which limits it to 2 GB; larger maps come in several files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field numbers of the format's messages: fixed values.
BLOB_TYPE, BLOB_SIZE = 1, 3
RAW, ZLIB = 1, 3
STRINGS, GROUP, GRANULARITY, LAT_OFFSET, LON_OFFSET = 1, 2, 17, 19, 20
NODE, DENSE, WAY, RELATION = 1, 2, 3, 4
MEMBER_KINDS = ("node", "way", "relation")
OBJECTS = "kind string, id bigint, lat double, lng double, refs array<bigint>, members array<struct<type:string,id:bigint,role:string>>, tags map<string,string>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message: integers, or bytes."""
    at, end = 0, len(data)
    while at < end:
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


def packed(data: bytes, signed: bool = False) -> np.ndarray:
    """All varints of a packed field at once; signed ones are zigzag."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    bits = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    value = np.add.reduceat(bits, first)
    return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64) if signed else value.astype(np.int64)


def blobs(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Type and payload of each blob of a file."""
    at = 0
    while at < len(content):
        size = int.from_bytes(content[at : at + 4], "big")
        head = dict(fields(content[at + 4 : at + 4 + size]))
        at += 4 + size
        yield head[BLOB_TYPE].decode(), content[at : at + head[BLOB_SIZE]]
        at += head[BLOB_SIZE]


def unpacked(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if RAW in parts:
        return parts[RAW]
    if ZLIB in parts:
        return zlib.decompress(parts[ZLIB])
    raise ValueError(f"a blob's compression {sorted(parts)} is not known")


def objects(block: bytes) -> Iterator[tuple]:
    """``kind, id, lat, lng, refs, members, tags`` of everything in a data block."""
    head: dict[int, int | bytes] = {}
    groups = []
    for number, value in fields(block):
        if number == GROUP:
            groups.append(value)
        else:
            head[number] = value
    strings = [v.decode() for _, v in fields(head[STRINGS])]
    unit, south, west = head.get(GRANULARITY, 100), _signed(head.get(LAT_OFFSET, 0)), _signed(head.get(LON_OFFSET, 0))
    place = lambda lat, lon: ((south + unit * lat) / 1e9, (west + unit * lon) / 1e9)
    tags = lambda keys, values: {strings[k]: strings[v] for k, v in zip(keys.tolist(), values.tolist(), strict=True)}
    for group in groups:
        for number, value in fields(group):
            if number == DENSE:
                yield from _dense(value, strings, place)
                continue
            if number not in (NODE, WAY, RELATION):
                continue
            f = dict(fields(value))
            own = tags(packed(f.get(2, b"")), packed(f.get(3, b"")))
            if number == NODE:
                zigzag = lambda x: (x >> 1) ^ -(x & 1)
                yield ("node", zigzag(f[1]), *place(zigzag(f[8]), zigzag(f[9])), None, None, own)
            elif number == WAY:
                yield "way", _signed(f[1]), None, None, np.cumsum(packed(f.get(8, b""), True)).tolist(), None, own
            else:
                roles, ids, kinds = packed(f.get(8, b"")), np.cumsum(packed(f.get(9, b""), True)), packed(f.get(10, b""))
                members = [{"type": MEMBER_KINDS[t], "id": i, "role": strings[r]} for r, i, t in zip(roles.tolist(), ids.tolist(), kinds.tolist(), strict=True)]
                yield "relation", _signed(f[1]), None, None, None, members, own


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dense(value: bytes, strings: list[str], place) -> Iterator[tuple]:
    f = dict(fields(value))
    ids, lats, lons = (np.cumsum(packed(f.get(n, b""), True)).tolist() for n in (1, 8, 9))
    pairs = packed(f.get(10, b"")).tolist()
    at = 0
    for i, lat, lon in zip(ids, lats, lons, strict=True):
        own = {}
        while at < len(pairs) and pairs[at]:
            own[strings[pairs[at]]] = strings[pairs[at + 1]]
            at += 2
        at += 1
        yield ("node", i, *place(lat, lon), None, None, own)


KINDS = pa.schema([
    ("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64()), ("refs", pa.list_(pa.int64())),
    ("members", pa.list_(pa.struct([("type", pa.string()), ("id", pa.int64()), ("role", pa.string())]))), ("tags", pa.map_(pa.string(), pa.string())),
])


def read(spark: SparkSession, path: str, parallel: int | None = None) -> DataFrame:
    """Nodes, ways and relations of the files at ``path``, in no order: ``kind, id, lat, lng, refs, members, tags``."""

    def cut(batches):
        for batch in batches:
            for content in batch.column("content"):
                for kind, blob in blobs(content.as_py()):
                    if kind == "OSMData":
                        yield pa.RecordBatch.from_pydict({"blob": pa.array([blob], pa.binary())})

    def decode(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                rows = list(objects(unpacked(blob.as_py())))
                columns = [pa.array([list(x.items()) if f.name == "tags" else x for x in c], f.type) for f, c in zip(KINDS, zip(*rows, strict=True), strict=True)] if rows else [pa.array([], f.type) for f in KINDS]
                yield pa.RecordBatch.from_arrays(columns, schema=KINDS)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "blob binary")
    return found.repartition(parallel or spark.sparkContext.defaultParallelism).mapInArrow(decode, OBJECTS)


def ordered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables ``nodes(id, lat, lng, tags)``, ``ways(id, refs, tags)`` and ``relations(id, members, tags)``, one scan each."""
    rows = read(spark, path)
    of = lambda kind, *columns: rows.where(F.col("kind") == kind).select("id", *columns, "tags")
    return of("node", "lat", "lng"), of("way", "refs"), of("relation", "members")


def read_speed(spark: SparkSession, path: str) -> tuple[float, int]:
    """Seconds that a whole decode takes, and the objects that were decoded; nothing is kept."""
    import time

    from pyspark.sql import Observation

    seen = Observation("objects")
    began = time.perf_counter()
    read(spark, path).observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began, seen.get["n"]


def _put(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    return _put(number << 3) + _put(value) if isinstance(value, int) else _put(number << 3 | 2) + _put(len(value)) + value


def _list(values, signed: bool = False) -> bytes:
    return b"".join(_put((v << 1) ^ (v >> 63) if signed else v) for v in values)


def _differences(values: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def encode(rows: list[dict], header: bool = True) -> bytes:
    """A file, or with ``header=False`` a further blob of one, of objects as ``read`` gives them; coordinates keep 1e-7 degrees."""
    strings = sorted({x for r in rows for pair in (r.get("tags") or {}).items() for x in pair} | {m["role"] for r in rows for m in r.get("members") or []})
    at = {x: i + 1 for i, x in enumerate(strings)}
    keys = lambda r: [at[k] for k in r.get("tags") or {}]
    values = lambda r: [at[v] for v in (r.get("tags") or {}).values()]
    nodes = [r for r in rows if r["kind"] == "node"]
    group = b""
    if nodes:
        units = lambda c: [round(r[c] * 1e7) for r in nodes]
        pairs = [x for r in nodes for x in [*[y for pair in zip(keys(r), values(r), strict=True) for y in pair], 0]]
        dense = _field(1, _list(_differences([r["id"] for r in nodes]), True)) + _field(8, _list(_differences(units("lat")), True)) + _field(9, _list(_differences(units("lng")), True)) + _field(10, _list(pairs))
        group += _field(GROUP, _field(DENSE, dense))
    for r in rows:
        tags = _field(2, _list(keys(r))) + _field(3, _list(values(r)))
        if r["kind"] == "way":
            group += _field(GROUP, _field(WAY, _field(1, r["id"]) + tags + _field(8, _list(_differences(r["refs"]), True))))
        elif r["kind"] == "relation":
            m = r["members"]
            own = _field(8, _list([at[x["role"]] for x in m])) + _field(9, _list(_differences([x["id"] for x in m]), True)) + _field(10, _list([MEMBER_KINDS.index(x["type"]) for x in m]))
            group += _field(GROUP, _field(RELATION, _field(1, r["id"]) + tags + own))
    table = _field(STRINGS, b"".join(_field(1, x.encode()) for x in ["", *strings]))
    out = b""
    for kind, payload in ([("OSMHeader", b"")] if header else []) + [("OSMData", table + group)]:
        blob = _field(2, len(payload)) + _field(ZLIB, zlib.compress(payload))
        head = _field(BLOB_TYPE, kind.encode()) + _field(BLOB_SIZE, len(blob))
        out += len(head).to_bytes(4, "big") + head + blob
    return out
