"""File formats of road networks: raw vectors, bit vectors, ragged columns, text graphs, Arrow files, GeoJSON, YAML and their sinks.

Readers use Spark's own sources, so any file system works. Writers of raw files give one payload a part; ``save_payloads`` puts
payloads into plain files by Hadoop's file system, part by part.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vector element types: little-endian.
TYPES = {"i8": "<i1", "u8": "<u1", "i16": "<i2", "u16": "<u2", "i32": "<i4", "u32": "<u4", "i64": "<i8", "u64": "<u8", "f32": "<f4", "f64": "<f8"}
WINDOW = np.dtype([("day_mask", "<u1"), ("start_min", "<u2"), ("end_min", "<u2")])


def decode_vectors(files: DataFrame, kind: str) -> DataFrame:
    """``path, pos, value`` of binary files ``path, content`` whose elements have one type; a size that the width doesn't divide is an error."""
    out = "double" if kind[0] == "f" else "bigint"

    def read(batches):
        for frame in batches:
            for path, content in frame.itertuples(index=False):
                if len(content) % np.dtype(TYPES[kind]).itemsize:
                    raise ValueError(f"{path}: {len(content)} bytes are no whole number of {kind}")
                for start in range(0, max(len(content), 1), 1 << 22):
                    values = np.frombuffer(content[start : start + (1 << 22)], TYPES[kind])
                    yield pd.DataFrame({"path": path, "pos": np.arange(len(values)) + start // values.itemsize, "value": values.astype(np.float64 if out == "double" else np.int64)})

    return files.select("path", "content").mapInPandas(read, f"path string, pos bigint, value {out}")


def read_vector(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return decode_vectors(spark.read.format("binaryFile").load(path), kind).select("pos", "value")


def encode_vectors(rows: DataFrame, key: str, pos: str, value: str, kind: str) -> DataFrame:
    """``path, content``: a payload for each ``key``, its values in order of ``pos``."""
    schema = "path string, content binary"

    def write(keys, part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values("pos")["value"].to_numpy().astype(TYPES[kind])
        return pd.DataFrame({"path": [str(keys[0])], "content": [values.tobytes()]})

    return rows.select(F.col(key).cast("string").alias("path"), F.col(pos).alias("pos"), F.col(value).alias("value")).groupBy("path").applyInPandas(write, schema)


def save_payloads(payloads: DataFrame, folder: str) -> None:
    """Each row's ``content`` as a file ``folder/path``; parts stream through the driver, one row at a time."""
    spark = payloads.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in payloads.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row.path}")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(row.content))
        out.close()


def decode_bits(content: bytes) -> np.ndarray:
    """A bit vector: its length as u64, then bits, lowest first, padded to 512."""
    n = int(np.frombuffer(content, "<u8", 1)[0])
    return np.unpackbits(np.frombuffer(content, np.uint8, offset=8), bitorder="little")[:n].astype(bool)


def encode_bits(bits: np.ndarray) -> bytes:
    padded = np.concatenate([bits, np.zeros(-len(bits) % 512, bool)])
    return np.array([len(bits)], "<u8").tobytes() + np.packbits(padded, bitorder="little").tobytes()


def strings(content: Column) -> Column:
    """NUL-terminated strings of a binary column."""
    parts = F.split(F.decode(content, "UTF-8"), "\u0000")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def ragged(offsets: DataFrame, values: DataFrame) -> DataFrame:
    """``id, items`` from ``pos, value`` tables of offsets (one more than ids) and values."""
    ends = offsets.select((F.col("pos") - 1).alias("id"), F.col("value").alias("end"))
    spans = offsets.select(F.col("pos").alias("id"), F.col("value").alias("start")).join(ends, "id")
    # every id owns the positions start .. end - 1
    slots = spans.where("end > start").select("id", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    items = slots.join(values, "pos").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("s"))
    return spans.select("id").join(items, "id", "left").select("id", F.coalesce(F.transform("s", lambda x: x["value"]), F.array()).alias("items"))


def pack_windows(windows: list[dict]) -> bytes:
    return np.array([(w["day_mask"], w["start_min"], w["end_min"]) for w in windows], WINDOW).tobytes()


def unpack_windows(content: bytes) -> list[dict]:
    return [{k: int(row[k]) for k in WINDOW.names} for row in np.frombuffer(content, WINDOW)]


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An Arrow IPC file, only the wanted columns."""

    def read(batches):
        for frame in batches:
            for content in frame.column("content").to_pylist():
                for batch in pa.ipc.open_file(content).read_all().select(names).to_batches():
                    yield batch

    content = spark.read.format("binaryFile").load(path).select("content")
    schema = pa.ipc.open_file(content.first()[0]).schema
    names = columns or schema.names
    from pyspark.sql.pandas.types import from_arrow_schema

    return content.mapInArrow(read, from_arrow_schema(pa.schema([schema.field(n) for n in names])))


def arrow_payload(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def read_dimacs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs ``tail, head, weight`` and points ``node_id, lng, lat`` (millionths) of ``value`` lines; ids become 0-based."""
    part = F.split(F.trim("value"), r"\s+")
    n = lambda i: F.get(part, F.lit(i)).cast("bigint")
    arcs = lines.where(F.col("value").startswith("a ")).select((n(1) - 1).alias("tail"), (n(2) - 1).alias("head"), n(3).alias("weight"))
    points = lines.where(F.col("value").startswith("v ")).select((n(1) - 1).alias("node_id"), n(2).alias("lng"), n(3).alias("lat"))
    return arcs, points


def write_dimacs(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.format_string("a %d %d %d", F.col("tail") + 1, F.col("head") + 1, F.col("weight")).alias("value"))


def write_metis(arcs: DataFrame) -> DataFrame:
    """``node_id, value``: each node's neighbours in both directions, 1-based and ascending."""
    both = arcs.select("tail", "head").union(arcs.select("head", "tail")).toDF("tail", "head").where("tail <> head").distinct()
    return both.groupBy(F.col("tail").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("head")), lambda h: (h + 1).cast("string")), " ").alias("value"))


def read_live_speeds(frame: DataFrame, sep: str = ",") -> DataFrame:
    """``from, to, kmh`` of text lines."""
    part = F.split("value", f"[{sep}]")
    get = lambda i: F.trim(F.get(part, F.lit(i)))
    return frame.select(get(0).cast("bigint").alias("from"), get(1).cast("bigint").alias("to"), get(2).cast("double").alias("kmh"))


def read_incidents(frame: DataFrame, infinity: int = 2147483647) -> DataFrame:
    """``from, to, weight``: duration in seconds of ``;`` lines as milliseconds; speed 0 closes the edge."""
    part = F.split("value", ";")
    n = lambda i: F.trim(F.get(part, F.lit(i))).cast("double")
    weight = F.when(n(2) == 0, F.lit(infinity)).otherwise(F.round(n(4) * 1000)).cast("bigint")
    return frame.select(n(0).cast("bigint").alias("from"), n(1).cast("bigint").alias("to"), weight.alias("weight"))


def read_day_speeds(frame: DataFrame, buckets: int = 288) -> DataFrame:
    """``from, to, kmh ARRAY<DOUBLE>`` of lines with one speed a five-minute bucket; constant days are dropped."""
    part = F.split("value", ",")
    rows = frame.select(F.get(part, F.lit(0)).cast("bigint").alias("from"), F.get(part, F.lit(1)).cast("bigint").alias("to"), F.transform(F.slice(part, 3, buckets), lambda x: x.cast("double")).alias("kmh"))
    return rows.where(F.array_min("kmh") != F.array_max("kmh"))


def parse_routes(frame: DataFrame) -> DataFrame:
    """``name, graph_type, arcs, nodes, points`` of GeoJSON texts ``name, geojson``: a FeatureCollection, Feature or LineString."""
    feature = "struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,coordinates:array<array<double>>,properties:struct<graph_type:string,route_arc_ids:array<bigint>,path_nodes:array<bigint>,weight_path_ids:array<bigint>>>"
    doc = F.from_json("geojson", f"struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,coordinates:array<array<double>>,properties:struct<graph_type:string,route_arc_ids:array<bigint>,path_nodes:array<bigint>,weight_path_ids:array<bigint>>,features:array<{feature}>>")
    rows = frame.withColumn("d", doc).withColumn("f", F.get("d.features", F.lit(0)))
    pick = lambda c: F.coalesce(F.col(f"f.properties.{c}"), F.col(f"d.properties.{c}"))
    points = F.coalesce(F.col("f.geometry.coordinates"), F.col("d.geometry.coordinates"), F.col("d.coordinates"))
    return rows.select("name", pick("graph_type").alias("graph_type"), pick("route_arc_ids").alias("arcs"), pick("path_nodes").alias("nodes"), pick("weight_path_ids").alias("weights"), F.transform(points, lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lng"))).alias("points"))


PALETTE = ("#2563eb", "#16a34a", "#ea580c", "#9333ea", "#dc2626")


def route_geojson(points: Column, distance_ms: Column, distance_m: Column, color: Column | None = None) -> Column:
    """A Feature with ``[lng, lat]`` pairs; the geometry is null without points."""
    geometry = F.when(F.size(points) > 0, F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lng"], p["lat"])).alias("coordinates")))
    fields = [distance_ms.alias("distance_ms"), distance_m.alias("distance_m")] + ([color.alias("stroke")] if color is not None else [])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*fields).alias("properties")), {"ignoreNullFields": "false"})


def routes_geojson(routes: DataFrame) -> DataFrame:
    """``query_id, geojson``: a FeatureCollection of each query's routes in order, colours by index."""
    palette = F.array(*[F.lit(c) for c in PALETTE])
    color = F.get(palette, F.pmod(F.col("route_index"), F.lit(len(PALETTE))).cast("int"))
    one = routes.withColumn("f", route_geojson(F.col("points"), F.col("distance_ms"), F.col("distance_m"), color))
    whole = one.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("route_index", "f"))).alias("s"))
    return whole.select("query_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("s", lambda x: x["f"]), ","), F.lit("]}")).alias("geojson"))


@F.pandas_udf(T.StringType())
def polyline(lats: pd.Series, lngs: pd.Series) -> pd.Series:
    """Points as encoded polylines: differences in 1e-5 degrees, zigzag, five bits a character."""

    def one(ys, xs) -> str:
        out, last = [], [0, 0]
        for point in zip(np.rint(np.asarray(ys) * 1e5).astype(int), np.rint(np.asarray(xs) * 1e5).astype(int), strict=True):
            for axis, now in enumerate(point):
                step = int(now) - last[axis]
                last[axis] = int(now)
                code = ~(step << 1) if step < 0 else step << 1
                while code >= 32:
                    out.append(chr((code & 31 | 32) + 63))
                    code >>= 5
                out.append(chr(code + 63))
        return "".join(out)

    return pd.Series([one(y, x) for y, x in zip(lats, lngs, strict=True)])


def read_cameras(spark: SparkSession, text: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Profiles and cameras of a YAML text. Strict: duplicate keys and bad values are errors; else bad cameras are left out."""
    import yaml

    class Unique(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        if len(set(keys)) < len(keys):
            raise ValueError(f"duplicate key in {keys}")
        return dict(zip(keys, [loader.construct_object(v, deep=True) for _, v in node.value], strict=True))

    Unique.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    doc = yaml.load(text, Unique) or {}
    profiles = []
    for name, p in (doc.get("profiles") or {}).items():
        peaks = [(float(x["hour"]), float(x["speed_kmh"]), float(x["occupancy"])) for x in p.get("peaks") or []]
        if not p["free_flow_kmh"] > 0 or not 0 <= p["free_flow_occupancy"] <= 1 or any(not s > 0 or not 0 <= o <= 1 for _, s, o in peaks):
            raise ValueError(f"profile {name} is out of range")
        profiles.append((str(name), float(p["free_flow_kmh"]), float(p["free_flow_occupancy"]), peaks))
    cameras = []
    for c in doc.get("cameras") or []:
        by_arc, by_place = c.get("arc_id") is not None, all(c.get(k) is not None for k in ("lat", "lon", "flow_bearing_deg"))
        if by_arc == by_place or c.get("profile") not in {p[0] for p in profiles}:
            if strict:
                raise ValueError(f"camera {c.get('id')} needs one placement and a known profile")
            continue
        place = (None, None, None) if by_arc else (float(c["lat"]), float(c["lon"]), float(c["flow_bearing_deg"]))
        cameras.append((int(c["id"]), str(c.get("label", "")), str(c["profile"]), c.get("arc_id"), *place))
    return (
        spark.createDataFrame(profiles, "name string, free_kmh double, free_occupancy double, peaks array<struct<hour:double,kmh:double,occupancy:double>>"),
        spark.createDataFrame(cameras, "id bigint, label string, profile string, arc_id bigint, lat double, lon double, bearing double"),
    )


def write_cameras(profiles: DataFrame, cameras: DataFrame) -> str:
    """The YAML text of a configuration, which is small by nature."""
    import yaml

    doc = {
        "profiles": {p.name: {"free_flow_kmh": p.free_kmh, "free_flow_occupancy": p.free_occupancy, "peaks": [{"hour": x.hour, "speed_kmh": x.kmh, "occupancy": x.occupancy} for x in p.peaks]} for p in profiles.toLocalIterator()},
        "cameras": [{"id": c.id, "label": c.label, "profile": c.profile} | ({"arc_id": c.arc_id} if c.arc_id is not None else {"lat": c.lat, "lon": c.lon, "flow_bearing_deg": c.bearing}) for c in cameras.toLocalIterator()],
    }
    return yaml.safe_dump(doc, sort_keys=False)


def post_weights(metric: DataFrame, url: str, send=None) -> int:
    """The metric in arc order as little-endian u32 in one body; any answer but 200 is an error."""
    import urllib.request

    values = [r.weight for r in metric.orderBy("arc_id").select("weight").toLocalIterator()]
    body = np.array(values, "<u4").tobytes()
    if send is None:

        def send(data: bytes) -> int:
            request = urllib.request.Request(url, data, {"Content-Type": "application/octet-stream"})
            with urllib.request.urlopen(request) as answer:
                return answer.status

    status = send(body)
    if status != 200:
        raise OSError(f"{url} answered {status}")
    return len(body)


def answer_json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def report_json(stats: DataFrame) -> str:
    return json.dumps([r.asDict() for r in stats.toLocalIterator()])
