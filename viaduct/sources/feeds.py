"""Feeds and exchange formats: navigation tables, traces, timed graphs, query sets, caches, graph folders, drawings and reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import geo, traffic

#: Columns of the navigation tables that are read, by their place in the line: fixed values of the format.
LINKS = {"link_id": (0, "bigint"), "ref_node": (1, "bigint"), "nonref_node": (2, "bigint")}
NAV_LINKS = {"link_id": (0, "bigint"), "functional_class": (4, "int"), "direction": (6, "string"), "speed_category": (19, "int"), "from_ref_limit": (25, "int"), "to_ref_limit": (26, "int")}
NODES = {"node_id": (0, "bigint"), "lat": (1, "bigint"), "lon": (2, "bigint"), "z": (3, "int")}
GEOMETRIES = {"link_id": (0, "bigint"), "seq": (1, "int"), "lat": (2, "bigint"), "lon": (3, "bigint")}
TABLES = {"rdf_link": LINKS, "rdf_nav_link": NAV_LINKS, "rdf_node": NODES, "adas_link_geometry": GEOMETRIES}


def read_navigation(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the four tab-separated tables, of all its files ``table/table.txt*``; what can't be read as its type is null."""
    part = F.split("value", "\t")
    lines = spark.read.text(f"{folder}/{table}/{table}.txt*")
    return lines.select(*[F.get(part, F.lit(n)).try_cast(kind).alias(c) for c, (n, kind) in TABLES[table].items()])


def link_ids(links: DataFrame) -> DataFrame:
    """``arc_id, link_id, direction, tail, head``: an arc for each direction a link is open in, by ``ref_node, nonref_node, direction``.

    ``F`` runs from the reference node, ``T`` to it, ``B`` both. The arc's id is twice the link's, and 1 more against the reference; so both ways need no table.
    """
    ahead = links.where(F.col("direction").isin("F", "B")).select((F.col("link_id") * 2).alias("arc_id"), "link_id", F.lit("F").alias("direction"), F.col("ref_node").alias("tail"), F.col("nonref_node").alias("head"))
    back = links.where(F.col("direction").isin("T", "B")).select((F.col("link_id") * 2 + 1).alias("arc_id"), "link_id", F.lit("T").alias("direction"), F.col("nonref_node").alias("tail"), F.col("ref_node").alias("head"))
    return ahead.union(back)


def import_navigation(links: DataFrame, nav_links: DataFrame, nodes: DataFrame, geometries: DataFrame, box: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Arcs ``arc_id, link_id, direction, tail, head, length_m, travel_time, functional_class`` and nodes ``node_id, lat, lng`` inside a box.

    A link counts if both its nodes are inside (``min_lat, min_lon, max_lat, max_lon`` in hundred-thousandths of a degree) and it has navigation data. Its
    length is that of its geometry, or the distance of its nodes.
    """
    inside = nodes.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    place = inside.select("node_id", (F.col("lat") / 100_000).alias("lat"), (F.col("lon") / 100_000).alias("lng"))
    end = lambda c: place.select(F.col("node_id").alias(f"{c}_node"), F.col("lat").alias(f"{c}_lat"), F.col("lng").alias(f"{c}_lng"))
    rows = links.join(end("ref"), "ref_node").join(end("nonref"), "nonref_node").join(nav_links, "link_id")
    shape = geometries.groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct("seq", (F.col("lat") / 100_000).alias("lat"), (F.col("lon") / 100_000).alias("lng")))).alias("points"))
    own = F.element_at(geo.polyline_lengths(F.col("points"), geo.ellipsoid_m), -1)
    rows = rows.join(shape, "link_id", "left").withColumn("length_m", F.coalesce(own, geo.ellipsoid_m(*[F.col(c) for c in ("ref_lat", "ref_lng", "nonref_lat", "nonref_lng")])))
    arcs = link_ids(rows).join(rows.select("link_id", "length_m", "functional_class", "speed_category", "from_ref_limit", "to_ref_limit"), "link_id")
    limit = F.when(F.col("direction") == "F", F.col("from_ref_limit")).otherwise(F.col("to_ref_limit"))
    speed = traffic.category_speed(F.col("speed_category"), limit)
    used = arcs.select(F.col("tail").alias("node_id")).union(arcs.select("head")).distinct()
    out = arcs.select("arc_id", "link_id", "direction", "tail", "head", "length_m", F.round(1000 * F.col("length_m") / speed).cast("bigint").alias("travel_time"), "functional_class")
    return out, place.join(used, "node_id", "left_semi")


def write_links_csv(arcs: DataFrame, path: str) -> None:
    """``tail,head,mm_linkLength_m,linkId,direction`` with a header."""
    arcs.select("tail", "head", F.col("length_m").alias("mm_linkLength_m"), F.col("link_id").alias("linkId"), "direction").write.option("header", True).csv(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """``link_id, direction, kmh, t`` of compressed or plain CSV traces, by the names in the header, in whatever order. A speed that is no number is null."""
    rows = spark.read.option("header", True).option("quote", "").csv(path)
    direction = F.when(F.col("mm_isFromRef") == "true", "F").when(F.col("mm_isFromRef") == "false", "T")
    return rows.select(F.col("mm_linkId").cast("bigint").alias("link_id"), direction.alias("direction"), (F.col("mm_speed_mps").try_cast("double") * 3.6).alias("kmh"), F.col("timestampUTC_ms").cast("bigint").alias("t"))


def read_timed_graph(lines: DataFrame) -> DataFrame:
    """``tail, head, ttf`` of text lines ``tail head n at_1 tt_1 ..`` in seconds, which become milliseconds; the header of four numbers is left out."""
    part = F.split(F.trim("value"), r"\s+")
    n = F.get(part, F.lit(2)).cast("int")
    ms = lambda i: F.floor(F.get(F.col("p"), i).cast("double") * 1000)  # truncated
    rows = lines.select(part.alias("p"), n.alias("n")).where((F.size("p") == 3 + 2 * F.col("n")) & (F.col("n") > 0))
    points = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(ms(3 + 2 * i).alias("dt"), ms(4 + 2 * i).alias("tt")))
    return rows.select(F.get("p", F.lit(0)).cast("bigint").alias("tail"), F.get("p", F.lit(1)).cast("bigint").alias("head"), points.alias("ttf"))


def write_timed_graph(arcs: DataFrame) -> DataFrame:
    """Lines as ``read_timed_graph`` takes them, without the header."""
    points = F.flatten(F.transform("ttf", lambda p: F.array((p["dt"] / 1000).cast("string"), (p["tt"] / 1000).cast("string"))))
    return arcs.select(F.concat_ws(" ", F.col("tail").cast("string"), F.col("head").cast("string"), F.size("ttf").cast("string"), F.array_join(points, " ")).alias("value"))


QUERY = "from_node bigint, to_node bigint, from_coords array<double>, to_coords array<double>"


def write_queries(queries: DataFrame, path: str) -> None:
    queries.write.json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A stored query set, as JSON lines or one JSON array."""
    return spark.read.schema(QUERY).option("multiLine", False).json(path)


CACHE_VERSION = 1


def checksum(*sources: DataFrame) -> str:
    """A checksum of the rows of tables, whatever their order, from digests of 64 bits a row summed up in both halves."""
    parts = []
    for frame in sources:
        row = F.sha2(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}), 256)
        half = lambda n: F.sum(F.conv(F.substring(row, n, 15), 16, 10).cast("decimal(38,0)"))  # noqa: B023, E731
        parts.append([str(x) for x in frame.agg(F.count("*"), half(1), half(16), half(31)).first()])
    return json.dumps(parts)


def save_cache(tables: dict[str, DataFrame], path: str, *sources: DataFrame) -> None:
    """Tables with a manifest of the version and the checksum of what they were made from. The manifest is written last, so a broken save is no cache."""
    spark = sources[0].sparkSession
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [(CACHE_VERSION, checksum(*sources), sorted(tables))]
    spark.createDataFrame(rows, "version int, checksum string, tables array<string>").write.mode("overwrite").json(f"{path}/manifest")


def load_cache(path: str, *sources: DataFrame) -> dict[str, DataFrame] | None:
    """The cached tables, or None if there are none for these sources."""
    spark = sources[0].sparkSession
    try:
        meta = spark.read.schema("version int, checksum string, tables array<string>").json(f"{path}/manifest").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if meta is None or meta.version != CACHE_VERSION or meta.checksum != checksum(*sources):
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta.tables}


def save_graph(nodes: DataFrame, arcs: DataFrame, folder: str) -> None:
    nodes.write.parquet(f"{folder}/nodes")
    arcs.write.parquet(f"{folder}/arcs")


def load_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``nodes`` and ``arcs`` of a graph folder, or of its ``graph`` folder if that is where they are; a missing one is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p))
    for place in (folder, f"{folder}/graph"):
        if there(f"{place}/arcs"):
            return {name: spark.read.parquet(f"{place}/{name}") for name in ("nodes", "arcs")}
    raise FileNotFoundError(f"{folder}: no graph")


def save_turn_graph(lg_nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A turn graph: its nodes ``lg_node, arc_id`` with split ones, its edges with weights and turn costs, and what its arcs are made of."""
    lg_nodes.write.parquet(f"{folder}/nodes")
    edges.repartitionByRange("from_arc").sortWithinPartitions("from_arc", "to_arc").write.parquet(f"{folder}/arcs")


def dot(arcs: DataFrame) -> DataFrame:
    """``value``: lines of a drawing of the graph as ``tail -> head[label="weight"];``, without head and foot."""
    return arcs.select(F.format_string('%d -> %d[label="%d"];', "tail", "head", "weight").alias("value"))


def svg(arcs: DataFrame, box: dict[str, float], size: int = 300) -> DataFrame:
    """``value``: a line element for each arc ``tail_lat, tail_lng, head_lat, head_lng``, scaled into a square of ``size``."""
    scale = lambda c, axis: (F.col(c) - box[f"min_{axis}"]) * size / (box[f"max_{axis}"] - box[f"min_{axis}"])
    ends = [scale("tail_lng", "lng"), size - scale("tail_lat", "lat"), scale("head_lng", "lng"), size - scale("head_lat", "lat")]
    return arcs.select(F.format_string('<line x1="%.3f" y1="%.3f" x2="%.3f" y2="%.3f"/>', *ends).alias("value"))


def route_files(routes: DataFrame, path: str, geojson: bool = False) -> None:
    """Answers ``query_id, points, distance_ms, distance_m`` as JSON lines, or as lines of one GeoJSON feature each."""
    from viaduct.sources import files

    if geojson:
        routes.select(files.route_geojson(F.col("points"), F.col("distance_ms"), F.col("distance_m")).alias("value")).write.text(path)
    else:
        routes.write.option("ignoreNullFields", False).json(path)


def report(values: DataFrame, **head: str) -> DataFrame:
    """``value``: one JSON document a program with what ``head`` says and all its runs, from ``program, run, key, value`` rows."""
    run = values.groupBy("program", "run").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("pairs"))
    whole = run.groupBy("program").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "pairs"))), lambda r: F.map_from_entries(r["pairs"])).alias("algo_runs"))
    return whole.select(F.to_json(F.struct("program", *[F.lit(v).alias(k) for k, v in sorted(head.items())], "algo_runs")).alias("value"))


STATISTICS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def described(values: Column) -> list[Column]:
    """Count, mean, deviation, least, quartiles (interpolated) and largest value."""
    quartiles = [F.percentile(values, q).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return [F.count(values).alias("count"), F.avg(values).alias("mean"), F.stddev_samp(values).alias("std"), F.min(values).alias("min"), *quartiles, F.max(values).alias("max")]


def compared_runs(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """``series, count, mean, ..``: baseline and other run, their differences and ratios, of ``query_id, ms``."""
    both = baseline.select("query_id", F.col("ms").cast("double").alias("a")).join(other.select("query_id", F.col("ms").cast("double").alias("b")), "query_id")
    series = {"baseline": F.col("a"), "compare": F.col("b"), "difference": F.col("b") - F.col("a"), "ratio": F.col("b") / F.col("a")}
    stacked = both.select(F.inline(F.array(*[F.struct(F.lit(k).alias("series"), v.alias("v")) for k, v in series.items()])))
    return stacked.groupBy("series").agg(*described(F.col("v")))


def compared_profiles(graphs: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """``measure`` and a column a profile and ``delta`` (last minus first): counts and travel times of ``(nodes, arcs, forbidden turns)``."""
    rows = []
    for name, (nodes, arcs, turns) in graphs.items():
        count = lambda frame, what: frame.agg(F.count("*").cast("double").alias("v")).select(F.lit(name).alias("profile"), F.lit(what).alias("measure"), "v")  # noqa: B023, E731
        times = arcs.agg(F.min("travel_time").alias("a"), F.max("travel_time").alias("b"), F.avg("travel_time").alias("c"))
        each = F.array(*[F.struct(F.lit(w).alias("measure"), F.col(c).cast("double").alias("v")) for w, c in (("tt_min", "a"), ("tt_max", "b"), ("tt_mean", "c"))])
        rows += [count(nodes, "nodes"), count(arcs, "arcs"), count(turns, "turns"), times.select(F.lit(name).alias("profile"), F.inline(each))]
    names = list(graphs)
    whole = reduce(DataFrame.unionByName, rows).groupBy("measure").pivot("profile", names).agg(F.first("v"))
    return whole.withColumn("delta", F.col(names[-1]) - F.col(names[0]))
