"""Queries over map tags, ways and turn restrictions; ways are made from the parts' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import osm
from viaduct.plans.registry import query
from viaduct.sources import grid
from viaduct.sources import osm as loader

ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "path", "footway", "cycleway", "bicycle_road", "steps", "living_street", "pedestrian", "proposed")
PICK = {
    "highway": (len(ROADS) + 1, 1, ROADS), "oneway": (7, 2, ("yes", "no", "-1", "reversible")), "access": (9, 3, ("yes", "private", "destination")), "junction": (41, 5, ("roundabout",)), "route": (53, 7, ("ferry",)),
    "motor_vehicle": (19, 11, ("no", "yes")), "motorcar": (23, 13, ("no", "yes")), "bicycle": (17, 17, ("no", "dismount", "yes")), "cycleway": (29, 19, ("track", "lane", "opposite")), "maxspeed": (11, 23, ("50", "30 mph", "DE:urban", "none", "0", "20;40", "signals", "unposted")),
    "oneway:motorcycle": (31, 29, ("no", "yes", "-1")), "oneway:bicycle": (37, 31, ("no", "yes", "x")), "name": (3, 1, ("Main", "Side")), "ref": (5, 3, ("R1",)),
}


def _q(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


#: Each tag's value is chosen by the key; places beyond the list are absent.
COLUMNS = ", ".join(f"""CASE (p_partkey * {m}) % {n} {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))} END AS "{k}\"""" for k, (n, m, values) in PICK.items())
WAYS = f"WITH w AS (SELECT p_partkey AS id, {COLUMNS} FROM part)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = []
    for key, (n, m, values) in PICK.items():
        value = F.lit(None).cast("string")
        for i, v in enumerate(values):
            value = F.when(F.expr(f"(p_partkey * {m}) % {n} = {i}"), v).otherwise(value)
        pairs.append(F.struct(F.lit(key).alias("key"), value.alias("value")))
    tags = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    return grid.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tags.alias("tags"))


NO_MOTOR = f"access IS NOT NULL AND access NOT IN ({_q(osm.MOTOR_ACCESS)})"


@query(
    "p01_p04_usable_ways",
    f"""{WAYS} SELECT id,
    CASE WHEN junction IS NOT NULL OR coalesce(route = 'ferry', FALSE) THEN TRUE WHEN highway IS NULL OR coalesce(motorcar = 'no', FALSE) OR coalesce(motor_vehicle = 'no', FALSE) OR ({NO_MOTOR}) THEN FALSE WHEN highway IN ({_q(osm.CAR_ROADS)}) THEN TRUE
      WHEN highway = 'bicycle_road' THEN coalesce(motorcar = 'yes', FALSE) ELSE FALSE END AS car,
    CASE WHEN coalesce(motor_vehicle = 'no', FALSE) OR (({NO_MOTOR}) AND NOT coalesce(motor_vehicle = 'yes', FALSE)) THEN FALSE WHEN junction IS NOT NULL OR coalesce(route = 'ferry', FALSE) THEN TRUE WHEN highway IS NULL THEN FALSE WHEN highway IN ({_q(osm.CAR_ROADS)}) THEN TRUE
      WHEN highway IN ('bicycle_road', 'path') THEN coalesce(motor_vehicle = 'yes', FALSE) ELSE FALSE END AS motorcycle,
    CASE WHEN junction IS NOT NULL OR coalesce(route = 'ferry', FALSE) THEN TRUE WHEN highway IS NULL OR highway = 'proposed' OR (access = 'private') IS TRUE OR (bicycle = 'no') IS TRUE THEN FALSE WHEN cycleway IS NOT NULL THEN TRUE ELSE highway IN ({_q(osm.BIKE_ROADS)}) END AS bicycle_ok,
    CASE WHEN junction IS NOT NULL OR coalesce(route = 'ferry', FALSE) THEN TRUE WHEN highway IS NULL OR (access = 'private') IS TRUE THEN FALSE ELSE highway IN ({_q(osm.FOOT_ROADS)}) END AS foot FROM w""",
)
def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tags")
    return tagged(spark, sf_dir).select("id", osm.used_by_cars(t).alias("car"), osm.used_by_motorcycles(t).alias("motorcycle"), osm.used_by_bicycles(t).alias("bicycle_ok"), osm.used_by_pedestrians(t).alias("foot"))


POSTED = "CASE maxspeed WHEN '50' THEN 50 WHEN '30 mph' THEN 48 WHEN 'DE:urban' THEN 40 WHEN 'none' THEN 130 WHEN '0' THEN 1 WHEN '20;40' THEN 20 END"


def _speeds(table: dict[str, int], junction: int) -> str:
    return f"CAST(coalesce({POSTED}, CASE highway {' '.join(f"WHEN '{k}' THEN {v}" for k, v in table.items())} END, CASE WHEN junction IS NOT NULL THEN {junction} WHEN route = 'ferry' THEN 5 ELSE 50 END) AS BIGINT)"


@query("f30_f32_speeds", f"{WAYS} SELECT id, CAST({POSTED} AS BIGINT) AS posted, {_speeds(osm.CAR_SPEEDS, 15)} AS car, {_speeds(osm.MOTORCYCLE_SPEEDS, 20)} AS motorcycle FROM w")
def speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tags")
    return tagged(spark, sf_dir).select("id", osm.speed_tag(osm.tag(t, "maxspeed")).alias("posted"), osm.car_speed(t).alias("car"), osm.motorcycle_speed(t).alias("motorcycle"))


ONEWAY = "CASE oneway WHEN 'yes' THEN 'forward' WHEN 'no' THEN 'both' WHEN '-1' THEN 'backward' WHEN 'reversible' THEN 'closed' ELSE CASE WHEN junction = 'roundabout' OR highway = 'motorway' THEN 'forward' ELSE 'both' END END"


@query(
    "f33_f37_directions",
    f"""{WAYS} SELECT id, concat_ws(';', name, ref) AS name, {ONEWAY} AS car, CASE "oneway:motorcycle" WHEN 'no' THEN 'both' WHEN 'yes' THEN 'forward' WHEN '-1' THEN 'backward' ELSE {ONEWAY} END AS motorcycle,
    CASE "oneway:bicycle" WHEN 'no' THEN 'both' WHEN 'yes' THEN 'forward' WHEN 'x' THEN 'closed' ELSE CASE WHEN oneway IS NULL OR oneway = 'no' OR cycleway = 'opposite' THEN 'both' WHEN oneway = '-1' THEN 'backward' WHEN oneway = 'yes' THEN 'forward' ELSE 'closed' END END AS bicycle_way,
    CAST(CASE WHEN highway = 'cycleway' THEN 4 WHEN cycleway = 'track' THEN 3 WHEN cycleway IS NOT NULL THEN 2 WHEN highway = 'primary' OR bicycle = 'dismount' THEN 0 ELSE 1 END AS BIGINT) AS comfort FROM w""",
)
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tags")
    return tagged(spark, sf_dir).select("id", osm.way_name(t).alias("name"), osm.car_direction(t).alias("car"), osm.motorcycle_direction(t).alias("motorcycle"), osm.bicycle_direction(t).alias("bicycle_way"), osm.bicycle_comfort(t).cast("bigint").alias("comfort"))


VALUES = ("no_left_turn @ (Mo-Fr 07:00-09:00)", "only_straight_on @ (Sa,Su 10:00-14:00)", "no_u_turn @ (06:00-22:00)", "no_right_turn @ (Mo-Su 22:00-05:00)", "no_entry @ (x)", "only_right_turn")


@query(
    "f38_f41_conditional_turns",
    f"""WITH c AS (SELECT p_partkey AS id, p_partkey % 7 AS day, p_partkey * 37 % 1440 AS minute, p_partkey % 6 AS k FROM part) SELECT id,
    CASE k WHEN 0 THEN 'prohibitive' WHEN 1 THEN 'mandatory' WHEN 2 THEN 'prohibitive' WHEN 3 THEN 'prohibitive' END AS kind, CASE k WHEN 0 THEN 'left_turn' WHEN 1 THEN 'straight_on' WHEN 2 THEN 'u_turn' WHEN 3 THEN 'right_turn' END AS direction,
    CASE k WHEN 0 THEN day < 5 AND minute >= 420 AND minute < 540 WHEN 1 THEN day >= 5 AND minute >= 600 AND minute < 840 WHEN 2 THEN minute >= 360 AND minute < 1320 WHEN 3 THEN minute >= 1320 OR minute < 300 END AS active FROM c""",
)
def conditional_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(v) for v in VALUES])
    rows = grid.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey % 7").alias("day"), F.expr("p_partkey * 37 % 1440").alias("minute"), F.get(texts, F.expr("CAST(p_partkey % 6 AS INT)")).alias("text"))
    rows = rows.withColumn("c", osm.conditional(F.col("text"))).withColumn("r", osm.restriction(F.col("c.value"))).withColumn("w", osm.windows(F.col("c.condition")))
    return rows.select("id", F.col("r.kind").alias("kind"), F.col("r.direction").alias("direction"), osm.window_active(F.col("w"), F.col("day"), F.col("minute")).alias("active"))


GRID_WAYS = "r AS (SELECT node_id // 50 AS id, 'h' AS k, node_id, node_id % 50 AS pos FROM nodes UNION ALL SELECT 1000000 + node_id % 50, 'v', node_id, node_id // 50 FROM nodes WHERE node_id % 50 % 7 = 0)"


@query("d24_d25_split_ways", f"{grid.WITH}, {GRID_WAYS}, u AS (SELECT *, count(*) OVER (PARTITION BY node_id) AS uses, max(pos) OVER (PARTITION BY id) AS last FROM r), e AS (SELECT *, lead(node_id) OVER (PARTITION BY id ORDER BY pos) AS head, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS head_pos FROM u WHERE uses > 1 OR pos = 0 OR pos = last) SELECT id AS way_id, node_id AS tail, head, head_pos - pos + 1 AS points FROM e WHERE head IS NOT NULL")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.split_ways(grid_ways(spark, sf_dir)).select("way_id", F.get("refs", F.lit(0)).alias("tail"), F.element_at("refs", -1).alias("head"), F.size("refs").cast("bigint").alias("points"))


def grid_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = grid.nodes(spark, sf_dir)
    rows = n.select(F.expr("node_id div 50").alias("id"), F.expr("node_id % 50").alias("pos"), "node_id").union(n.where("node_id % 50 % 7 = 0").select(F.expr("1000000 + node_id % 50"), F.expr("node_id div 50"), "node_id"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("s")).where(F.size("s") > 1)
    return whole.select("id", F.transform("s", lambda x: x["node_id"]).alias("refs"))


@query("j20_junctions", f"{grid.WITH}, p AS (SELECT arc_id AS pair_id, way_id AS a, CASE WHEN arc_id % 3 = 0 THEN 1000000 + head % 50 ELSE (head + 50) // 50 END AS b FROM arcs), m AS (SELECT DISTINCT way_id, tail AS node FROM arcs UNION SELECT way_id, head FROM arcs), s AS (SELECT pair_id, count(*) AS n, min(x.node) AS node FROM p JOIN m x ON x.way_id = a JOIN m y ON y.way_id = b AND y.node = x.node GROUP BY pair_id) SELECT pair_id, CASE WHEN n = 1 THEN node END AS node FROM (SELECT pair_id FROM p JOIN m ON m.way_id = a GROUP BY pair_id) LEFT JOIN s USING (pair_id)")
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    members = arcs.select("way_id", F.col("tail").alias("node")).union(arcs.select("way_id", "head")).distinct()
    pairs = arcs.select(F.col("arc_id").alias("pair_id"), F.col("way_id").alias("a"), F.expr("CASE WHEN arc_id % 3 = 0 THEN 1000000 + head % 50 ELSE (head + 50) div 50 END").alias("b"))
    return loader.way_junctions(pairs, members)


RESTRICTED = "arcs2 AS (SELECT * REPLACE (way_id * 2 + CAST(antiparallel AS BIGINT) AS way_id) FROM arcs), rel AS (SELECT a.arc_id AS relation_id, a.way_id AS fw, a.head AS via, b.way_id AS tw, CASE WHEN a.arc_id % 2 = 0 THEN 'prohibitive' ELSE 'mandatory' END AS kind FROM arcs2 a JOIN arcs2 b ON b.tail = a.head AND b.way_id <> a.way_id AND b.head > b.tail WHERE a.arc_id % 9 = 0), f AS (SELECT relation_id, kind, count(*) AS n, min(x.arc_id) AS from_arc, min(y.arc_id) AS to_arc FROM rel JOIN arcs2 x ON x.way_id = fw AND x.head = via JOIN arcs2 y ON y.way_id = tw AND y.tail = via GROUP BY relation_id, kind)"


def one_way_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs with a way of its own for each direction."""
    return grid.arcs(spark, sf_dir).withColumn("way_id", F.col("way_id") * 2 + F.col("antiparallel").cast("bigint"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = one_way_arcs(spark, sf_dir)
    b = arcs.where("head > tail").select(F.col("tail").alias("via"), F.col("way_id").alias("tw"))
    rows = arcs.where("arc_id % 9 = 0").select("arc_id", F.col("way_id").alias("fw"), F.col("head").alias("via")).join(b, "via").where("tw <> fw")
    member = lambda kind, c, role: F.struct(F.lit(kind).alias("type"), F.col(c).alias("id"), F.lit(role).alias("role"))
    tags = F.create_map(F.lit("restriction"), F.when(F.col("arc_id") % 2 == 0, "no_left_turn").otherwise("only_left_turn"))
    return rows.select(F.col("arc_id").alias("id"), tags.alias("tags"), F.array(member("way", "fw", "from"), member("node", "via", "via"), member("way", "tw", "to")).alias("members"))


@query("j21_d26_turn_restrictions", f"{grid.WITH}, {RESTRICTED} SELECT relation_id, from_arc, to_arc, kind FROM f WHERE n = 1")
def restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.turn_restrictions(relations(spark, sf_dir), one_way_arcs(spark, sf_dir))


@query("j22_j23_forbidden_turns", f"{grid.WITH}, {RESTRICTED}, o AS (SELECT * FROM f WHERE n = 1) SELECT from_arc, to_arc FROM o WHERE kind = 'prohibitive' UNION SELECT from_arc, b.arc_id FROM o JOIN arcs a ON a.arc_id = from_arc JOIN arcs b ON b.tail = a.head AND b.arc_id <> to_arc WHERE kind = 'mandatory'")
def forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.forbidden_turns(restrictions(spark, sf_dir), one_way_arcs(spark, sf_dir))
