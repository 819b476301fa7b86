"""Entity resolution and map queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import matching, nearest
from ..sources.shared import cut
from .base import ITEMS, SEGMENTS, SITES, distance_sql, items, query, score_sql, sites, table



def plane_sql(lon: str, lat: str, lon0: str, lat0: str, scale: str) -> str:
    """x and y of a transverse Mercator projection on the GRS80 ellipsoid, in SQL."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = f"{2 * n**0.5 / (1 + n):.17e}"
    conformal = lambda x: f"sinh(atanh(sin(radians({x}))) - {e} * atanh({e} * sin(radians({x}))))"
    dl, t = f"radians({lon} - {lon0})", conformal(lat)
    xi, eta, xi0 = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + pow({t}, 2)))", f"atan({conformal(lat0)})"
    north = " + ".join([xi, *(f"{c:.17e} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(alpha, 1))])
    east = " + ".join([eta, *(f"{c:.17e} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(alpha, 1))])
    north0 = " + ".join([xi0, *(f"{c:.17e} * sin({2 * j} * {xi0})" for j, c in enumerate(alpha, 1))])
    return f"{scale} * {radius:.17e} * ({east}) AS x, {scale} * {radius:.17e} * (({north}) - ({north0})) AS y"


_D = distance_sql("lon", "lat", "item_lon", "item_lat")
#: Longest common subsequence, row by row of its table: each cell is the one above, or the best match so far and one more.
_SIM = f"""names(x) AS (VALUES {", ".join(f"('{x}')" for x in SEGMENTS)}),
lcs(a, b, i, r) AS (SELECT p.x, q.x, 0, list_transform(range(0, length(q.x) + 1), lambda j: 0::BIGINT) FROM names p, names q UNION ALL
SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: greatest(r[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: substr(b, k, 1) = substr(a, i + 1, 1)), lambda k: r[k] + 1)), 0))) FROM lcs WHERE i < length(a)),
sim AS (SELECT a, b, 2e0 * r[length(b) + 1] / (length(a) + length(b)) AS s FROM lcs WHERE i = length(a))"""
_CAND = f"""WITH RECURSIVE {SITES}, {ITEMS}, {_SIM}, cand AS (SELECT site_id, qid, lon, lat, item_lon, item_lat, sites.name, label, region, item_region, {_D} AS d FROM sites JOIN items
ON abs(floor(lat / 1e-2) - floor(item_lat / 1e-2)) <= 1 AND abs(floor(lon / 1e-2) - floor(item_lon / 1e-2)) <= 1),
scored AS (SELECT site_id, qid, d AS distance_m, s AS name_sim, 4e-1 * ({score_sql("d")}) + 3e-1 * s + 1e-1 * CASE WHEN region = item_region THEN 1 ELSE 0 END AS score FROM cand JOIN sim ON a = name AND b = label)"""
_DECISION = "CASE WHEN {s} >= 6e-1 THEN 'auto' WHEN {s} >= 5e-1 THEN 'review' ELSE 'separate' END"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.grid_candidates(sites(spark, sf_dir).select("site_id", "lon", "lat"), items(spark, sf_dir).select("qid", "item_lon", "item_lat"))


def _with_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    own = sites(spark, sf_dir).withColumns({"names": F.array("name"), "aliases": none, "prefecture": F.format_string("n%02d", "region"), "municipality": nothing, "url": nothing})
    other = items(spark, sf_dir).withColumns({"item_names": F.array("label"), "item_aliases": none, "admin": F.format_string("n%02d", "item_region"), "item_url": nothing})
    return own, other


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.scored_candidates(*_with_names(spark, sf_dir), keep=())


@query(f"{_CAND} SELECT site_id, qid, round(d, 3) AS distance_m, round({score_sql('d')}, 6) AS geo FROM cand")
def j2_g1_g2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("item_lon"), F.col("item_lat"))
    return candidates(spark, sf_dir).select("site_id", "qid", geo.rounded(d, 3).alias("distance_m"), geo.rounded(geo.distance_score(d), 6).alias("geo"))


@query(f"{_CAND} SELECT site_id, qid, round(name_sim, 6) AS name_sim, round(score, 6) AS score FROM scored")
def g3_g6_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("site_id", "qid", geo.rounded(F.col("name_sim"), 6).alias("name_sim"), geo.rounded(F.col("score"), 6).alias("score"))


_BEST = f"{_CAND}, r AS (SELECT site_id, qid, round(score, 9) AS score FROM scored), best AS (SELECT site_id, qid, score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY score DESC, qid) = 1), matches AS (SELECT site_id, qid, coalesce(score, 0) AS score, {_DECISION.format(s='coalesce(score, 0)')} AS decision FROM sites LEFT JOIN best USING (site_id))"


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_match(sites(spark, sf_dir), matching.leading_candidates(*_with_names(spark, sf_dir)))


@query(f"{_BEST} SELECT site_id, qid, round(score, 6) AS score, decision FROM matches")
def j3_p7_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir).select("site_id", "qid", F.round("score", 6).alias("score"), "decision")


_WALK = f"""{_CAND}, e AS (SELECT site_id, qid, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, CAST(substr(qid, 2) AS BIGINT), round(distance_m, 6), site_id) AS n FROM scored WHERE round(score, 9) >= 5e-1),
walk(n, ls, rs, ns) AS (SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], []::BIGINT[] UNION ALL
SELECT e.n, CASE WHEN free THEN list_append(ls, site_id) ELSE ls END, CASE WHEN free THEN list_append(rs, qid) ELSE rs END, CASE WHEN free THEN list_append(ns, e.n) ELSE ns END
FROM (SELECT walk.*, e.site_id, e.qid, e.n AS m, NOT list_contains(ls, e.site_id) AND NOT list_contains(rs, e.qid) AS free FROM walk JOIN e ON e.n = walk.n + 1) w JOIN e USING (site_id, qid)),
taken AS (SELECT site_id, qid, score FROM e WHERE n IN (SELECT unnest(ns) FROM walk WHERE n = (SELECT max(n) FROM walk)))"""


@query(f"{_WALK} SELECT site_id, qid, round(coalesce(score, 0), 6) AS score, {_DECISION.format(s='coalesce(score, 0)')} AS decision FROM sites LEFT JOIN taken USING (site_id)")
def j4_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.assigned(*_with_names(spark, sf_dir), text.entity_number(F.col("qid")))
    return found.select("site_id", "qid", F.round("score", 6).alias("score"), "decision")


_NAMED = f"named AS (SELECT x.site_id AS a, y.site_id AS b FROM sites x JOIN sites y ON x.name = y.name AND x.site_id < y.site_id AND abs(x.lat - y.lat) < 2e-3 AND {distance_sql('x.lon', 'x.lat', 'y.lon', 'y.lat')} <= 150)"


@query(f"WITH {SITES}, {_NAMED} SELECT a, b FROM named")
def j5_same_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.same_name_pairs(sites(spark, sf_dir), F.col("name"))


_GUARD = f"{_BEST}, {_NAMED}, sure AS (SELECT site_id, qid FROM matches WHERE decision = 'auto'), guard AS (SELECT a, b, coalesce(x.qid <> y.qid, false) AS blocked FROM named LEFT JOIN sure x ON a = x.site_id LEFT JOIN sure y ON b = y.site_id)"


@query(f"{_GUARD} SELECT a, b, blocked FROM guard")
def r2_guarded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.guarded_pairs(sites(spark, sf_dir), F.col("name"), best(spark, sf_dir))


_MEMBERS = f"""{_GUARD}, e AS (SELECT a, b FROM guard WHERE NOT blocked UNION ALL SELECT b, a FROM guard WHERE NOT blocked), reach(node, other) AS (SELECT a, b FROM e UNION SELECT node, e.b FROM reach JOIN e ON other = e.a),
roots AS (SELECT node AS site_id, least(node, min(other)) AS root FROM reach GROUP BY node),
grp AS (SELECT root, count(DISTINCT qid) > 1 AS guarded, arg_min(roots.site_id, roots.site_id % 3 * 1000000000 + roots.site_id) AS kept FROM roots LEFT JOIN sure USING (site_id) GROUP BY root),
members AS (SELECT root, site_id, guarded, kept FROM roots JOIN grp USING (root))"""


@query(f"{_MEMBERS} SELECT site_id, root, guarded, kept FROM members")
def r1_r3_w11_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sites(spark, sf_dir)
    matches = cut(best(spark, sf_dir), "matches")
    pairs = cut(matching.unblocked_pairs(own, F.col("name"), matches), "pairs")
    return matching.merge_components(own, pairs, matches, F.col("site_id") % 3).select("site_id", "root", "guarded", "kept")


@query(f"{_MEMBERS} SELECT site_id, (SELECT string_agg(CAST(m.site_id AS VARCHAR), ',' ORDER BY m.site_id) FROM members m WHERE NOT m.guarded AND m.kept = s.site_id AND m.site_id <> m.kept) AS merged_from FROM sites s WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.site_id = s.site_id AND NOT guarded AND kept <> m.site_id)")
def r4_merged_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.merged(sites(spark, sf_dir), r1_r3_w11_components(spark, sf_dir))
    return out.select("site_id", F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ",").alias("merged_from"))


@query(f"{_MEMBERS}, al AS (SELECT site_id AS alias, kept FROM members WHERE NOT guarded AND kept <> site_id) SELECT s.site_id AS wanted, coalesce(al.kept, s.site_id) AS site_id, t.region FROM sites s LEFT JOIN al ON al.alias = s.site_id JOIN sites t ON t.site_id = coalesce(al.kept, s.site_id)")
def j15_q1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id ever used, the site that it leads to now, and its partition."""
    own = sites(spark, sf_dir)
    led = matching.aliases(r1_r3_w11_components(spark, sf_dir)).withColumnRenamed("site_id", "kept")
    wanted = own.select(F.col("site_id").alias("wanted")).join(led, F.col("wanted") == led["alias"], "left")
    return wanted.select("wanted", F.coalesce("kept", "wanted").alias("site_id")).join(own.select("site_id", "region"), "site_id").select("wanted", "site_id", "region")


_BOXES = "boxes AS (SELECT n_nationkey AS code, 138.5 + n_nationkey * 5e-2 AS west, 34.5 + n_nationkey * 3e-2 AS south, 138.5 + n_nationkey * 5e-2 + 3e-1 AS east, 34.5 + n_nationkey * 3e-2 + 25e-2 AS north FROM nation)"


@query(f"WITH {SITES}, {_BOXES} SELECT site_id, code FROM sites JOIN boxes ON lon - 15e-2 <= east AND lon + 15e-2 >= west AND lat - 15e-2 <= north AND lat + 15e-2 >= south")
def j7_overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.overlapping_boxes(sites(spark, sf_dir), boxes(spark, sf_dir))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    west, south = 138.5 + n * 5e-2, 34.5 + n * 3e-2
    return table(spark, sf_dir, "nation").select(n.alias("code"), west.alias("west"), south.alias("south"), (west + 3e-1).alias("east"), (south + 25e-2).alias("north"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short named lines across the patch, one for each supplier."""
    own = items(spark, sf_dir)
    return own.select(F.concat(F.lit("river "), "qid").alias("name"), F.col("item_lon").alias("lon1"), F.col("item_lat").alias("lat1"), (F.col("item_lon") + 0.004).alias("lon2"), (F.col("item_lat") - 0.002).alias("lat2"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with the plane of a prefecture; one in four has a name that no table knows."""
    name = F.get(F.array(*map(F.lit, _PREFECTURES)), (F.col("region") % 4).cast("int"))
    return sites(spark, sf_dir).withColumn("epsg", geo.prefecture_plane(name))


_PREFECTURES = ("東京都", "山梨県", "elsewhere", "神奈川県")
_PLANES = f"""{SITES}, {ITEMS}, placed AS (SELECT site_id, lon, lat, CASE region % 4 WHEN 1 THEN 138.5 WHEN 2 THEN 141 ELSE 139 + 5e0 / 6 END AS lon0, CASE WHEN region % 4 = 2 THEN 0 ELSE 36 END AS lat0, CASE WHEN region % 4 = 2 THEN 9996e-4 ELSE 9999e-4 END AS scale FROM sites),
segments AS (SELECT 'river ' || qid AS name, item_lon AS lon1, item_lat AS lat1, item_lon + 4e-3 AS lon2, item_lat - 2e-3 AS lat2 FROM items),
spots AS (SELECT site_id, lon0, lat0, {plane_sql("lon", "lat", "lon0", "lat0", "scale")} FROM placed),
starts AS (SELECT name, lon0, lat0, {plane_sql("lon1", "lat1", "lon0", "lat0", "scale")} FROM segments, (SELECT DISTINCT lon0, lat0, scale FROM placed)),
stops AS (SELECT name, lon0, lat0, {plane_sql("lon2", "lat2", "lon0", "lat0", "scale")} FROM segments, (SELECT DISTINCT lon0, lat0, scale FROM placed)),
far AS (SELECT site_id, a.name, p.x AS px, p.y AS py, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM spots p JOIN starts a USING (lon0, lat0) JOIN stops b ON b.name = a.name AND b.lon0 = a.lon0 AND b.lat0 = a.lat0),
near AS (SELECT site_id, name, px, py, ax, ay, dx, dy, greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t FROM far),
nearest AS (SELECT site_id, name, sqrt(pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2)) AS d FROM near QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sqrt(pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2)), name) = 1)"""


@query(f"WITH {_PLANES} SELECT site_id, CASE WHEN d <= 10000 THEN name END AS name, CASE WHEN d <= 10000 THEN round(d, 1) END AS distance_m, CASE WHEN d > 10000 THEN 'farther than the limit' END AS note FROM nearest")
def j6_p13_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_segment(planes(spark, sf_dir), segments(spark, sf_dir), size=0.02)


@query("SELECT * FROM (VALUES ('東京都', 6677, 6691), ('北海道', 6680, 6691), ('沖縄県', 6683, 6689), ('京都府', 6674, 6690), (' 高知県 ', 6672, 6690), ('elsewhere', NULL, NULL)) v(name, plane, utm), region")
def g19_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array(*map(F.lit, ("東京都", "北海道", "沖縄県", "京都府", " 高知県 ", "elsewhere"))))
    own = table(spark, sf_dir, "region").select("*", names.alias("name")).withColumn("plane", geo.prefecture_plane(F.col("name")))
    return own.withColumn("utm", geo.plane_utm(F.col("plane")))


@query(f"WITH {SITES}, boxes AS (SELECT n_nationkey AS code, 138.5 + n_nationkey * 5e-2 AS west, 34.5 + n_nationkey * 3e-2 AS south, 138.5 + n_nationkey * 5e-2 + 3e-1 AS east, 34.5 + n_nationkey * 3e-2 + 25e-2 AS north FROM nation) SELECT DISTINCT code FROM sites JOIN boxes ON lon - 15e-2 <= east AND lon + 15e-2 >= west AND lat - 15e-2 <= north AND lat + 15e-2 >= south WHERE region = 7")
def e3_partitions_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.partitions_for(sites(spark, sf_dir), F.col("region") == 7, boxes(spark, sf_dir))


@query("WITH l AS (SELECT s_suppkey AS site_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 7 END AS ql FROM supplier), r AS (SELECT s_suppkey AS site_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 END AS qr FROM supplier) SELECT site_id, coalesce(ql, qr) AS qid, CASE WHEN ql = qr THEN 'both' WHEN ql IS NOT NULL AND qr IS NOT NULL THEN 'conflict' WHEN ql IS NOT NULL THEN 'left' ELSE 'right' END AS direction FROM l FULL JOIN r USING (site_id) WHERE ql IS NOT NULL OR qr IS NOT NULL")
def j8_two_way_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    left = s.select(key.alias("site_id"), F.when(key % 3 != 0, key % 7).alias("qid"))
    right = s.select(key.alias("site_id"), F.when(key % 4 != 0, key % 5).alias("qid"))
    return matching.two_way_pairs(left, right)


@query(f"WITH {SITES}, t AS (SELECT site_id, (lon + 180) / 360 * 32768 AS x, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 32768 AS y FROM sites) SELECT site_id, CAST(floor(x) AS INT) AS x, CAST(floor(y) AS INT) AS y, CAST(floor((x - floor(x)) * 256) AS INT) AS px, CAST(floor((y - floor(y)) * 256) AS INT) AS py FROM t")
def g16_tile_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select("site_id", geo.tile_pixel(F.col("lon"), F.col("lat"), 15).alias("t")).select("site_id", "t.*")


@query("WITH p AS (SELECT p_partkey AS id, (p_partkey * 37) % 256 AS r, (p_partkey * 101) % 256 AS g, p_partkey % 256 AS b FROM part), v AS (SELECT id, r * 65536 + g * 256 + b AS x FROM p) SELECT id, round(CASE WHEN x = 8388608 THEN NULL WHEN x > 8388608 THEN (x - 16777216) * 1e-2 ELSE x * 1e-2 END, 2) AS elevation_m FROM v")
def g17_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(geo.elevation(k * 37 % 256, k * 101 % 256, k % 256), 2).alias("elevation_m"))


@query("SELECT c_custkey AS id, CAST(32600 + floor((((c_custkey * 7) % 360 - 180) + 180e0) / 6) + 1 AS INT) AS epsg FROM customer")
def g18_utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), geo.utm_zone((k * 7 % 360 - 180).cast("double")).alias("epsg"))


@query(f"WITH {SITES}, p AS (SELECT site_id, {plane_sql('lon', 'lat', '(139 + 5e0 / 6)', '36e0', '9999e-4')} FROM sites) SELECT site_id, round(x, 3) AS x, round(y, 3) AS y FROM p")
def g20_plane_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat0, lon0 = geo.PLANE_ORIGINS[6677]
    at = geo.transverse_mercator(F.col("lon"), F.col("lat"), lon0, lat0)
    return sites(spark, sf_dir).select("site_id", at.alias("p")).select("site_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(f"WITH {SITES}, t AS (SELECT CAST(floor((lon + 180) / 360 * 4096 * 256 / 44) AS BIGINT) AS cx, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096 * 256 / 44) AS BIGINT) AS cy FROM sites) SELECT cx, cy, count(*) AS n, CASE WHEN count(*) < 25 THEN 0 WHEN count(*) < 100 THEN 1 WHEN count(*) < 500 THEN 2 ELSE 3 END AS size_step FROM t GROUP BY cx, cy")
def q4_map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a map in cells of 44 pixels at zoom 12."""
    scale = 4096 * 256 / 44
    cx = F.floor((F.col("lon") + 180) / 360 * scale)
    cy = F.floor((1 - F.asinh(F.tan(F.radians("lat"))) / F.pi()) / 2 * scale)
    grid = sites(spark, sf_dir).groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("n"))
    return grid.withColumn("size_step", F.when(F.col("n") < 25, 0).when(F.col("n") < 100, 1).when(F.col("n") < 500, 2).otherwise(3))


@query(
    f"WITH {SITES}, z AS (SELECT unnest(range(3, 13)) AS zoom), t AS (SELECT zoom, CAST(floor((lon + 180) / 360 * pow(2, zoom) * 256 / 44) AS BIGINT) AS cx, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, zoom) * 256 / 44) AS BIGINT) AS cy, lon, lat FROM sites, z) "
    "SELECT CAST(zoom AS INT) AS zoom, cx, cy, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM t GROUP BY zoom, cx, cy"
)
def q4_zoom_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the map at zooms 3 to 12, each from the finer one."""
    out = nearest.zoom_pyramid(sites(spark, sf_dir), 12, 3)
    return out.select("zoom", "cx", "cy", "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"WITH {SITES} SELECT name, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS share FROM sites WHERE name IN ('BUILDING', 'MACHINERY') GROUP BY name")
def q3_p8_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of the chosen families on the map."""
    from pyspark.sql import Window

    own = sites(spark, sf_dir).where(F.col("name").isin("BUILDING", "MACHINERY")).groupBy("name").agg(F.count("*").alias("n"))
    return own.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))
