"""Record-level queries: rejects, rights, folds, parsers, joins by key and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import records
from ..operators.stats import running_counts
from .base import SITES, query, sites, table

_RAW = f"{SITES}, raw AS (SELECT site_id // 2 * 2 AS id, site_id AS place, CASE WHEN site_id % 13 = 0 THEN NULL ELSE lon END AS lon, CASE WHEN site_id % 17 = 0 THEN lat + 20 ELSE lat END AS lat FROM sites)"
_REASON = """early AS (SELECT *, CASE WHEN lon IS NULL OR lat IS NULL THEN 'no_coordinates' WHEN NOT (lon BETWEEN 122 AND 154.1 AND lat BETWEEN 20.2 AND 45.8) THEN 'outside_bounds' END AS r FROM raw),
judged AS (SELECT id, place, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY id, r IS NULL ORDER BY place) > 1 THEN 'duplicate_id' END) AS reason FROM early)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of which some lack coordinates, lie far off, or repeat an id."""
    s = sites(spark, sf_dir)
    k = F.col("site_id")
    return s.select((F.floor(k / 2) * 2).alias("id"), k.alias("place"), F.when(k % 13 != 0, F.col("lon")).alias("lon"), F.when(k % 17 == 0, F.col("lat") + 20).otherwise(F.col("lat")).alias("lat"))


@query(f"WITH {_RAW}, {_REASON} SELECT id, place, reason FROM judged")
def p2_p3_p4_w1_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_reject_reason(raw(spark, sf_dir), "id", ["place"]).select("id", "place", "reason")


@query(f"WITH {_RAW}, {_REASON} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1")
def a3_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_p3_p4_w1_reject_reasons(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'place_' || CASE o_orderkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'w' ELSE 'r' END || o_orderkey AS id FROM orders")
def p1_surrogate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "node").when(k % 3 == 1, "way").otherwise("relation")
    return table(spark, sf_dir, "orders").select("o_orderkey", records.surrogate_id("place_", kind, k).alias("id"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN nullif('', '') ELSE source END, lang) AS name FROM documents")
def p5_fallback_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    own = F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", records.or_missing(own, F.col("lang")).alias("name"))


_CODES = ("cc0", " pdm ", "ccby", "CCBY", "ccbysa", "", "unknown", "incr", "noncom")


@query(
    f"WITH c AS (SELECT doc_id, nullif(trim(list_extract({list(_CODES)}, CAST(doc_id % 10 AS INT) + 1)), '') AS code FROM documents) SELECT doc_id, coalesce(code IN {records.RIGHTS_CODES}, false) AS code_known, coalesce(code IN {records.USABLE}, false) AS usable, coalesce(code IN {records.CREDITED}, false) AS credit FROM c"
)
def p6_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("doc_id") % 10).cast("int"))
    own = table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    return records.with_rights(own, "code").drop("code")


@query("SELECT c.c_custkey AS site_id, n.n_name AS region, s.s_name AS supplier FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey * 15")
def j1_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 15).alias("site_id"), F.col("s_name").alias("supplier"))
    return records.attach(records.attach(core, "n_nationkey", nation), "site_id", supplier).select("site_id", "region", "supplier")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j9_p12_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j10_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Q' || s_suppkey ELSE n_name END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def j13_fallback_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First language, else the second, else the id of the entity."""
    own = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    uri = F.concat(F.lit("http://example.org/entity/Q"), k)
    return own.select("s_suppkey", F.coalesce(F.when(k % 4 == 1, F.col("n_name")), F.when(k % 4 > 1, F.col("n_name")), text.entity_id(uri)).alias("label"))


@query("WITH a AS (SELECT o_orderstatus AS key, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_orderstatus AS key, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) SELECT key, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (key) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
def j16_k11_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "key")
    before = o.where("o_orderkey % 3 = 0 and key <> 'P'").groupBy("key").agg(F.count("*").alias("n"))
    after = o.where("o_orderkey % 3 <> 0").groupBy("key").agg(F.count("*").alias("n"))
    return records.changes(before, after, "key")


@query("SELECT o_custkey AS key, arg_min(o_orderpriority, o_orderkey) AS label, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, min(o_totalprice) AS least FROM orders GROUP BY o_custkey")
def a1_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "key", "o_orderkey": "ordinal"})
    out = records.fold(o, "key", {"label": "o_orderpriority"}, {"statuses": "o_orderstatus", "prices": "o_totalprice"})
    return out.select("key", "label", F.array_join("statuses", ",").alias("statuses"), F.get("prices", 0).alias("least"))


@query("WITH f AS (SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1), p AS (SELECT o_custkey AS k, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT c_custkey AS k, first_priority, flags FROM customer LEFT JOIN f ON k = c_custkey LEFT JOIN p ON p.k = c_custkey")
def a2_attribute_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ordinal"), "o_orderpriority")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ordinal"), "l_returnflag").join(o, "ordinal")
    first = records.fold(o, "k", {"first_priority": "o_orderpriority"})
    flags = records.fold(line, "k", sets={"flags": "l_returnflag"}).withColumn("flags", F.array_join("flags", ","))
    return records.attach(core, "k", first, flags)


@query("SELECT count(*) AS n, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity >= 25 AND l_tax = 0) AS untaxed FROM lineitem")
def a4_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.count_if(c("l_discount") > 0.05).alias("discounted"), F.count_if(c("l_returnflag") == "R").alias("returned"), F.count_if((c("l_quantity") >= 25) & (c("l_tax") == 0)).alias("untaxed"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS host_path FROM pages")
def g9_host_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.host_path(F.col("url")).alias("host_path"))


@query("SELECT o_orderkey, try_cast(regexp_extract(o_orderpriority, '^[0-9]+', 0) AS DOUBLE) AS level FROM orders")
def g11_numeric_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.numeric_prefix(F.col("o_orderpriority")).alias("level"))


@query(f"WITH {SITES} SELECT site_id, round(lon, 4) AS lon, round(lat, 4) AS lat FROM sites")
def g12_wkt_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    wkt = F.format_string("Point(%.4f %.4f)", "lon", "lat")
    return sites(spark, sf_dir).select("site_id", text.wkt_point(wkt).alias("p")).select("site_id", "p.lon", "p.lat")


@query("WITH y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * year(o_orderdate) AS y, 6 + o_orderkey % 5 AS p FROM orders), s AS (SELECT *, CASE WHEN p >= 9 THEN 1 WHEN p = 8 THEN 10 WHEN p = 7 THEN 100 END AS step FROM y) SELECT o_orderkey, CAST(floor(CAST(y AS DOUBLE) / step) * step AS INT) AS year_min, CAST(floor(CAST(y AS DOUBLE) / step) * step + step - 1 AS INT) AS year_max FROM s")
def g13_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.concat(F.when(k % 4 == 0, "-").otherwise("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.year_range(value, 6 + k % 5).alias("r")).select("o_orderkey", "r.year_min", "r.year_max")


@query("SELECT s_suppkey, 'Q' || s_suppkey AS qid, CASE WHEN s_suppkey % 9 = 0 THEN 1000000000000 ELSE s_suppkey END AS number FROM supplier")
def g14_entity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    qid = text.entity_id(F.concat(F.lit("http://example.org/entity/Q"), k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", qid.alias("qid"), text.entity_number(F.when(k % 9 == 0, F.lit("none")).otherwise(qid)).alias("number"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') || ' +x' AS title, replace(p_name, ' ', '_') AS base FROM part")
def g15_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://example.org/wiki/"), F.replace("p_name", F.lit(" "), F.lit("%5F")), F.lit("_+x"))
    title = text.page_title(url)
    own = table(spark, sf_dir, "part").select("p_partkey", F.replace(title, F.lit(" +x"), F.lit("~")).alias("t"))
    name = F.replace(F.replace("t", F.lit(" "), F.lit("_")), F.lit("~"), F.lit(" +x"))
    return own.select("p_partkey", name.alias("title"), text.base_title(F.concat(F.split_part(name, F.lit(" +x"), F.lit(1)), F.lit(" (y)"))).alias("base"))


@query("SELECT doc_id, CASE WHEN ('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 2))::INT % 2 = 0 THEN 'calibration' ELSE 'holdout' END AS half FROM documents")
def g22_parity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.parity_half(F.col("doc_id")).alias("half"))


@query("SELECT doc_id, sha256('m1@r2|' || text) AS key FROM documents WHERE text IS NOT NULL")
def g23_content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.content_key("m1@r2", F.col("text")).alias("key"))


@query("SELECT c_custkey, upper(regexp_extract(p, '(FOUND|HOLD|ING)$', 1)) AS suffix FROM (SELECT c_custkey, c_mktsegment AS p FROM customer) WHERE regexp_matches(p, '(FOUND|HOLD|ING)$')")
def g10_part_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", text.part_suffix(F.col("c_mktsegment"), ("HOLD", "ING", "FOUND")).alias("suffix"))
    return own.where("suffix is not null")


@query("SELECT event_id, CASE WHEN value <= 10 THEN value END AS value, CASE WHEN value > 10 THEN 'beyond the range' END AS note FROM events")
def p13_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, note = records.capped(F.col("value"), 10.0, "beyond the range")
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"), note.alias("note"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def p9_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.searched(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", " ring ")


@query("SELECT c_custkey, c_custkey % 4 < 3 AS id_ok, c_nationkey >= 10 AS code_ok FROM customer")
def p10_valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("jinja_"), F.get(F.array(*map(F.lit, "nwrx")), (k % 4).cast("int")), k.cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", records.valid_id(name).alias("id_ok"), records.valid_partition(F.col("c_nationkey").cast("string")).alias("code_ok"))


@query("SELECT doc_id, 'note' AS path, 'text' AS kind FROM documents WHERE length(text) >= 300 UNION ALL SELECT doc_id, 'meta.body', 'text' FROM documents WHERE length(text) >= 120")
def p11_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents")
    numbers = F.sequence(F.lit(1), (F.col("doc_id") % 31 + 1).cast("int"))
    return records.leaks(own.select("doc_id", F.col("text").alias("note"), F.struct(F.col("text").alias("body"), F.col("lang").alias("vector"), numbers.alias("scores")).alias("meta")), "doc_id")


@query("SELECT o_custkey % 10 AS part, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS n_aliases FROM orders GROUP BY 1")
def k2_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import counts_of, index_of

    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), (F.col("o_custkey") % 10).alias("part"))
    old = own.where(F.col("key").cast("long") % 3 == 0).select(F.concat(F.lit("old"), "key").alias("alias"), F.col("key").alias("site_id"))
    return counts_of(index_of(own, old, "key", "part"), "part")


@query("SELECT place, c_custkey, c_acctbal FROM (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, c_custkey, c_acctbal FROM customer)")
def w12_sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with their place in the listing; places come from ranges, not from one task."""
    own = table(spark, sf_dir, "customer").select((-F.col("c_acctbal")).alias("less"), "c_custkey", F.lit(1).alias("one"))
    return running_counts(own, [], ["less", "c_custkey"], "one").select(F.col("_upto").alias("place"), "c_custkey", (-F.col("less")).alias("c_acctbal"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def w14_first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three examples of each key, in a total order."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return own.withColumn("n", F.row_number().over(order)).where("n <= 3").select("o_custkey", "o_orderkey")


@query("SELECT * FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def r9_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    union = o.select(F.col("o_custkey").alias("k")).union(c.select("c_custkey")).distinct()
    return union.subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_custkey AS k, 'left' AS side FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def a26_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import same_sets

    return same_sets(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [CAST(c_custkey AS DOUBLE), CAST(c_nationkey AS DOUBLE)]}, 'properties': {'c_name': c_name, 'c_mktsegment': c_mktsegment}})::VARCHAR AS feature FROM customer")
def k4_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import features

    own = table(spark, sf_dir, "customer").withColumns({"x": F.col("c_custkey").cast("double"), "y": F.col("c_nationkey").cast("double")})
    return features(own, "x", "y", ["c_name", "c_mktsegment"])
