"""Co-occurrence queries: counts, pairs, labels, collapse, ego graphs, lift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, records, stats
from .base import COUNTS, LABELS_SQL, MENTIONS, PAIRS, TYPED, deal_sql, labels, mention_rows, mentions, query


@query(f"WITH {MENTIONS}, {COUNTS} SELECT id, n FROM counts")
def a5_member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.member_counts(mentions(spark, sf_dir), "ids")


@query(f"WITH {MENTIONS}, {PAIRS} SELECT a, b, w FROM pairs")
def a6_j11_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pair_counts(mentions(spark, sf_dir), "ids")


@query(f"WITH {MENTIONS} SELECT region, count(DISTINCT site_id) AS base FROM mentions GROUP BY region")
def a7_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("region").agg(F.count("*").alias("base"))


_LIFT = f"""{MENTIONS}, base AS (SELECT region, count(DISTINCT site_id) AS base FROM mentions GROUP BY region), total AS (SELECT sum(base) AS total FROM base),
own AS (SELECT id, region, count(*) AS n FROM mentions GROUP BY ALL), lifts AS (SELECT id, region, n, CAST(sum(n) OVER (PARTITION BY id) AS DOUBLE) * base / total AS e FROM own JOIN base USING (region), total),
lift AS (SELECT id, region, n, round(e, 3) AS expected, round(n / e, 3) AS lift FROM lifts)"""


@query(f"WITH {_LIFT} SELECT id, region, n, expected, lift FROM lift")
def a8_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lift(mention_rows(spark, sf_dir))


_TOP = f"{_LIFT}, top AS (SELECT id, region, n, expected, lift FROM lift WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY lift DESC, region) = 1)"


@query(f"WITH {_TOP} SELECT * FROM top")
def w3_top_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_region(a8_lift(spark, sf_dir))


@query(f"WITH {_TOP} SELECT count(*) FILTER (top.region = h.r) AS hits, count(*) AS n FROM (VALUES ('Brand#1', 3), ('Brand#2', 7), ('Brand#9', 11)) h(id, r) LEFT JOIN top USING (id)")
def m17_head_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = spark.createDataFrame([("Brand#1", 3), ("Brand#2", 7), ("Brand#9", 11)], "id string, region int")
    return stats.head_agreement(w3_top_region(spark, sf_dir), heads)


_NULL = f"""{_TOP}, heads AS (SELECT * FROM (VALUES ('Brand#1', 3), ('Brand#2', 7), ('Brand#9', 11)) h(id, head)),
placed AS (SELECT site_id, region, row_number() OVER (ORDER BY site_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT site_id, region FROM mentions)),
of_heads AS (SELECT m.id, p.place, p.n FROM mentions m JOIN heads USING (id) JOIN placed p ON m.site_id = p.site_id), {deal_sql('SELECT DISTINCT place, n FROM of_heads', 200, 20260921)},
drawn AS (SELECT draw, id, p.region, count(*) AS c FROM of_heads JOIN dealt USING (place) JOIN placed p ON p.place = dealt.dealt_to GROUP BY ALL HAVING count(*) >= 3),
tops AS (SELECT draw, id, region FROM drawn JOIN (SELECT id, count(*) AS every FROM of_heads GROUP BY id) USING (id) JOIN base USING (region), total QUALIFY row_number() OVER (PARTITION BY draw, id ORDER BY round(c / (CAST(every AS DOUBLE) * base / total), 3) DESC, region) = 1),
hits AS (SELECT d.draw, count(*) FILTER (tops.region = head) AS hits FROM range(200) d(draw) LEFT JOIN tops USING (draw) LEFT JOIN heads USING (id) GROUP BY d.draw),
seen AS (SELECT count(*) FILTER (top.region = head) AS observed FROM heads LEFT JOIN top USING (id)), shares AS (SELECT list_sort(list(hits)) AS x FROM hits)"""


@query(
    f"WITH {_NULL} SELECT count(*) AS trials, observed, round(avg(hits), 3) AS mean, x[191] AS p95, max(hits) AS max, round((count(*) FILTER (hits >= observed) + 1) / 201e0, 4) AS p_value, observed > x[191] AS pass FROM hits, seen, shares GROUP BY observed, x"
)
def m16_null_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = spark.createDataFrame([("Brand#1", 3), ("Brand#2", 7), ("Brand#9", 11)], "id string, region int")
    drawn = stats.null_hits(mention_rows(spark, sf_dir), heads, 200, 20260921)
    return stats.null_summary(drawn, m17_head_agreement(spark, sf_dir))


_JACCARD = f"{TYPED}, j AS (SELECT p.a, p.b, p.w, p.type, x.n AS na, y.n AS nb, round(CAST(p.w AS DOUBLE) / (x.n + y.n - p.w), 4) AS jaccard FROM typed p JOIN counts x ON p.a = x.id JOIN counts y ON p.b = y.id)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.typed(graph.pair_counts(mentions(spark, sf_dir), "ids"), labels(spark))


@query(f"WITH {_JACCARD} SELECT a, b, w, na, nb, jaccard FROM j")
def a9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.jaccard(a6_j11_pair_counts(spark, sf_dir), a5_member_counts(spark, sf_dir)).select("a", "b", "w", "na", "nb", "jaccard")


@query(f"WITH {TYPED} SELECT a, b, w, type FROM typed")
def j12_typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir)


@query(f"WITH {_JACCARD}, s AS (SELECT l.a, l.b, l.type, coalesce(jaccard, 0) AS jaccard, row_number() OVER (ORDER BY coalesce(jaccard, 0) DESC, l.a, l.b) AS rank FROM labels_of l LEFT JOIN j USING (a, b)) SELECT a, b, type, jaccard, rank <= (SELECT count(*) FROM labels_of WHERE type = 'identity') AS predicted FROM s")
def w4_predicted_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k labelled pairs of the largest Jaccard are predicted to be identities, k being how many there are."""
    own = labels(spark)
    scored = own.join(a9_jaccard(spark, sf_dir).select("a", "b", "jaccard"), ["a", "b"], "left").na.fill(0.0, ["jaccard"])
    k = own.where("type = 'identity'").agg(F.count("*").alias("k"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("jaccard"), "a", "b"))  # labels are a small frozen table
    return scored.withColumn("rank", rank).crossJoin(F.broadcast(k)).select("a", "b", "type", "jaccard", (F.col("rank") <= F.col("k")).alias("predicted"))


_ROOTS = f"WITH RECURSIVE {TYPED}, e AS (SELECT a, b FROM typed WHERE type = 'identity' UNION ALL SELECT b, a FROM typed WHERE type = 'identity'), reach(node, other) AS (SELECT a, b FROM e UNION SELECT node, e.b FROM reach JOIN e ON other = e.a), roots AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node)"


@query(f"{_ROOTS} SELECT node, root FROM roots")
def r5_identity_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.identity_roots(_typed(spark, sf_dir))


@query(f"{_ROOTS} SELECT coalesce(root, id) AS id, max(n) AS n, count(*) AS members, string_agg(id, '・' ORDER BY n DESC, id) AS name FROM counts LEFT JOIN roots ON id = node GROUP BY coalesce(root, id)")
def r6_collapsed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collapsed_nodes(a5_member_counts(spark, sf_dir), r5_identity_roots(spark, sf_dir))


_COLLAPSED = f"{_ROOTS}, m AS (SELECT coalesce(x.root, a) AS ra, coalesce(y.root, b) AS rb, w, type FROM typed LEFT JOIN roots x ON a = x.node LEFT JOIN roots y ON b = y.node), collapsed AS (SELECT least(ra, rb) AS a, greatest(ra, rb) AS b, CAST(sum(w) AS BIGINT) AS w, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'mixed' END AS type FROM m WHERE ra <> rb GROUP BY 1, 2)"


@query(f"{_COLLAPSED} SELECT a, b, w, type FROM collapsed")
def r6_j18_collapsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir)
    return graph.collapsed_edges(typed, graph.identity_roots(typed))


_ORDER = "CASE type WHEN 'identity' THEN 0 WHEN 'kin' THEN 1 WHEN 'partof' THEN 2 WHEN 'mixed' THEN 3 WHEN 'other' THEN 4 ELSE 5 END"
_RING = f"""near AS (SELECT a AS centre, b AS other, w, type FROM {{e}} UNION ALL SELECT b, a, w, type FROM {{e}}),
ring AS (SELECT centre, other, w, type, row_number() OVER (PARTITION BY centre ORDER BY {_ORDER}, w DESC, other) - 1 AS place, count(*) OVER (PARTITION BY centre) AS total FROM near QUALIFY place < 14)"""
_PLACED = "SELECT centre, other, w, type, place, total, round(320 * cos(2 * pi() * place / least(total, 14) - pi() / 2), 4) AS x, round(320 * sin(2 * pi() * place / least(total, 14) - pi() / 2), 4) AS y FROM ring"


@query(f"WITH {TYPED}, {_RING.format(e='typed')} {_PLACED}")
def r7_w5_ego_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ring(_typed(spark, sf_dir))


@query(f"WITH {TYPED}, {_RING.format(e='typed')} SELECT centre, other, w, type, row_number() OVER (PARTITION BY centre ORDER BY w DESC, other) AS rank FROM near QUALIFY rank <= 14")
def w5_ranked_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ranked_neighbours(_typed(spark, sf_dir), 14)


@query(f"WITH {_LIFT}, {COUNTS}, s AS (SELECT id FROM counts WHERE contains(id, '#1')), r AS (SELECT id, region, n, expected, CASE WHEN n >= 90 THEN lift END AS lift, row_number() OVER (PARTITION BY id ORDER BY lift DESC, region) AS place FROM lift JOIN s USING (id)) SELECT * FROM r WHERE place <= 8")
def q6_selected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of the selected ids by lift, the first eight of each; a lift under the floor is hidden."""
    names = a5_member_counts(spark, sf_dir).select("id")
    return graph.selected_regions(records.searched(names, "id", "#1 "), a8_lift(spark, sf_dir), 8, 90)


@query(f"WITH {_JACCARD} SELECT l.a, l.b, l.type, coalesce(j.w, 0) AS w, row_number() OVER (ORDER BY coalesce(j.w, 0) DESC, l.a, l.b) AS place FROM labels_of l LEFT JOIN j USING (a, b) UNION ALL SELECT a, b, type, w, NULL FROM j WHERE type = 'unlabeled' AND w >= 300")
def q6_w12_pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled pairs in order of weight, and the unlabelled ones of at least a weight."""
    pairs = _typed(spark, sf_dir)
    return graph.pair_table(pairs, labels(spark), 300)


@query(f"WITH {TYPED}, {_RING.format(e='typed')}, m AS (SELECT centre, other AS n FROM ring UNION SELECT centre, centre FROM ring) SELECT x.centre, t.a, t.b, t.w, t.type FROM typed t JOIN m x ON x.n = t.a JOIN m y ON y.n = t.b AND y.centre = x.centre")
def r7_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.induced_edges(r7_w5_ego_ring(spark, sf_dir), _typed(spark, sf_dir))


@query(f"{_COLLAPSED} SELECT c.a, c.b, c.w, t.w AS w_plain FROM collapsed c LEFT JOIN typed t USING (a, b) WHERE t.w IS NULL OR t.w <> c.w OR t.type <> c.type")
def r8_changed_by_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the collapsed view that the plain view does not have alike."""
    plain = _typed(spark, sf_dir).select("a", "b", F.col("w").alias("w_plain"), F.col("type").alias("t"))
    both = r6_j18_collapsed_edges(spark, sf_dir).join(plain, ["a", "b"], "left")
    return both.where(F.col("w_plain").isNull() | (F.col("w_plain") != F.col("w")) | (F.col("t") != F.col("type"))).select("a", "b", "w", "w_plain")


@query(f"WITH {MENTIONS}, {COUNTS} SELECT site_id, region FROM mentions WHERE id = 'Brand#1'")
def j17_points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of one selected id."""
    return mentions(spark, sf_dir).where(F.array_contains("ids", "Brand#1")).select("site_id", "region")
