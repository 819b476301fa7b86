"""Components, co-occurrence, collapsed identities and ego graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the edges; root is the smallest node of its component.

    Alternating large-star and small-star rounds: each is an aggregate and a
    join, written out, until a round changes nothing; a star of any size is
    combined early or split.  Self-loops and repeated edges do no harm, an edge
    with a null end is ignored.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
    edges = cut(edges.distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "large-star")
        linked = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = cut(linked.select("a", F.col("m").alias("b")).union(linked.select("b", "m")).where("a <> b").distinct(), "small-star")
        discard(edges, large)
        edges, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select("root", "root").distinct())


def _mark(edges: DataFrame):
    """Number of edges and an order-free checksum of them."""
    return edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def pair_counts(sets: DataFrame, members: str) -> DataFrame:
    """(a, b, w): in how many rows two members of the array column occur together, a < b."""
    own = F.array_sort(F.array_distinct(members))
    pairs = F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return sets.select(F.explode(F.flatten(pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("w"))


def member_counts(sets: DataFrame, members: str) -> DataFrame:
    return sets.select(F.explode(F.array_distinct(members)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def jaccard(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    a, b = (counts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    union = F.col("na") + F.col("nb") - F.col("w")
    return pairs.join(a, "a").join(b, "b").withColumn("jaccard", F.when(union > 0, F.round(F.col("w") / union, 4)).otherwise(0.0))


def typed(pairs: DataFrame, labels: DataFrame, missing: str = "unlabeled") -> DataFrame:
    """Adds the type of each pair from labels (a, b, type), whose ends come in any order."""
    own = labels.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "type")
    return pairs.join(F.broadcast(own) if own.isLocal() else own, ["a", "b"], "left").withColumn("type", F.coalesce("type", F.lit(missing)))


def identity_roots(typed_pairs: DataFrame) -> DataFrame:
    """(node, root) over the pairs of type identity that co-occur."""
    return connected_components(typed_pairs.where("type = 'identity' and w > 0"))


def rooted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Both ends replaced by their roots, a < b, self-pairs dropped."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    out = edges.join(a, "a", "left").join(b, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return out.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), *rest)


def collapsed_nodes(counts: DataFrame, roots: DataFrame) -> DataFrame:
    """Groups of identical members: n is the largest of the members', name joins them by n and id."""
    own = counts.join(roots, counts["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "id")))
    return own.groupBy("root").agg(F.max("n").alias("n"), F.count("*").alias("members"), order.alias("m")).select(F.col("root").alias("id"), "n", "members", F.array_join(F.transform("m", lambda x: x["id"]), "・").alias("name"))


def collapsed_edges(typed_pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Weights added up; the type stays if it is the same for all, else mixed."""
    out = rooted(typed_pairs, roots).groupBy("a", "b").agg(F.sum("w").alias("w"), F.min("type").alias("t1"), F.max("type").alias("t2"))
    return out.select("a", "b", "w", F.when(F.col("t1") == F.col("t2"), F.col("t1")).otherwise("mixed").alias("type"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(centre, other, w, type) in both directions."""
    back = edges.select(F.col("b").alias("centre"), F.col("a").alias("other"), "w", "type")
    return edges.select(F.col("a").alias("centre"), F.col("b").alias("other"), "w", "type").union(back)


#: Types of pairs in the order in which a ring shows them.
TYPE_ORDER = ("identity", "kin", "partof", "mixed", "other", "unlabeled")


def ranked_neighbours(edges: DataFrame, most: int) -> DataFrame:
    """(centre, other, w, type, rank) of the ``most`` heaviest neighbours of each node, ties by id."""
    rank = F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("w"), "other"))
    return neighbours(edges).withColumn("rank", rank).where(F.col("rank") <= most)


def ring(edges: DataFrame, most: int = 14, radius: float = 320.0, types: tuple[str, ...] = TYPE_ORDER) -> DataFrame:
    """Neighbours of each node on a ring: in order of type, weight and id the first ``most``, with place, position and how many there are in all."""
    order = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
    own = neighbours(edges).withColumn("_o", F.when(order > 0, order).otherwise(len(types) + 1))
    rank = F.row_number().over(Window.partitionBy("centre").orderBy("_o", F.desc("w"), "other"))
    # a bound on the rank itself lets each task keep the first ones of a hub before they are sent
    near = own.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("place", F.col("rank") - 1)
    total = own.groupBy("centre").agg(F.count("*").alias("total"))
    angle = 2 * F.pi() * F.col("place") / F.least("total", F.lit(most).cast("long")) - F.pi() / 2
    return near.join(total, "centre").select("centre", "other", "w", "type", "place", "total", F.round(radius * F.cos(angle), 4).alias("x"), F.round(radius * F.sin(angle), 4).alias("y"))


def induced_edges(ring_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (a < b) among the members of each ego graph: (centre, a, b, w, type).

    A ring is short, so its pairs of members are few and meet the edges by both
    ends; a hub's edges are never repeated for the rings that it stands in.
    """
    own = ring_rows.groupBy("centre").agg(F.array_sort(F.array_union(F.collect_set("other"), F.array("centre"))).alias("m"))
    pairs = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return own.select("centre", F.explode(F.flatten(pairs)).alias("p")).select("centre", "p.a", "p.b").join(edges, ["a", "b"]).select("centre", "a", "b", "w", "type")


def selected_regions(selected: DataFrame, lifts: DataFrame, most: int, floor: int) -> DataFrame:
    """(id, region, n, expected, lift, place): of each selected id the regions of the largest lifts; a lift from fewer than ``floor`` sites is null."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("lift"), "region"))
    own = lifts.join(selected, "id", "left_semi").withColumn("place", place).where(F.col("place") <= most)
    return own.select("id", "region", "n", "expected", F.when(F.col("n") >= floor, F.col("lift")).alias("lift"), "place")


def pair_table(typed_pairs: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(a, b, type, w, place): labelled pairs in order of weight, then, without a place, the unlabelled ones of at least ``least``.

    Labels are a small frozen table, which is what one window may sort.
    """
    own = labels.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "type")
    met = own.join(typed_pairs.select("a", "b", "w"), ["a", "b"], "left").withColumn("w", F.coalesce("w", F.lit(0).cast("long")))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("w"), "a", "b")).cast("long")
    rest = typed_pairs.where((F.col("type") == "unlabeled") & (F.col("w") >= least)).select("a", "b", "type", "w", F.lit(None).cast("long").alias("place"))
    return met.select("a", "b", "type", "w", place.alias("place")).union(rest)
