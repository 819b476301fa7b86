"""Operators on hand-made rows, against brute force, and with their input in another order."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from placelens.operators import articles, classify, eventlog, graph, matching, nearest, records, state, stats, vectors




def sites(spark, rows):
    return spark.createDataFrame(rows, "site_id string, lon double, lat double, name string, kind string")


def test_reject_reasons(spark):
    rows = [(1, 0, 139.0, 35.0), (2, 1, None, 35.0), (3, 2, 100.0, 35.0), (1, 3, 139.0, 35.0), (4, 4, 122.0, 20.2)]
    df = spark.createDataFrame(rows, "id long, place int, lon double, lat double")
    for order in (df, df.orderBy(F.desc("place"))):
        got = {r.place: r.reason for r in records.with_reject_reason(order, "id", ["place"]).collect()}
        assert got == {0: None, 1: "no_coordinates", 2: "outside_bounds", 3: "duplicate_id", 4: None}


def test_rights_are_denied_unless_known_and_allowed(spark):
    df = spark.createDataFrame([("cc0",), (" ccby ",), ("CC0",), ("",), (None,), ("ccbysa",), ("new",)], "code string")
    got = [(r.code_known, r.usable, r.credit) for r in records.with_rights(df, "code").collect()]
    assert got == [(True, True, False), (True, True, True), (False, False, False), (False, False, False), (False, False, False), (True, False, True), (False, False, False)]


def test_fold_takes_the_first_by_ordinal(spark):
    df = spark.createDataFrame([("a", 2, "x", 5), ("a", 1, None, 5), ("a", 3, "y", 4), ("b", 1, None, None)], "k string, ordinal int, label string, v int")
    for order in (df, df.orderBy(F.desc("ordinal"))):
        got = {r.k: (r.label, r.vs) for r in records.fold(order, "k", {"label": "label"}, {"vs": "v"}).collect()}
        assert got == {"a": ("x", [4, 5]), "b": (None, [])}


def test_guarded_reference_table(spark):
    good = spark.createDataFrame([(1, "approved_frozen")], "a int, _status string")
    assert records.approved(good, "_status").columns == ["a"]
    with pytest.raises(ValueError, match="draft"):
        records.approved(good.withColumn("_status", F.lit("draft")), "_status")


def site_columns(df):
    empty = F.array().cast("array<string>")
    return df.withColumns({"names": F.array("name"), "aliases": empty, "prefecture": F.lit("p"), "municipality": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})


def item_rows(spark, rows):
    df = spark.createDataFrame(rows, "qid string, item_lon double, item_lat double, label string")
    empty = F.array().cast("array<string>")
    return df.withColumns({"item_names": F.array("label"), "item_aliases": empty, "admin": F.lit("p"), "item_url": F.lit(None).cast("string")})


def test_scores_and_best_match(spark):
    own = site_columns(sites(spark, [("s1", 139.0, 35.0, "abc", "node"), ("s2", 139.5, 35.5, "abc", "node")]))
    items = item_rows(spark, [("Q2", 139.0, 35.0, "abc"), ("Q1", 139.0, 35.0, "abc"), ("Q3", 140.5, 35.0, "abc")])
    scored = matching.scored_candidates(own, items)
    got = {r.site_id: (r.qid, round(r.score, 6), r.decision) for r in matching.best_match(own, scored).collect()}
    assert got == {"s1": ("Q1", 0.8, "auto"), "s2": (None, 0.0, "separate")}


@pytest.mark.parametrize("floor", [0.0, 0.5, 0.6])
def test_scores_from_a_floor_are_those_of_all_pairs(spark, floor):
    r = random.Random(5)
    names = ["abc", "abd", "xyz", "", None]
    own = site_columns(sites(spark, [(f"s{i}", 139 + r.random() / 80, 35 + r.random() / 80, r.choice(names), "node") for i in range(40)]))
    items = item_rows(spark, [(f"Q{i}", 139 + r.random() / 80, 35 + r.random() / 80, r.choice(names)) for i in range(40)])
    rows = lambda df: sorted((x.site_id, x.qid, x.score) for x in df.collect())
    assert rows(matching.scored_candidates(own, items, floor=floor)) == rows(matching.scored_candidates(own, items).where(F.col("score") >= floor - 1e-9))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_to_one_is_the_greedy_walk(spark, seed):
    r = random.Random(seed)
    edges = list({(r.randrange(12), r.randrange(12)): r.choice([0.5, 0.6, 0.7]) for _ in range(60)}.items())
    edges = [(a, b, s) for (a, b), s in edges]
    want, left, right = set(), set(), set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[1], e[0])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    df = spark.createDataFrame(edges, "l int, r int, s double")
    for most in (0, 8, 1000):  # rounds alone, both, one walk
        got = matching.one_to_one(df, "l", "r", [-F.col("s"), F.col("r"), F.col("l")], most)
        assert sorted((x.l, x.r) for x in got.collect()) == sorted(want)


def test_one_to_one_walks_long_chains_by_component(spark, monkeypatch):
    """Chains of edges that wait for each other, of 600 edges each, in rounds that don't grow with the chain."""
    rounds, plain_round = [], matching._round
    monkeypatch.setattr(matching, "_round", lambda *a: rounds.append(1) or plain_round(*a))
    edges = [(c * 1000 + i // 2, c * 1000 + (i + 1) // 2, float(i)) for c in range(4) for i in range(600)]
    df = spark.createDataFrame(edges, "l int, r int, s double")
    got = matching.one_to_one(df, "l", "r", [F.col("s"), F.col("l")], 700)
    assert sorted((x.l, x.r) for x in got.collect()) == sorted((a, b) for a, b, s in edges if s % 2 == 0)
    assert len(rounds) <= 10


def test_one_to_one_without_edges_and_with_null_ends(spark):
    df = spark.createDataFrame([(None, 1, 0.5), (1, None, 0.6)], "l int, r int, s double")
    order = [-F.col("s"), F.col("r"), F.col("l")]
    assert matching.one_to_one(df, "l", "r", order).count() == 0
    assert matching.one_to_one(df.limit(0), "l", "r", order).count() == 0
    more = df.union(spark.createDataFrame([(1, 1, 0.4), (2, 1, 0.4)], df.schema))
    assert [(x.l, x.r) for x in matching.one_to_one(more, "l", "r", order).collect()] == [(1, 1)]


def test_one_to_one_prefers_the_older_item(spark):
    own = sites(spark, [("s1", 139.0, 35.0, "abc", "node")])
    cand = spark.createDataFrame([("s1", "Q9", 0.7, 30.0, 1.0), ("s1", "Q10", 0.7, 20.0, 1.0), ("s1", "Q1", 0.4, 1.0, 1.0)], "site_id string, qid string, score double, distance_m double, name_sim double")
    from placelens.functions.text import entity_number

    [got] = matching.resolve_one_to_one(own, cand, entity_number(F.col("qid"))).collect()
    assert (got.qid, got.decision) == ("Q9", "auto")


def merge(spark, rows, matched=()):
    own = sites(spark, rows)
    matches = spark.createDataFrame([(s, q, "auto") for s, q in matched], "site_id string, qid string, decision string")
    pairs = matching.guarded(matching.same_name_pairs(own, F.col("name")), matches)
    rank = F.when(F.col("kind") == "relation", 0).when(F.col("kind") == "way", 1).when(F.col("kind") == "node", 2).otherwise(9)
    members = matching.merge_components(own, pairs, matches, rank)
    kept = {r.site_id: r.merged_from for r in matching.merged(own, members).collect()}
    return kept, {r.alias: r.site_id for r in matching.aliases(members).collect()}, pairs.where("blocked").count()


METRE = 1 / 111_195.08


def test_merge_radius_and_survivor(spark):
    kept, led, _ = merge(spark, [("n1", 139.0, 35.0, "abc", "node"), ("w2", 139.0, 35 + 145 * METRE, "a bc", "way"), ("n3", 139.0, 35 - 151.5 * METRE, "abc", "node")])
    assert kept == {"w2": ["n1"], "n3": None} and led == {"n1": "w2"}
    kept, led, _ = merge(spark, [("n1", 139.0, 35.0, "abc", "node"), ("w2", 139.0, 35 + 10 * METRE, "abc", "way"), ("r3", 139.0, 35 + 20 * METRE, "abc", "relation")])
    assert kept == {"r3": ["n1", "w2"]} and led == {"n1": "r3", "w2": "r3"}


def test_merge_guards(spark):
    two = [("a", 139.0, 35.0, "abc", "node"), ("b", 139.0, 35 + 100 * METRE, "abc", "node")]
    kept, _, blocked = merge(spark, two, [("a", "Q1"), ("b", "Q2")])
    assert set(kept) == {"a", "b"} and blocked == 1
    chain = two + [("c", 139.0, 35 + 200 * METRE, "abc", "node")]
    kept, _, _ = merge(spark, chain, [("a", "Q1"), ("c", "Q2")])
    assert set(kept) == {"a", "b", "c"}


def test_two_way_pairs(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "site_id int, qid string")
    right = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d"), (5, None)], "site_id int, qid string")
    got = {(r.site_id, r.direction) for r in matching.two_way_pairs(left, right).collect()}
    assert got == {(1, "both"), (2, "conflict"), (3, "left"), (4, "right")}


def test_nearest_segment_against_all_segments(spark):
    r = random.Random(5)
    points = [(f"s{i}", 139 + r.random() * 0.1, 35 + r.random() * 0.1) for i in range(30)]
    lines = [(f"r{i:02d}", 139 + r.random() * 0.1, 35 + r.random() * 0.1) for i in range(25)]
    lines = [(n, x, y, x + r.uniform(-0.02, 0.02), y + r.uniform(-0.02, 0.02)) for n, x, y in lines] + [("point", 139.05, 35.05, 139.05, 35.05)]
    own = spark.createDataFrame(points + [("far", 145.0, 40.0)], "site_id string, lon double, lat double")
    segments = spark.createDataFrame(lines, "name string, lon1 double, lat1 double, lon2 double, lat2 double")
    got = {x.site_id: (x.name, x.distance_m, x.note) for x in nearest.nearest_segment(own, segments).collect()}
    coarse = {x.site_id: (x.name, x.distance_m) for x in nearest.nearest_segment(own, segments, size=1.0).collect()}
    assert got.pop("far") == (None, None, "nothing in the cells around")
    assert all(got[k][:2] == coarse[k] for k in got)
    for name, x, y in points:
        flat = []
        for n, x1, y1, x2, y2 in lines:
            kx, ky = 111_320 * 0.8171, 110_950
            px, py, qx, qy = (x - x1) * kx, (y - y1) * ky, (x2 - x1) * kx, (y2 - y1) * ky
            s = qx * qx + qy * qy
            t = max(0, min(1, (px * qx + py * qy) / s)) if s else 0
            flat.append(((px - t * qx) ** 2 + (py - t * qy) ** 2) ** 0.5)
        assert abs(got[name][1] - min(flat)) < 0.01 * min(flat) + 1


def test_pairs_and_collapse(spark):
    sets = spark.createDataFrame([(1, ["c", "a", "a", "b"]), (2, ["a", "b"]), (3, [])], "i int, ids array<string>")
    pairs = graph.pair_counts(sets, "ids")
    assert {(r.a, r.b): r.w for r in pairs.collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    labels = spark.createDataFrame([("b", "a", "identity")], "a string, b string, type string")
    typed = graph.typed(pairs, labels)
    roots = graph.identity_roots(typed)
    nodes = {r.id: (r.n, r.name) for r in graph.collapsed_nodes(graph.member_counts(sets, "ids"), roots).collect()}
    assert nodes == {"a": (2, "a・b"), "c": (1, "c")}
    assert [(r.a, r.b, r.w, r.type) for r in graph.collapsed_edges(typed, roots).collect()] == [("a", "c", 2, "unlabeled")]
    ring = graph.ring(typed, most=1)
    assert {(r.centre, r.other, r.x, r.y) for r in ring.collect()} == {("a", "b", 0.0, -320.0), ("b", "a", 0.0, -320.0), ("c", "a", 0.0, -320.0)}


def test_a_ring_orders_by_type_before_it_caps(spark):
    edges = [("a", f"u{i:02d}", 100 + i, "unlabeled") for i in range(15)] + [("a", "kin", 2, "kin"), ("a", "same", 1, "identity"), ("a", "part", 1, "partof"), ("a", "mix", 9, "mixed"), ("a", "oth", 9, "other")]
    typed = spark.createDataFrame(edges, "a string, b string, w long, type string")
    got = sorted((r.place, r.other, r.total) for r in graph.ring(typed).where("centre = 'a'").collect())
    assert [x[1] for x in got] == ["same", "kin", "part", "mix", "oth"] + [f"u{i:02d}" for i in range(14, 5, -1)]
    assert {x[2] for x in got} == {20}
    top = graph.ranked_neighbours(typed, 2).where("centre = 'a'").orderBy("rank").collect()
    assert [(r.other, r.rank) for r in top] == [("u14", 1), ("u13", 2)]


def test_components_of_text_nodes(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x"), ("e", "d")], "a string, b string")
    assert {r.node: r.root for r in graph.connected_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_floor_quantiles_and_ranks(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (4, 1, 3, 2)] + [("g", None), ("h", 7.0)], "k string, n double")
    got = {r.k: (r.p50, r.p95, r.min, r.max, r.n) for r in stats.quantiles(df, "k", "n", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"g": (3.0, 4.0, 1.0, 4.0, 4), "h": (7.0, 7.0, 7.0, 7.0, 1)}
    own = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 30.0), (4.0, 40.0)], "x double, y double")
    assert stats.spearman(own, "x", "y").first().rho == 0.9487
    assert stats.spearman(own.withColumn("x", F.lit(1.0)), "x", "y").first().rho == 0.0
    tied = spark.createDataFrame([(None, i, i % 3, i * 7 % 5) for i in range(40)] + [("h", i, 1, i) for i in range(40, 55)], "g string, id int, v int, w int").repartition(5)
    places = {(r.g, r.id): r.share for r in stats.rank_share(tied, "v", "id", ["g"]).collect()}
    for g, ids in ((None, range(40)), ("h", range(40, 55))):
        order = sorted(ids, key=lambda i: (i % 3 if g is None else 1, i))
        assert all(places[g, i] == n / (len(order) - 1) for n, i in enumerate(order))
    ranks = {(r.g, r.v): r.rank for r in stats.with_average_rank(tied, "v", "rank", ["g"]).collect()}
    assert ranks == {(None, 0): 7.5, (None, 1): 21.0, (None, 2): 34.0, ("h", 1): 8.0}


def test_nearest_segment_reaches_the_limit_from_small_cells(spark):
    r = random.Random(61)
    lines = [(f"r{i:02d}", 139 + i % 5 * 0.17, y + i // 5 * 0.13, 139 + i % 5 * 0.17 + 0.01, y + i // 5 * 0.13 + 0.01) for y in (35.0, 70.0) for i in range(20)]
    points = [(f"s{y}-{i}", 139 + r.random() * 0.8, y + r.random() * 0.5) for y in (35, 70) for i in range(60)]
    own = spark.createDataFrame(points, "site_id string, lon double, lat double")
    segments = spark.createDataFrame(lines, "name string, lon1 double, lat1 double, lon2 double, lat2 double")
    small, wide = ({x.site_id: (x.name, x.distance_m) for x in nearest.nearest_segment(own, segments, size=s).collect()} for s in (0.02, 1.0))
    assert small == wide and len(small) == 120
    assert sum(3000 < (d or 0) <= 10_000 for _, d in wide.values()) > 40


def test_permutation_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(12)], "x double, y double")
    df, noise = (x.withColumn("k", F.col("x").cast("int")) for x in (df, spark.createDataFrame([(float(i), float(i * 7 % 12)) for i in range(12)], "x double, y double")))
    first = stats.permutation_p(df, "k", "x", "y", 99, 3).first()
    assert (first.hits, first.p) == (0, 0.01)
    once, again = (stats.permutation_p(x, "k", "x", "y", 99, 3).first() for x in (noise, noise.repartition(3)))
    assert once == again
    # of all deals of numbers without a link, about as many are as extreme as this share of a thousand shuffles says
    a = np.arange(12) - 5.5
    drawn = np.abs(np.array([np.random.default_rng(i).permutation(a) @ a for i in range(2000)]))
    share = (drawn >= abs(np.argsort(np.argsort([i * 7 % 12 for i in range(12)])) @ a) - 1e-9).mean()
    assert abs(stats.permutation_p(noise, "k", "x", "y", 1000, 3).first().p - share) < 0.06


def test_shuffled_regions_keep_how_many_sites_a_region_has(spark):
    own = spark.createDataFrame([(i, i % 3) for i in range(20)], "site_id int, region int")
    got = stats.shuffled_regions(own, 4, 9)
    assert got.groupBy("draw", "region").count().select("region", "count").distinct().count() == 3
    assert got.count() == 80


def test_dealt_places_are_permutations():
    for n in (1, 2, 5, 20, 1000):
        drawn = [stats.dealt_places(np.arange(n), n, d, 3).tolist() for d in range(40)]
        assert all(sorted(x) == list(range(n)) for x in drawn)
        assert n < 5 or len(set(map(tuple, drawn))) > 20
    spots = np.bincount([stats.dealt_places(np.array([3]), 10, d, 3)[0] for d in range(4000)], minlength=10)
    assert spots.min() > 320 and spots.max() < 480


def test_null_hits_against_a_plain_count(spark):
    r = random.Random(16)
    rows = [(i, i % 4, q) for i in range(80) for q in {f"q{i % 4}" if r.random() < 0.7 else "q0", f"q{r.randrange(6)}"}]
    heads = [("q0", 0), ("q1", 1), ("q2", 2), ("q9", 3)]
    mentions = spark.createDataFrame(rows, "site_id int, region int, id string")
    table = spark.createDataFrame(heads, "id string, region int")
    drawn = {}
    for x in stats.shuffled_regions(mentions.select("site_id", "region").distinct(), 200, 7).collect():
        drawn.setdefault(x.draw, {})[x.site_id] = x.region

    def agreement(region):
        base, hits = {g: sum(x == g for x in region.values()) for g in range(4)}, 0
        for q, head in heads:
            mine = [region[s] for s, _, other in rows if other == q]
            lifts = [(-round(mine.count(g) / (len(mine) * base[g] / 80), 3), g) for g in range(4) if mine.count(g) >= 3]
            hits += bool(lifts) and min(lifts)[1] == head
        return hits

    observed, want = agreement({s: g for s, g, _ in rows}), [agreement(drawn[d]) for d in range(200)]
    hits = stats.null_hits(mentions, table, 200, 7)
    assert [x.hits for x in hits.orderBy("draw").collect()] == want
    seen = stats.head_agreement(stats.top_region(stats.lift(mentions)), table)
    got = stats.null_summary(hits, seen).first()
    want.sort()
    p = (sum(h >= observed for h in want) + 1) / 201
    assert tuple(got) == (200, observed, round(sum(want) / 200, 3), want[190], want[-1], round(p, 4), observed > want[190])


def test_top_similar_in_blocks(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5)], "k long, v array<float>")
    one, many = ({(x.k, x.other, x.rank) for x in vectors.top_similar(df, "k", "v", 7, block=b).collect()} for b in (1000, 9))
    assert one == many and len(one) == 61 * 7


def test_density_clusters(spark):
    rows = [(i, 0, 1.0) for i in range(1, 8)] + [(0, i, 1.0) for i in range(1, 8)] + [(i, j, 0.9) for i in range(1, 8) for j in range(1, 8) if i != j]
    similar = spark.createDataFrame(rows + [(20, 1, 0.95), (1, 20, 0.95), (30, 31, 0.99), (31, 30, 0.99)], "k long, other long, score double")
    points = spark.createDataFrame([(i,) for i in [*range(8), 20, 30, 31, 40]], "k long")
    got = {r.k: r.cluster for r in vectors.density_clusters(similar, points, "k", 0.5, 5, 6).collect()}
    assert got == {**dict.fromkeys(range(8), 0), 20: 0, 30: -1, 31: -1, 40: -1}


CASES = [
    ("稲荷八幡神社", ["稲荷神"], [], ("inari", "deity", 0.92, [])),
    ("x", ["天照大神", "応神天皇"], [], ("hachiman", "deity", 0.8, ["shinmei_ise"])),
    ("x", ["経津主神"], [], ("kashima_katori", "deity", 0.7, ["kasuga"])),
    ("x", ["経津主神", "天児屋根命"], [], ("kasuga", "deity", 0.92, [])),
    ("x", ["天照大御神"], [], ("shinmei_ise", "deity", 0.65, [])),
    ("第六天神社", [], [], ("unknown", "none", 0.0, [])),
    ("八幡稲荷神社", [], [], ("inari", "name", 0.65, ["hachiman"])),
    ("八幡宮", ["稲荷神"], ["山王総本宮", "八幡"], ("hie_sanno", "structured", 0.95, [])),
    (None, None, None, ("unknown", "none", 0.0, [])),
]


def test_classification(spark):
    rows = [(i, n, d, g) for i, (n, d, g, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, name string, members array<string>, groups array<string>")
    for own in (df, df.withColumn("members", F.reverse("members"))):
        got = [(r.label, r.basis, r.confidence, r.alternatives) for r in classify.classified(own).orderBy("i").collect()]
        assert got == [want for *_, want in CASES]
    signal = [r.signal for r in classify.two_signals(df).orderBy("i").collect()]
    assert signal[0] == "agree" and signal[7] == "disagree" and signal[8] is None


def test_reuse_plan(spark):
    own = spark.createDataFrame([("same", 139.0, 35.0), ("half", 139.0, 35 + 0.5 * METRE), ("far", 139.0, 35 + 111 * METRE), ("new", 139.0, 35.0), ("note", 139.0, 35.0)], "site_id string, lon double, lat double")
    old = spark.createDataFrame(
        [("same", 139.0, 35.0, 1.0, 2.0, "r", None), ("half", 139.0, 35.0, None, 2.0, "r", None), ("far", 139.0, 35.0, 1.0, 2.0, "r", None), ("note", 139.0, 35.0, 1.0, None, None, "none")],
        "site_id string, lon double, lat double, elevation_m double, river_distance_m double, river_name string, river_note string",
    )
    got = {r.site_id: (r.todo_elevation, r.todo_river, r.river_note) for r in state.reuse_plan(own, old).collect()}
    assert got == {"same": (False, False, None), "half": (True, False, None), "far": (True, True, None), "new": (True, True, None), "note": (False, False, "none")}


def test_corrections(spark):
    rows = [("f", 1, "a", None), ("f", 2, "b", None), ("f", 3, "correction", 1), ("f", 4, "correction", 1), ("f", 5, "correction", 3), ("f", 6, "correction", 9), ("g", 7, "correction", 1), ("f", 8, "correction", 8)]
    stay, wrong = eventlog.corrected(spark.createDataFrame(rows, "file string, line int, event string, target int"), "file", "line", "event", "target")
    assert [(r.file, r.line) for r in stay.collect()] == [("f", 2)]
    assert {(r.file, r.line): r.reason for r in wrong.collect()} == {("f", 4): "corrected before", ("f", 5): "corrects a correction", ("f", 6): "no earlier line", ("g", 7): "no earlier line", ("f", 8): "no earlier line"}


def test_record_validation(spark):
    ok = '{"v": "1", "ts": "t", "project": "p", "loop_id": "l", "event": "commit", "data": {"sha": "x", "kind": "feat"}}'
    lines = [ok, ok.replace('"feat"', '"odd"'), ok.replace('"sha": "x", ', ""), ok.replace('"x"', "5"), ok.replace("commit", "what"), "no json", ok.replace('"project": "p", ', "")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = [r.violations for r in eventlog.violations(eventlog.lines(df), ["F1"]).orderBy("i").collect()]
    assert got[0] == [] and got[1] == ["value of data.kind"] and got[2] == ["missing data.sha"] and got[3] == ["type of data.sha"]
    assert got[4] == ["unknown event what"] and len(got[5]) == 6 and got[6] == ["missing project"]


def test_hygiene(spark):
    df = spark.createDataFrame([(1, "plain\nпривет\n한글 hygiene-allow\n한\n\x01\ttab")], "k int, text string")
    got = [(r.line, r.cyrillic, r.hangul, r.control) for r in eventlog.hygiene(df, "k", "text").orderBy("line").collect()]
    assert got == [(2, True, False, False), (4, False, True, False), (5, False, False, True)]


def test_sections(spark):
    body = "lead text\n== History ==\nold\n=== Deep ===\ndeep\n== Empty ==\n\n== Access ==\nbus\n"
    df = spark.createDataFrame([(body,)], "t string").select(articles.sections(F.col("t")).alias("s"))
    own = [(x.title, x.body) for x in df.first().s]
    assert own == [("(導入)", "lead text"), ("History", "old"), ("Deep", "deep"), ("Access", "bus")]
    pick = lambda keep, drop: [x.title for x in df.select(articles.selected(F.col("s"), keep, drop).alias("u")).first().u]
    assert pick(["History"], ["Access"]) == ["(導入)", "History"]
    assert pick(["History"], ["Hist", "導入"]) == ["Deep", "Access"]


def test_medians_are_the_mean_of_the_middle_two(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (4, 1, 3, 2)] + [("h", 7.0), ("h", None), ("h", 1.0), ("h", 9.0), (None, 5.0)], "k string, v double").repartition(4)
    assert {r.k: (r.median, r.n) for r in stats.medians(df, ["k"], "v").collect()} == {"g": (2.5, 4), "h": (7.0, 3), None: (5.0, 1)}
    assert stats.medians(df, [], "v").first().median == 3.5


def test_names_that_are_missing_count_for_nothing(spark):
    from placelens.functions.text import best_similarity

    rows = [([None], [None]), ([""], [""]), ([None, "abc"], ["abd", None]), (["ａｂ"], ["ab"]), (["x", "same"], ["same"]), (None, ["x"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [round(r.s, 6) for r in df.select(best_similarity("a", "b").alias("s")).collect()] == [0.0, 0.0, round(2 / 3, 6), 1.0, 1.0, 0.0]


@pytest.mark.parametrize(
    "names, want",
    [({"a": "Hokkai", "b": "Other Hokkai Jingu Gate", "c": "Hokkai Jingu Gate"}, "a"), ({"a": "Hokkai Jingu Gate", "b": "Hokkai Jingu"}, "b"), ({"a": "", "b": "long unrelated name"}, "b"), ({"a": None, "b": ""}, "a"), ({"b": "xy", "a": "zz"}, "a"), ({"a": "Sapporo", "b": "x"}, "a")],
)
def test_representative(spark, names, want):
    df = spark.createDataFrame([("u", k, n, "Hokkai Jingu (Sapporo)") for k, n in names.items()], "article string, k string, name string, title string")
    for order in (df, df.orderBy(F.desc("k"))):
        assert articles.representative(order, "article", "k", "name", "title").first().representative == want


def test_classification_reads_normalised_names(spark):
    df = spark.createDataFrame([(1, "x", ["ｽｻﾉｵ"], None), (2, "x", None, ["\u3000山\u3000王", "八幡  宮"]), (3, "ﾊﾁ 八幡", [None], [])], "i int, name string, members array<string>, groups array<string>")
    got = [(r.label, r.basis) for r in classify.classified(df).orderBy("i").collect()]
    assert got == [("gion_yasaka", "deity"), ("hachiman", "structured"), ("hachiman", "name")]


def test_lines_that_block_or_warn(spark):
    text = "-----BEGIN OPENSSH PRIVATE KEY-----\nAKIA" + "A1" * 8 + "\npassword = 'longer than 8'\ntoken: 'short'\nmytoken = 'not a word of its own'\nx = eval(y)\ncur.execute(\"a %s\" % b)\nfine"
    got = [(r.line, r.level, r.finding) for r in eventlog.secret_lines(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").orderBy("line").collect()]
    assert got == [(1, "block", "private key"), (2, "block", "access key"), (3, "block", "written credential"), (6, "warn", "evaluates text"), (7, "warn", "joins text into a statement")]


def test_stray_carriage_returns(spark):
    df = spark.createDataFrame([(1, "a\r\nb"), (2, "a\rb hygiene-allow"), (3, "a\nb\r"), (4, "a\r\n")], "k int, text string")
    assert {(r.k, r.line) for r in eventlog.hygiene(df, "k", "text").where("stray_cr").collect()} == {(2, 1), (3, 2)}


def test_file_violations(spark):
    schema = "file string, line long, event string, ts string, loop_id string, project string, failure_count long, target long, v string"

    def lines(file, *events, loop=None, project="p", **declared):
        return [(file, i + 1, e, f"t{i:02d}", loop or file, project if isinstance(project, str) else project[i], declared.get("n") if e == "loop_end" else None, None) for i, e in enumerate(events)]

    own = lines("good", "loop_start", "failure", "loop_end", n=1) + lines("name", "loop_start", loop="else") + lines("two", "loop_start", "commit", project=["p", "q"]) + lines("first", "commit")
    own += lines("ends", "loop_start", "loop_end", "loop_end") + lines("count", "loop_start", "loop_end", n=2) + lines("after", "loop_start", "loop_end", "commit")
    own += [("time", 1, "loop_start", "t9", "time", "p", None, None), ("time", 2, "commit", "t1", "time", "p", None, None)]
    own += [("slot", 1, "loop_start", "t1", "slot", "p", None, None), ("slot", 2, "commit", "t2", "slot", "p", None, None), ("slot", 3, "loop_end", "t3", "slot", "p", 0, None), ("slot", 4, "correction", "t4", "slot", "p", None, 2), ("slot", 5, "commit", "t5", "slot", "p", None, None)]
    own += [("gone", 1, "loop_start", "t1", "gone", "p", None, None), ("gone", 2, "correction", "t2", "gone", "p", None, 1)]
    own += lines("self", "loop_start", "commit", project="self") + lines("selves", "loop_start", "commit", project=["selves", "p"])
    version = {"self": "1.10", "selves": "1.1"}
    events = spark.createDataFrame([(*r, version.get(r[0], "1.2")) for r in own], schema)
    stay, _ = eventlog.corrected(events, "file", "line", "event", "target")
    assert {tuple(r) for r in eventlog.file_warnings(stay).collect()} == {("selves", "project is the loop id", 1), ("selves", "several projects", 2)}
    got = {(r.file, r.violation) for r in eventlog.file_violations(events, stay).collect()}
    assert got == {
        ("name", "loop id differs from the file name"), ("two", "several projects"), ("first", "does not begin with loop_start"), ("ends", "several ends"), ("ends", "records after the end"),
        ("count", "declares another number of failures"), ("after", "records after the end"), ("time", "not in order of time"), ("gone", "no record is left"),
        ("self", "project is the loop id"),
    }


@pytest.mark.parametrize("v, strict", [("1.2", True), ("1.10", True), ("2", True), ("1.1", False), ("1", False), ("1.2b", False), (None, False), ("", False)])
def test_versions_are_compared_by_number(spark, v, strict):
    assert spark.createDataFrame([(v,)], "v string").select(eventlog._strict(F.col("v"))).first()[0] is strict


def plain_admitted(log, batch):
    """Each record held against the whole list of its file, made anew for each."""
    files, out = {}, []
    for file, _, event, target, project in sorted(log, key=lambda r: r[:2]):
        files.setdefault(file, []).append((event, target, project))
    for file, seq, event, target, project in sorted(batch, key=lambda r: r[:2]):
        own = files.setdefault(file, [])
        void, tally = set(), {}
        for i, (e, t, _) in enumerate(own, 1):
            if e == "correction" and t is not None and 1 <= t <= len(own):
                tally[own[t - 1][0]] = tally.get(own[t - 1][0], 0) + 1
                if t < i and own[t - 1][0] != "correction":
                    void.add(t)
        stay = [i for i, (e, _, _) in enumerate(own, 1) if e != "correction" and i not in void]
        ends = [i for i, (e, _, _) in enumerate(own, 1) if e == "loop_end"]
        reason = None
        if event == "correction":
            if target not in stay:
                reason = "no record to correct"
            elif own[target - 1][0] == "loop_start" and len(stay) > 1:
                reason = "voids the start of other records"
        elif stay and own[stay[0] - 1][2] is not None and own[stay[0] - 1][2] != project:
            reason = "another project"
        elif any(own[i - 1][0] == "loop_end" for i in stay) and sum(e == event for e, _, _ in own[max(ends) :]) >= tally.get(event, 0):
            reason = "after the end"
        if reason is None:
            own.append((event, target, project))
        out.append((file, seq, event, None if reason else len(own), reason))
    return set(out)


def test_admitted_against_a_plain_guard(spark):
    r = random.Random(7)
    kinds = ["loop_start", "commit", "failure", "loop_end", "correction", "correction"]
    log, batch = [], []
    for f in range(60):
        n, project = r.randrange(7), r.choice(["p", None, "p"])
        for i in range(1, n + 1):
            event = r.choice(kinds) if i > 1 else "loop_start"
            log.append((f"f{f}", i, event, r.randrange(0, 7) if event == "correction" else None, project if r.random() < 0.9 else "q"))
        for i in range(1, r.randrange(2, 16)):
            event = r.choice(kinds)
            batch.append((f"f{f}", i, event, r.randrange(0, n + 6) if event == "correction" else None, r.choice(["p", "p", "p", "q", None])))
    written = spark.createDataFrame([(*x, "more") for x in log], "file string, line long, event string, target long, project string, seq string")
    new = spark.createDataFrame(batch, "file string, seq int, event string, target long, project string")
    got = eventlog.admitted(written, new)
    assert {tuple(x) for x in got.collect()} == plain_admitted(log, batch)
    assert got.where("reason is null").count() > 60 and got.select("reason").distinct().count() == 5


def test_admitted_without_rows_or_names(spark):
    written = spark.createDataFrame([], "file string, line long, event string, target long, project string")
    new = spark.createDataFrame([(None, 1, "commit", None, "p"), ("f", 2, None, None, "p"), ("f", 3, "commit", None, None), ("f", 3, "commit", None, None)], "file string, seq int, event string, target long, project string")
    assert sorted(map(str, eventlog.admitted(written, new).collect())) == sorted(map(str, [
        Row(file=None, seq=1, event="commit", line=None, reason="no file or event"), Row(file="f", seq=2, event=None, line=None, reason="no file or event"),
        Row(file="f", seq=3, event="commit", line=1, reason=None), Row(file="f", seq=3, event="commit", line=2, reason=None),
    ]))
    assert eventlog.admitted(written, new.limit(0)).count() == 0


def test_admitted_record_that_replaces_a_voided_one(spark):
    log = [("f", 1, "loop_start", None, "p"), ("f", 2, "failure", None, "p"), ("f", 3, "loop_end", None, "p")]
    batch = [("f", 4, "failure", None, "p"), ("f", 5, "correction", 1, "p"), ("f", 6, "correction", 2, "p"), ("f", 7, "failure", None, "p"), ("f", 8, "failure", None, "p"), ("f", 9, "correction", 5, "q"), ("f", 10, "failure", None, "p")]
    got = eventlog.admitted(spark.createDataFrame(log, "file string, line long, event string, target long, project string"), spark.createDataFrame(batch, "file string, seq int, event string, target long, project string"))
    assert [(r.seq, r.line, r.reason) for r in got.orderBy("seq").collect()] == [
        (4, None, "after the end"), (5, None, "voids the start of other records"), (6, 4, None), (7, 5, None), (8, None, "after the end"), (9, 6, None), (10, 7, None),
    ]


def test_ids_and_leaks(spark):
    ids = spark.createDataFrame([("jinja_n12",), ("jinja_x1",), ("jinja_w",), ("jinja_r1\n",), (None,)], "i string")
    assert [r.ok for r in ids.select(records.valid_id(F.col("i")).alias("ok")).collect()] == [True, False, False, False, False]
    rows = [(1, "x" * 299, {"body": "y" * 119, "vec": None, "scores": [0.1] * 31}, [{"t": "z" * 300}]), (2, "x" * 300, {"body": "y" * 120, "vec": [1.0], "scores": [0.1] * 32}, []), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k int, note string, meta struct<body:string,vec:array<double>,scores:array<double>>, list array<struct<t:string>>")
    got = {(r.k, r.path, r.kind) for r in records.leaks(df, "k").collect()}
    assert got == {(1, "list[].t", "text"), (2, "note", "text"), (2, "meta.body", "text"), (2, "meta.vec", "vector"), (2, "meta.scores", "vector")}


def test_planes_of_prefectures(spark):
    from placelens.functions import geo

    planes = list(geo.PREFECTURES.values())
    assert sorted(map(planes.count, set(planes))) == [1, 1, 2, 2, 3, 4, 4, 4, 6, 6, 7, 7] and set(planes) == set(geo.PLANE_ORIGINS) == set(geo.PLANE_UTM)
    for plane, (_, lon0) in geo.PLANE_ORIGINS.items():
        assert (geo.PLANE_UTM[plane] - 6637) * 6 - 186 <= lon0 <= (geo.PLANE_UTM[plane] - 6637) * 6 - 180
    df = spark.createDataFrame([(" 東京都 ",), ("nowhere",), (None,)], "p string")
    assert [r.e for r in df.select(geo.prefecture_plane(F.col("p")).alias("e")).collect()] == [6677, None, None]


def test_both_planes_find_the_same_segments(spark):
    r = random.Random(62)
    own = spark.createDataFrame([(f"s{i}", 139 + r.random() * 0.2, 35 + r.random() * 0.2) for i in range(40)], "site_id string, lon double, lat double")
    lines = [(f"r{i}", x, y, x + 0.01, y + 0.01) for i, (x, y) in enumerate((139 + r.random() * 0.2, 35 + r.random() * 0.2) for _ in range(30))]
    segments = spark.createDataFrame(lines, "name string, lon1 double, lat1 double, lon2 double, lat2 double")
    plane, utm = (nearest.nearest_segment(own.withColumn("epsg", F.lit(e)), segments) for e in (6677, 6691))
    got = nearest.agreement_of_paths(plane, utm).collect()
    assert len(got) == 40 and all(x.agrees for x in got)


def test_append_new_takes_up_where_it_stopped(spark, tmp_path):
    path, rows_of = f"file://{tmp_path}/cache", lambda keys: spark.createDataFrame([(k, [1.0]) for k in keys], "key string, v array<double>")
    assert [state.append_new(rows_of(x), path) for x in ("aab", "abc", "c")] == [2, 1, 0]
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_stored_articles_under_another_title_are_stale(spark):
    own = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "U"), ("d", None), ("e", "V")], "site_id string, title string")
    stored = spark.createDataFrame([("a", "T", 1, "old"), ("c", "W", 2, "stale")], "site_id string, requested_title string, revision int, text string")
    fetched = spark.createDataFrame([("T", 5, "new"), ("U", 6, "u"), ("V", None, None)], "title string, revision int, text string")
    assert {(r.title, r.n_sites) for r in state.articles_to_fetch(own, stored).collect()} == {("T", 1), ("U", 1), ("V", 1)}
    assert {(r.site_id, r.revision, r.how) for r in state.articles_of(own, stored, fetched).collect()} == {("a", 1, "cached"), ("b", 5, "fetched"), ("c", 6, "fetched")}


def test_hubs_of_ego_graphs_are_cut_before_they_are_sorted(spark, capsys):
    rows = [(f"a{i:05d}", "hub", i % 97 + 1, "unlabeled") for i in range(20_000)] + [(f"a{i:05d}", f"a{i + 1:05d}", 1, "kin") for i in range(0, 20_000, 2)]
    edges = spark.createDataFrame(rows, "a string, b string, w long, type string").repartition(4)
    ring = graph.ring(edges)
    ring.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    hub = sorted((r for r in ring.where("centre = 'hub'").collect()), key=lambda r: r.place)
    assert [r.other for r in hub] == [f"a{i:05d}" for i in range(96, 20_000, 97)][:14] and {r.total for r in hub} == {20_000}
    # every other ring is the hub and one more: the hub's edges are not repeated for them
    induced = graph.induced_edges(ring, edges)
    assert induced.where("centre <> 'hub' and w = 1 and type = 'kin'").count() == 20_000
    assert induced.where("centre = 'hub'").count() == 14


def test_principal_components_against_numpy(spark):
    """Up to the sign of each component, the eigenvectors of the largest eigenvalues of the covariance."""
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 6)) * [9, 5, 3, 1, 0.5, 0.1] + r.normal(size=6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    got = np.array([row.components for row in vectors.principal_components(df, "id", "v", 3).orderBy("id").collect()])
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = x @ axes[:, np.argsort(-values)[:3]]
    assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-6)


def test_same_corpus_takes_new_changed_shortened_and_null_groups(spark):
    make = lambda rows: state.fingerprint(spark.createDataFrame(rows, "g string, k long, t string"), "g", "k", "t", "m")
    before = [("same", 1, "a"), ("same", 5000, "b"), ("changed", 1, "a"), ("shorter", 1, "a"), ("shorter", 2, "b"), ("gone", 1, "a"), (None, 1, "a")]
    after = [("same", 5000, "b"), ("same", 1, "a"), ("changed", 1, "A"), ("shorter", 1, "a"), ("new", 1, "a"), (None, 1, "a")]
    got = {r.g: r.reuse for r in state.same_corpus(make(before), make(after), "g").collect()}
    assert got == {"same": True, "changed": False, "shorter": False, "new": False, None: True}


def test_draws_are_never_broadcast(spark):
    placed = spark.range(40).selectExpr("id AS site_id", "CAST(id % 3 AS INT) AS region", "id AS place", "40L AS sites")
    drawn = stats._dealt(placed.select("site_id", "place", "sites"), placed, 50, 7)
    assert "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()
    counts = {(r.draw, r.region): r["count"] for r in drawn.groupBy("draw", "region").count().collect()}
    assert counts == {(d, r): 14 if r == 0 else 13 for d in range(50) for r in range(3)}


def test_append_guards_read_log_and_batch_once(spark):
    log = spark.createDataFrame([("f", i, "a", None, "p") for i in range(1, 6)], "file string, line long, event string, target long, project string")
    batch = spark.createDataFrame([("f", i, "a", None, "p") for i in range(3)], "file string, seq long, event string, target long, project string")
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(df, total):
        def run(batches):
            for x in batches:
                total.add(x.num_rows)
                yield x

        return df.mapInArrow(run, df.schema)

    out = eventlog.admitted(counted(log, seen[0]), counted(batch, seen[1]))
    assert sorted(r.line for r in out.collect()) == [6, 7, 8] and [x.value for x in seen] == [5, 3]
