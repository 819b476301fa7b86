"""Matching without all pairs: the same rows as from all of them, and no join that grows in the driver."""

import random

import pytest
from pyspark.sql import functions as F

from placelens.operators import matching


def crowd(spark, n, m, seed, width=0.04):
    r = random.Random(seed)
    place = lambda: (139 + r.random() * width, 35 + r.random() * width)
    names, empty = ["abc", "abd", "xyz", "", None], F.array().cast("array<string>")
    own = spark.createDataFrame([(i, *place(), r.choice(names), f"n{r.randrange(3)}") for i in range(n)], "site_id long, lon double, lat double, name string, prefecture string")
    own = own.withColumns({"names": F.array("name"), "aliases": empty, "municipality": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    other = spark.createDataFrame([(f"Q{i}", *place(), r.choice(names), f"n{r.randrange(3)}") for i in range(m)], "qid string, item_lon double, item_lat double, label string, admin string")
    return own, other.withColumns({"item_names": F.array("label"), "item_aliases": empty, "item_url": F.lit(None).cast("string")})


@pytest.mark.parametrize("kinds", [matching.KINDS, 2])
@pytest.mark.parametrize("n, m, width", [(60, 400, 0.04), (60, 6, 0.04), (30, 0, 0.04), (40, 60, 0.001)])
def test_leading_candidates_hold_the_best_of_all_pairs(spark, monkeypatch, n, m, width, kinds):
    monkeypatch.setattr(matching, "KINDS", kinds)
    own, items = crowd(spark, n, m, 3, width)
    rows = lambda df: {r.site_id: (r.qid, r.score, r.distance_m, r.name_sim, r.decision) for r in df.collect()}
    every = matching.scored_candidates(own, items).withColumn("score", F.round("score", 9))
    assert rows(matching.best_match(own, matching.leading_candidates(own, items))) == rows(matching.best_match(own, every))


def test_pairs_within_a_distance_are_those_of_touching_cells(spark):
    own, items = crowd(spark, 80, 80, 4)
    d = matching.haversine_m(F.col("lon"), F.col("lat"), F.col("item_lon"), F.col("item_lat"))
    near = lambda df: sorted((r.site_id, r.qid) for r in df.where(d <= 400).collect())
    few = matching.grid_candidates(own, items, within=400.0)
    assert near(few) == near(matching.grid_candidates(own, items))
    assert few.count() < matching.grid_candidates(own, items).count() / 3


def test_a_crowded_cell_is_dealt_to_several_tasks(spark, monkeypatch):
    """Pairs of one cell are not left to one task, without a broadcast, and are all there."""
    monkeypatch.setattr(matching, "PAIRS", 2000, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own, items = crowd(spark, 400, 60, 8, 0.009)
        more = own.withColumns({"site_id": F.col("site_id") + 1000, "lon": F.col("lon") + 0.03})  # beside them a cell that meets nothing
        pairs = matching.grid_candidates(own.union(more), items).withColumn("task", F.spark_partition_id()).collect()
        assert len({(x.site_id, x.qid) for x in pairs}) == len(pairs) == 400 * 60
        tasks = [sum(x.task == t for x in pairs) for t in {x.task for x in pairs}]
        assert max(tasks) <= 6000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name, most", [("j2_g1_g2_candidates", 3.3), ("g3_g6_match_score", 2.8)])
def test_all_pairs_of_a_grid_are_small_on_disk(spark, monkeypatch, tmp_path, name, most):
    """All pairs of places with four decimals are listed, in an order in which the same distances soon come again."""
    from placelens.plans import base, places

    sites, items, folder, out = 2000, 3000, str(tmp_path / "in"), tmp_path / "out"
    spot = lambda k: F.pmod(k * 7919, F.lit(5407))
    monkeypatch.setattr(base, "_point", lambda k: (139 + spot(k) % 90 / 10000, 35 + F.floor(spot(k) / 90) / 10000))
    spark.range(sites).selectExpr("id as c_custkey", "element_at(array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), int(xxhash64(id) % 5 + 5) % 5 + 1) as c_mktsegment", "int(id * 31 % 25) as c_nationkey").write.parquet(f"{folder}/customer.parquet")
    spark.range(items).selectExpr("id as s_suppkey", "int(id * 7 % 25) as s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    getattr(places, name)(spark, folder).write.parquet(str(out))
    rows = spark.read.parquet(str(out))
    assert rows.count() == rows.select("site_id", "qid").distinct().count() == sites * items
    assert sum(x.stat().st_size for x in out.glob("*.parquet")) < most * sites * items


def test_blocks_hold_each_row_once_and_are_bounded(spark):
    own, _ = crowd(spark, 500, 0, 10, 0.001)
    own = own.withColumns({"cy": F.col("site_id") % 2, "cx": F.when(F.col("site_id") < 400, 1)})
    blocks = matching._blocks(own, ["cy", "cx"], ["lat", "lon", "site_id"], 30, "_s").collect()
    assert sorted(x.site_id for b in blocks for x in b["_s"]) == list(range(400))  # rows without a cell meet nothing
    assert max(len(b["_s"]) for b in blocks) == 30 and len(blocks) == 2 * 7
    assert all(max(x.lat for x in a["_s"]) <= min(x.lat for x in b["_s"]) for a in blocks for b in blocks if a.cy == b.cy and a["_s_block"] < b["_s_block"])


def test_pairs_keep_all_columns_unless_told(spark):
    own, items = crowd(spark, 30, 10, 11)
    every, few = matching.scored_candidates(own, items), matching.scored_candidates(own, items, keep=("name",))
    assert {*own.columns, *items.columns, "distance_m", "name_sim", "score"} <= set(every.columns)
    assert "name" in few.columns and "label" not in few.columns
    rows = lambda df: sorted((x.site_id, x.qid, x.name or "", x.name_sim, x.score) for x in df.collect())
    assert rows(few) == rows(every) and rows(few)


def test_rounding_is_that_of_sql(spark):
    from placelens.functions.geo import rounded

    r = random.Random(12)
    values = [0.0, 0.5, 1.0, 2999.9994999] + [r.random() * 10 ** r.randrange(-3, 5) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", rounded(F.col("x"), 3).alias("a"), F.round("x", 3).alias("b")).collect()
    assert [x.a for x in got] == [x.b for x in got]


@pytest.mark.parametrize("kinds", [matching.KINDS, 2])
@pytest.mark.parametrize("n, m, width", [(200, 40, 0.006), (30, 60, 0.002), (20, 0, 0.006)])
def test_assignment_by_steps_is_that_of_all_pairs(spark, monkeypatch, n, m, width, kinds):
    from placelens.functions.text import entity_number

    monkeypatch.setattr(matching, "KINDS", kinds)
    monkeypatch.setattr(matching, "LOOKED", 0)  # as many steps as there are
    monkeypatch.setattr(matching, "LOOKED_LEAST", 0)
    own, items = crowd(spark, n, m, 9, width)
    rows = lambda df: {r.site_id: (r.qid, r.score, r.distance_m, r.name_sim, r.decision) for r in df.collect()}
    every = matching.scored_candidates(own, items, floor=matching.REVIEW).withColumns({"score": F.round("score", 9), "distance_m": F.round("distance_m", 6)})
    got = rows(matching.assigned(own, items, entity_number(F.col("qid"))))
    assert got == rows(matching.resolve_one_to_one(own, every, entity_number(F.col("qid"))))
    assert m == 0 or len({x[1] for x in got.values() if x[0]}) > 3


def test_a_crowded_map_is_assigned_from_few_pairs(spark, monkeypatch, tmp_path):
    """Pairs that j4_one_to_one makes grow with the rows, not with their square."""
    from placelens.plans import base, places

    monkeypatch.setattr(matching, "LOOKED_LEAST", 0, raising=False)
    made, plain = [], matching.grid_candidates
    monkeypatch.setattr(matching, "grid_candidates", lambda *a, **k: made.append(plain(*a, **k).count()) or plain(*a, **k))
    monkeypatch.setattr(base, "_point", lambda k: (139 + F.pmod(k * 7919, F.lit(31)) / 10000, 35 + F.pmod(k * 104729, F.lit(37)) / 10000))
    counts = []
    for i, n in enumerate((500, 2000)):
        folder = str(tmp_path / str(i))
        spark.range(n).selectExpr("id as c_custkey", "element_at(array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), int(xxhash64(id) % 5 + 5) % 5 + 1) as c_mktsegment", "int(id * 31 % 25) as c_nationkey").write.parquet(f"{folder}/customer.parquet")
        spark.range(n // 10).selectExpr("id as s_suppkey", "int(id * 7 % 25) as s_nationkey").write.parquet(f"{folder}/supplier.parquet")
        made.clear()
        assert places.j4_one_to_one(spark, folder).count() == n
        counts.append(sum(made))
    assert counts[1] <= 6 * counts[0] and counts[1] <= 20 * 2200


def test_guards_are_those_of_joined_pairs(spark):
    own, items = crowd(spark, 300, 60, 5, 0.006)
    matches = matching.best_match(own, matching.leading_candidates(own, items))
    rows = lambda df: sorted((r.a, r.b, r.blocked) for r in df.collect())
    want = rows(matching.guarded(matching.same_name_pairs(own, F.col("name")), matches))
    assert {x[2] for x in want} == {True, False}
    assert rows(matching.guarded_pairs(own, F.col("name"), matches)) == want
    assert rows(matching.unblocked_pairs(own, F.col("name"), matches)) == [x for x in want if not x[2]]


def test_repeated_sites_are_never_broadcast(spark):
    own, _ = crowd(spark, 50, 1, 6)
    plan = matching.same_name_pairs(own, F.col("name"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_crowded_segments_are_looked_for_in_smaller_cells(spark, monkeypatch):
    from placelens.operators import nearest

    r = random.Random(7)
    own = spark.createDataFrame([(i, 139 + r.random() * 0.02, 35 + r.random() * 0.02) for i in range(60)], "site_id long, lon double, lat double")
    lines = [(f"r{i:03d}", 139 + r.random() * 0.02, 35 + r.random() * 0.02) for i in range(600)]
    segments = spark.createDataFrame([(n, x, y, x + 0.001, y - 0.0005) for n, x, y in lines + [("r900", *lines[0][1:])]], "name string, lon1 double, lat1 double, lon2 double, lat2 double")
    steps, met = [], nearest._in_cells
    monkeypatch.setattr(nearest, "_in_cells", lambda left, flat, size: steps.append(size) or met(left, flat, size))
    rows = lambda: sorted((x.site_id, x.name, x.distance_m, x.note or "") for x in nearest.nearest_segment(own, segments, size=0.02).collect())
    got, first = rows(), min(steps)
    assert met(own.withColumns({"epsg": F.lit(1), "p": F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))}), segments.withColumns({"epsg": F.lit(1), "s": F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), "e": F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))}), first).count() < 60 * 601 / 20
    monkeypatch.setattr(nearest, "FINER", 0)
    assert got == rows()
