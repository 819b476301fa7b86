"""Rules of fetching, and the source over them; numbered lines of split files; points of raster tiles."""

import json

import pytest

from placelens.sources import archives, fetch, scans
from placelens.sources.fetch import DATA_RULES, MAP_RULES, Response
from tests.test_sources import png

WHOLE = b'{"results": {"bindings": [{"x": {"value": "1"}}]}}'
ELEMENTS = b'{"elements": [{"type": "node", "id": 1}]}'


def run(answers, rules):
    """Result or error, waits, and queries sent."""
    waits, sent, rest = [], [], list(answers)

    def send(query):
        sent.append(query)
        x = rest.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    try:
        return fetch.fetch("q", "text", send, rules, waits.append), waits, sent
    except Exception as e:
        return e, waits, sent


def test_busy_services_are_asked_again_after_doubling_waits():
    got, waits, sent = run([Response(429, b""), Response(503, b""), Response(200, ELEMENTS)], MAP_RULES)
    assert got == (ELEMENTS, 3) and waits == [20, 40] and sent == ["text"] * 3
    got, waits, _ = run([Response(504, b"")] * 6, MAP_RULES)
    assert isinstance(got, RuntimeError) and "6 attempts" in str(got) and waits == [20, 40, 80, 160, 300]
    got, waits, _ = run([Response(500, b"")] * 4, DATA_RULES)
    assert isinstance(got, RuntimeError) and waits == [15, 30, 60]


def test_refusals_and_lost_connections():
    got, waits, _ = run([Response(400, b""), ConnectionError("reset"), Response(200, ELEMENTS)], MAP_RULES)
    assert got == (ELEMENTS, 3) and waits == [20, 40]
    got, waits, _ = run([Response(400, b"")], DATA_RULES)
    assert isinstance(got, RuntimeError) and "status 400" in str(got) and waits == []
    got, waits, _ = run([ConnectionError("reset")], DATA_RULES)
    assert isinstance(got, ConnectionError) and waits == []


def test_broken_bodies_are_asked_for_with_another_text():
    cut, other = Response(200, WHOLE[:20]), Response(200, WHOLE[:25])
    got, waits, sent = run([cut, other, Response(200, WHOLE)], DATA_RULES)
    assert got == (WHOLE, 3) and waits == [15, 30] and len(set(sent)) == 3 and all(x.startswith("text") for x in sent)
    got, waits, _ = run([cut, cut], DATA_RULES)
    assert isinstance(got, fetch.TooHeavy) and waits == [15]
    # answers of a cache prove nothing and wait less
    cached = Response(200, WHOLE[:20], cached=True)
    got, waits, _ = run([cached, cached, cut, Response(200, WHOLE)], DATA_RULES)
    assert got == (WHOLE, 4) and waits == [5, 5, 15]
    got, _, _ = run([Response(200, b"<html>")], MAP_RULES)
    assert isinstance(got, fetch.Truncated)


def test_no_element_is_an_error_and_no_binding_is_none():
    got, waits, _ = run([Response(200, b'{"elements": []}')], MAP_RULES)
    assert isinstance(got, ValueError) and "zero elements" in str(got) and waits == []
    empty = b'{"results": {"bindings": []}}'
    assert run([Response(200, empty)], DATA_RULES)[0] == (empty, 1)


def test_source_has_a_partition_for_each_request(spark):
    bodies = fetch.fetched(spark, [("13", "area 3"), ("26", "area 2")], "tests.fake_service:send", "elements")
    assert bodies.rdd.getNumPartitions() == 2
    assert {(r["name"], r["attempts"]) for r in bodies.collect()} == {("13", 1), ("26", 1)}
    got = [(r.area, r.place, r.id, r.lat, r.tags["name"]) for r in fetch.fetched_elements(bodies).orderBy("area", "place").collect()]
    assert got == [("13", i, i, 35.0 + i, f"n{i}") for i in range(3)] + [("26", i, i, 35.0 + i, f"n{i}") for i in range(2)]
    parts = fetch.fetched(spark, [("core", "select")], "tests.fake_service:send", "bindings", pace=0)
    assert parts.first().attempts == 2
    assert [(r.row, r["values"]) for r in fetch.fetched_bindings(parts).orderBy("row").collect()] == [(0, {"item": "Q1", "ja": "a"}), (1, {"item": "Q2"})]
    with pytest.raises(Exception, match="6 attempts"):
        fetch.fetched(spark, [("01", "busy")], "tests.fake_service:send", "elements", pace=0).collect()
    with pytest.raises(Exception, match="zero elements"):
        fetch.fetched(spark, [("01", "area 0")], "tests.fake_service:send", "elements").collect()


def test_lines_of_split_files_are_numbered_as_in_the_file(spark, tmp_path):
    files = {"a.jsonl": [json.dumps({"n": i, "x": "ü\u0085" * (i % 50)}, ensure_ascii=False) if i % 11 else ["", "  ", "{bad"][i % 3] for i in range(3000)], "b.jsonl": ["only"], "c.jsonl": []}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in scans.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(name, i): x for name, lines in files.items() for i, x in enumerate(lines, 1) if x.strip()}


def test_tiles_give_the_pixels_of_their_points_only(spark, monkeypatch):
    monkeypatch.setattr(archives, "TILE_POINTS", 3)  # the first tile is read in several tasks
    tiles = spark.createDataFrame([("fine", 1, 1, png([[(128, 0, 0), (0, 1, 0)]])), ("coarse", 1, 1, png([[(1, 0, 0), (1, 0, 0)]])), ("fine", 2, 2, None), ("fine", 9, 9, b"never read")], "layer string, x int, y int, content binary")
    rows = [(f"s{i}", layer, 1, 1, i % 2, 0) for i in range(20) for layer in ("fine", "coarse")] + [("c", "fine", 2, 2, 0, 0), ("d", "coarse", 3, 3, 0, 0)]
    points = spark.createDataFrame(rows, "site_id string, layer string, x int, y int, px int, py int")
    assert archives.point_elevations(points, tiles).count() == len(rows)
    got = {r.site_id: (r.elevation_m, r.layer) for r in archives.first_layer_with_value(points, tiles, ["fine", "coarse"]).collect()}
    assert got == {f"s{i}": (2.56, "fine") if i % 2 else (655.36, "coarse") for i in range(20)} | {"c": (None, None), "d": (None, None)}
    old = {r.site_id: (r.elevation_m, r.layer) for r in archives.first_layer(points, archives.tile_elevations(tiles.where("x < 9")), ["fine", "coarse"]).collect()}
    assert got == old
