"""Sources, sinks and the stream."""

import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.sources import archives, scans, sinks
from placelens.streaming import snapshots


def test_elements_carry_the_area_of_their_file(spark, tmp_path):
    for code, ids in (("13", [1, 2]), ("26", [3])):
        rows = [{"type": "node", "id": i, "lat": 35.0, "lon": 139.0, "tags": {"name": f"n{i}"}} for i in ids] + [{"type": "way", "id": 10 * ids[0], "center": {"lat": 36.0, "lon": 140.0}}]
        (tmp_path / f"{code}.json").write_text(json.dumps({"elements": rows}))
    got = {(r.area, r.id): r.lat for r in scans.elements(spark, f"{tmp_path}/*.json").collect()}
    assert got == {("13", 1): 35.0, ("13", 2): 35.0, ("13", 10): 36.0, ("26", 3): 35.0, ("26", 30): 36.0}
    (tmp_path / "japan.json").write_text(json.dumps({"elements": []}))
    with pytest.raises(ValueError, match="mixed"):
        scans.elements(spark, f"{tmp_path}/*.json")


def test_lines_end_at_the_line_feed_only(spark, tmp_path):
    value = "a b\u0085c"
    (tmp_path / "x.jsonl").write_text(json.dumps({"v": value}, ensure_ascii=False) + "\n" + '{"v": "z"}\n', encoding="utf-8")
    assert [r.v for r in scans.json_lines(spark, f"{tmp_path}/x.jsonl", T.StructType.fromDDL("v string")).collect()] == [value, "z"]
    (tmp_path / "log").write_text("one\n\n three\n")
    assert [(r.line, r.value) for r in scans.numbered_lines(spark, f"{tmp_path}/log").collect()] == [(1, "one"), (3, " three")]


def test_optional_and_requests(spark, tmp_path):
    schema = T.StructType.fromDDL("k int")
    assert scans.optional(spark, f"file://{tmp_path}/none", schema).count() == 0
    keys = spark.createDataFrame([(i % 7,) for i in range(40)], "k int")
    lists = [r["keys"] for r in scans.distinct_requests(keys, "k", 3).collect()]
    assert sorted(x for y in lists for x in y) == list(range(7)) and max(map(len, lists)) <= 3
    bodies = spark.createDataFrame([('{"results": {"bindings": []}}',), ("{",), ('{"error": 1}',)], "body string")
    assert [r.valid for r in scans.valid_responses(bodies).collect()] == [True, False, False]
    page = spark.createDataFrame([("<a f-v1_13.zip> <a f-v2_13.zip> <a f-v1_26.zip>",)], "html string")
    assert {r.code: r.file for r in scans.newest_links(page, "html", r"(f-(v\d)_(\d\d)\.zip)").collect()} == {"13": "f-v2_13.zip", "26": "f-v1_26.zip"}


def shape(lines):
    out = b"\0" * 100
    for i, points in enumerate(lines):
        if points is None:
            body = struct.pack("<i", 0)
        else:
            body = struct.pack("<i4d2i", 3, 0, 0, 0, 0, 1, len(points)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
        out += struct.pack(">2i", i + 1, len(body) // 2) + body
    return out


def dbase(names):
    fields = b"W05_004".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"W05_002".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4]) + b"\0" * 15
    body = b"".join(b" " + n.encode("cp932").ljust(10) + c.encode().ljust(4) for n, c in names)
    return b"\3\0\0\0" + struct.pack("<IHH", len(names), 32 + len(fields) + 1, 15) + b"\0" * 20 + fields + b"\r" + body


def test_zip_and_shapefile(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x_Stream.shp", shape([[(139.0, 35.0), (139.1, 35.0), (139.2, 35.1)], None]))
        z.writestr("x_Stream.dbf", dbase([("川", "c1"), ("無", "c2")]))
    members = scans.spark_members if hasattr(scans, "spark_members") else archives.zip_members(spark, f"{tmp_path}/*.zip")
    got = [(r.name, r.code, r.lon1, r.lon2) for r in archives.stream_segments(members, "W05_004", "W05_002").orderBy("lon1").collect()]
    assert got == [("川", "c1", 139.0, 139.1), ("川", "c1", 139.1, 139.2)]
    (tmp_path / "b.zip").write_bytes(b"<html>")
    with pytest.raises(Exception, match="no zip file"):
        archives.zip_members(spark, f"{tmp_path}/b.zip").collect()


def png(rows):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"

    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_tiles_fall_back_by_layer(spark):
    tiles = spark.createDataFrame([("fine", 1, 1, png([[(128, 0, 0), (0, 1, 0)]])), ("coarse", 1, 1, png([[(1, 0, 0), (1, 0, 0)]])), ("fine", 2, 2, None)], "layer string, x int, y int, content binary")
    pixels = archives.tile_elevations(tiles)
    points = spark.createDataFrame([(s, l, 1, 1, px, 0) for s, px in (("a", 0), ("b", 1)) for l in ("fine", "coarse")] + [("c", "fine", 2, 2, 0, 0)], "site_id string, layer string, x int, y int, px int, py int")
    got = {r.site_id: (r.elevation_m, r.layer) for r in archives.first_layer(points, pixels, ["fine", "coarse"]).collect()}
    assert got == {"a": (655.36, "coarse"), "b": (2.56, "fine"), "c": (None, None)}


def test_png_filters():
    plain = [[(10, 20, 30), (40, 50, 60)], [(11, 22, 33), (44, 55, 66)]]
    raw = bytes([1, 10, 20, 30, 30, 30, 30]) + bytes([2, 1, 2, 3, 4, 5, 6])
    body = png(plain)
    whole = body[:33] + struct.pack(">I", len(zlib.compress(raw))) + b"IDAT" + zlib.compress(raw) + b"\0\0\0\0"
    assert archives.png_pixels(whole).tolist() == archives.png_pixels(body).tolist() == [[list(p) for p in row] for row in plain]


def test_partitioned_documents(spark, tmp_path):
    df = spark.createDataFrame([("a", "13", 1), ("b", "26", 2)], "id string, code string, similar int")
    sinks.write_partitions(df, f"{tmp_path}/out", "code", without=("similar",))
    sinks.write_partitions(df.where("code = '13'"), f"{tmp_path}/out", "code", without=("similar",))
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/out").collect()] == [("a", 13)]
    with pytest.raises(ValueError, match="without code"):
        sinks.write_partitions(df.withColumn("code", F.lit(None).cast("string")), f"{tmp_path}/out", "code")
    led = sinks.index_of(df.withColumnRenamed("id", "site_id"), spark.createDataFrame([("old", "a")], "alias string, site_id string"), "site_id", "code")
    assert {tuple(r) for r in led.collect()} == {("a", "13", "a"), ("b", "26", "b"), ("old", "13", "a")}


def test_content_stamps_ignore_line_ends(spark):
    import hashlib

    files = spark.createDataFrame([("a", bytearray(b"x\r\ny\xff")), ("b", bytearray(b"x\ny\xff"))], "path string, content binary")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    got = {r.path: r.sha256 for r in sinks.content_stamps(files, wanted).collect()}
    assert got == {"a": hashlib.sha256(b"x\ny\xff").hexdigest(), "b": hashlib.sha256(b"x\ny\xff").hexdigest(), "c": None}
    assert sinks.stamp(sinks.content_stamps(files, wanted)).first().stamp == hashlib.sha256(f"a|{got['a']}\nb|{got['b']}\nc|missing".encode()).hexdigest()


def test_snapshot_stream(spark, tmp_path):
    schema = "site_id string, lon double, lat double, ordinal int"
    like = spark.createDataFrame([], "site_id string, lon double, lat double, elevation_m double, river_distance_m double, river_name string, river_note string")
    measured = []

    def measure(df):
        measured.append(sorted(r.site_id for r in df.collect()))
        return df.withColumns({"elevation_m": F.lit(1.0), "river_distance_m": F.lit(2.0), "river_name": F.lit("r"), "river_note": F.lit(None).cast("string")})

    for n, rows in enumerate([[("a", 139.0, 35.0, 0), ("b", 139.0, 35.0, 1)], [("a", 139.0, 35.0, 2), ("c", 139.0, 35.0, 3), ("b", 140.0, 35.0, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        assert snapshots.maintain(stream, f"file://{tmp_path}/snap", f"{tmp_path}/cp", measure, like).awaitTermination(60)
    assert measured == [["a", "b"], ["b", "c"]]
    assert {(r.site_id, r.lon) for r in snapshots.version(spark, f"file://{tmp_path}/snap", 1, like).collect()} == {("a", 139.0), ("b", 140.0), ("c", 139.0)}


def test_neighbour_lists_counts_and_sizes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "13", ["b"]), ("b", "13", []), ("c", "26", None), ("d", "01", ["a", "b"])], "id string, code string, similar array<string>")
    assert {r.code: r.n for r in sinks.write_neighbours(rows, f"{tmp_path}/similar", "id", "code", "similar").collect()} == {"13": 1, "01": 1}
    assert {r.code for r in spark.read.json(f"{tmp_path}/similar").withColumn("code", F.col("code").cast("string")).collect()} == {"13", "1"}
    index = sinks.index_of(rows.select(F.col("id").alias("site_id"), "code"), spark.createDataFrame([("old", "a")], "alias string, site_id string"), "site_id", "code")
    assert {r.code: (r.n, r.n_aliases) for r in sinks.counts_of(index, "code").collect()} == {"13": (2, 1), "26": (1, 0), "01": (1, 0)}
    (tmp_path / "doc.json").write_text("x" * 1000)
    [size] = sinks.sizes(spark, f"{tmp_path}/doc.json").collect()
    assert size.bytes == 1000 and size.gzip < 100


def test_star_tables_have_a_mark_and_fixed_columns(spark, tmp_path):
    sinks.write_star({"view_two_strike": spark.createDataFrame([("F1", 2, "more")], "code string, total int, zebra string").coalesce(1)}, str(tmp_path))
    [part] = [x for x in (tmp_path / "view_two_strike").iterdir() if x.suffix == ".csv"]
    assert part.read_bytes().decode("utf-8") == "\ufeffcode,total,needs_hc,has_hc_ref,zebra\nF1,2,,,more\n"


def test_stamps_of_many_files_and_state_in_ranges(spark, tmp_path):
    stamps = spark.createDataFrame([(f"p{i:03d}", f"h{i}") for i in range(50)], "path string, sha256 string")
    first = sinks.stamp(stamps, 8).first()
    assert first.n == 50 and first.stamp == sinks.stamp(stamps.repartition(7), 8).first().stamp != sinks.stamp(stamps.where("path <> 'p007'"), 8).first().stamp
    sinks.write_state(stamps, f"{tmp_path}/state", "path", 4)
    files = sorted(x for x in (tmp_path / "state").iterdir() if x.suffix == ".json")
    lines = [json.loads(y)["path"] for x in files for y in x.read_text().splitlines()]
    assert lines == sorted(lines) and len(lines) == 50 and len(files) > 1


@pytest.mark.parametrize("n", [0, 1, 500])
def test_collection_is_one_document(spark, tmp_path, n):
    rows = spark.createDataFrame([(i, 135 + i / 8, 35.5, f'a "{i}"') for i in range(n)], "id int, lon double, lat double, name string").repartition(4)
    sinks.write_collection(rows, f"{tmp_path}/c", "id", "lon", "lat", ["id", "name"], "© those who mapped it")
    got = json.loads("".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))))
    assert (got["type"], got["attribution"], len(got["features"])) == ("FeatureCollection", "© those who mapped it", n)
    assert [f["properties"] for f in got["features"]] == [{"id": i, "name": f'a "{i}"'} for i in range(n)]
    assert all(f["geometry"]["coordinates"] == [135 + i / 8, 35.5] for i, f in enumerate(got["features"]))
