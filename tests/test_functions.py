"""Scalar functions on rows with known results."""

import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placelens.functions import geo, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x):
    return F.lit(x).cast("double")


def test_haversine(spark):
    far = one(spark, d=geo.haversine_m(lit(139.767125), lit(35.681236), lit(135.758767), lit(34.985849))).d
    assert abs(far - 371_710.6) < 60  # stations of two cities
    mile = one(spark, d=geo.haversine_m(lit(0), lit(0), lit(0), lit(1 / 60))).d
    assert abs(mile - 1853.25) < 0.1
    assert abs(one(spark, d=geo.haversine_m(lit(0), lit(0), lit(180), lit(0))).d - math.pi * geo.EARTH_RADIUS_M) < 1e-3


def test_distance_score(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 50.0, 100.0, 150.0, 325.0, 500.0, 501.0)], "d double")
    got = [round(r.s, 9) for r in d.select("d", geo.distance_score(F.col("d")).alias("s")).orderBy("d").collect()]
    assert got == [1.0, 1.0, 0.85, 0.7, 0.35, 0.0, 0.0]


@pytest.mark.parametrize("rgb, metres", [((0, 0, 0), 0.0), ((0, 1, 0), 2.56), ((1, 0, 0), 655.36), ((128, 0, 0), None), ((255, 255, 255), -0.01)])
def test_elevation(spark, rgb, metres):
    got = one(spark, e=geo.elevation(*map(F.lit, rgb))).e
    assert got is None if metres is None else abs(got - metres) < 1e-9


def test_tiles_and_zones(spark):
    t = one(spark, t=geo.tile_pixel(lit(139.767125), lit(35.681236), 15)).t
    n = 2**15
    x, y = (139.767125 + 180) / 360 * n, (1 - math.asinh(math.tan(math.radians(35.681236))) / math.pi) / 2 * n
    assert (t.x, t.y, t.px, t.py) == (int(x), int(y), int(x % 1 * 256), int(y % 1 * 256))
    assert one(spark, z=geo.utm_zone(lit(139.7))).z == 32654


def test_projection_lengths(spark):
    """A degree along the meridian, and a short distance, as on the ellipsoid and the sphere."""
    lat0, lon0 = geo.PLANE_ORIGINS[6677]
    at = lambda lon, lat: one(spark, p=geo.transverse_mercator(lit(lon), lit(lat), lon0, lat0)).p
    origin, north = at(lon0, lat0), at(lon0, lat0 + 1)
    assert abs(origin.x) < 1e-6 and abs(origin.y) < 1e-6 and abs(north.x) < 1e-6
    assert abs(north.y / 0.9999 - 110_968.0) < 40
    a, b = at(139.70, 35.60), at(139.71, 35.61)
    sphere = one(spark, d=geo.haversine_m(lit(139.70), lit(35.60), lit(139.71), lit(35.61))).d
    assert abs(math.hypot(a.x - b.x, a.y - b.y) / sphere - 1) < 0.004


def test_names(spark):
    rows = [("　ｱｲﾄﾞﾙ　ＡＢＣ\n x ",), (None,), ("plain  name ",), ("第一 鳥居",)]
    df = spark.createDataFrame(rows, "n string")
    got = [(r.a, r.k, r.p) for r in df.select(text.plain_normalised(F.col("n")).alias("a"), text.name_key(F.col("n")).alias("k"), text.part_suffix(F.col("n")).alias("p")).collect()]
    assert got == [("アイドル ABC x", "アイドルABCx", None), ("", "", None), ("plain name", "plainname", None), ("第一 鳥居", "第一鳥居", "鳥居")]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=20), st.text("abcé ", max_size=20))
def test_similarity_against_a_table(a, b):
    assert text.common_subsequence(a, b) == longest(a, b)
    x, y = text.normalise(a), text.normalise(b)
    want = 1.0 if x == y == "" else 0.0 if not x or not y else 2 * longest(x, y) / (len(x) + len(y))
    assert text.similarity(a, b) == want == text.similarity(b, a)
    assert unicodedata.normalize("NFKC", x) == x


def test_best_similarity(spark):
    df = spark.createDataFrame([(["abc", "x"], ["xyz", "abd"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [round(r.s, 6) for r in df.select(text.best_similarity("a", "b").alias("s")).collect()] == [round(2 / 3, 6), 0.0]


@pytest.mark.parametrize(
    "url, want",
    [("https://www.Example.org/a/b/?q=1", "example.org/a/b"), ("Example.org/x#t", "example.org/x"), ("//h", "h"), ("http:///x", None), (None, None), ("", None), ("https://h/", "h")],
)
def test_host_path(spark, url, want):
    assert one(spark, u=text.host_path(F.lit(url).cast("string"))).u == want


@pytest.mark.parametrize("value, precision, want", [("+0927-01-01T00:00:00Z", 9, (927, 927)), ("+0705-01-01T00:00:00Z", 8, (700, 709)), ("+0750-00-00T00:00:00Z", 7, (700, 799)), ("-0660-02-11T00:00:00Z", 9, (-660, -660)), ("-0655-00-00T00:00:00Z", 8, (-660, -651)), ("+0900-01-01T00:00:00Z", 3, None), ("x", 9, None)])
def test_year_range(spark, value, precision, want):
    got = one(spark, r=text.year_range(F.lit(value), F.lit(precision))).r
    assert (got and (got.year_min, got.year_max)) == want


def test_parsers(spark):
    got = one(
        spark, a=text.numeric_prefix(F.lit(" -12.5 m")), b=text.numeric_prefix(F.lit("m")), p=text.wkt_point(F.lit("Point(139.5 35.25)")), q=text.wkt_point(F.lit("Line(1 2)")),
        t=text.page_title(F.lit("https://x.org/wiki/A%2BB_%28c%29+d")), b2=text.base_title(F.lit("A B (c)")), n=text.entity_number(F.lit("Q42")), m=text.entity_number(F.lit("x")), c=text.area_code(F.lit("JP-13")),
    )
    assert (got.a, got.b, tuple(got.p), got.q, got.t, got.b2, got.n, got.m, got.c) == (-12.5, None, (139.5, 35.25), None, "A+B (c)+d", "A B", 42, 10**12, "13")
    with pytest.raises(Exception, match="unknown area"):
        one(spark, c=text.area_code(F.lit("JP-48")))
