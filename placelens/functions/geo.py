"""Geographic scalar expressions: distances, tiles, elevation pixels and projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth, and where the distance score bends.
EARTH_RADIUS_M = 6371008.8
STRONG_M, CANDIDATE_M, FAR_M = 50.0, 150.0, 500.0
#: No degree of latitude is shorter.
METRES_A_DEGREE = 110_500.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on the sphere."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def distance_score(d: Column) -> Column:
    """1 up to 50 m, down to 0.7 at 150 m, then down to 0 at 500 m."""
    return (
        F.when(d <= STRONG_M, 1.0)
        .when(d <= CANDIDATE_M, 1.0 - 0.3 * (d - STRONG_M) / (CANDIDATE_M - STRONG_M))
        .when(d <= FAR_M, 0.7 * (1.0 - (d - CANDIDATE_M) / (FAR_M - CANDIDATE_M)))
        .otherwise(0.0)
    )


def score_reach_m(score: float) -> float:
    """Metres beyond which ``distance_score`` stays below a score above 0."""
    if score > 0.7:
        return max(STRONG_M, CANDIDATE_M - (score - 0.7) / 0.3 * (CANDIDATE_M - STRONG_M))
    return FAR_M - score / 0.7 * (FAR_M - CANDIDATE_M)


def rounded(x: Column, digits: int) -> Column:
    """A number, not negative, to so many digits, half up; Spark's own ``round`` writes each as a decimal text, which costs more than a distance."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / size)


def tile_pixel(lon: Column, lat: Column, zoom: int) -> Column:
    """Web-Mercator tile and pixel: struct(x, y, px, py)."""
    n = float(1 << zoom)
    x = (lon + 180.0) / 360.0 * n
    y = (1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n
    part = lambda v: F.floor((v - F.floor(v)) * 256).cast("int")
    return F.struct(F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y"), part(x).alias("px"), part(y).alias("py"))


def elevation(r: Column, g: Column, b: Column) -> Column:
    """Metres from an elevation pixel; 2**23 is no data, above it values are negative."""
    x = r * 65536 + g * 256 + b
    return F.when(x == 1 << 23, F.lit(None).cast("double")).when(x > 1 << 23, (x - (1 << 24)) * 0.01).otherwise(x * 0.01)


def utm_zone(lon: Column) -> Column:
    """EPSG code of the northern UTM zone."""
    return (32600 + F.floor((lon + 180.0) / 6.0) + 1).cast("int")


#: Origins (latitude, longitude) of the twelve plane systems used.
PLANE_ORIGINS = {
    6669: (33.0, 129.5), 6670: (33.0, 131.0), 6671: (36.0, 132.0 + 1 / 6), 6672: (33.0, 133.5), 6673: (36.0, 134.0 + 1 / 3), 6674: (36.0, 136.0),
    6675: (36.0, 137.0 + 1 / 6), 6676: (36.0, 138.5), 6677: (36.0, 139.0 + 5 / 6), 6678: (40.0, 140.0 + 5 / 6), 6680: (44.0, 142.25), 6683: (26.0, 127.5),
}


#: The plane system of each prefecture, from north to south.
PREFECTURES = {
    "北海道": 6680,
    "青森県": 6678, "岩手県": 6678, "宮城県": 6678, "秋田県": 6678, "山形県": 6678, "福島県": 6678,
    "茨城県": 6677, "栃木県": 6677, "群馬県": 6677, "埼玉県": 6677, "千葉県": 6677, "東京都": 6677, "神奈川県": 6677,
    "新潟県": 6676, "富山県": 6675, "石川県": 6675, "福井県": 6674, "山梨県": 6676, "長野県": 6676, "岐阜県": 6675, "静岡県": 6676, "愛知県": 6675,
    "三重県": 6674, "滋賀県": 6674, "京都府": 6674, "大阪府": 6674, "兵庫県": 6673, "奈良県": 6674, "和歌山県": 6674,
    "鳥取県": 6673, "島根県": 6671, "岡山県": 6673, "広島県": 6671, "山口県": 6669,
    "徳島県": 6672, "香川県": 6672, "愛媛県": 6672, "高知県": 6672,
    "福岡県": 6670, "佐賀県": 6670, "長崎県": 6669, "熊本県": 6670, "大分県": 6670, "宮崎県": 6670, "鹿児島県": 6670, "沖縄県": 6683,
}
#: The UTM system (zones 52 to 54 on the same ellipsoid) that checks a plane system.
PLANE_UTM = {6669: 6689, 6670: 6689, 6671: 6690, 6672: 6690, 6673: 6690, 6674: 6690, 6675: 6690, 6676: 6691, 6677: 6691, 6678: 6691, 6680: 6691, 6683: 6689}


def _looked_up(key: Column, table: dict, kind: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, key).cast(kind)


def prefecture_plane(prefecture: Column) -> Column:
    """EPSG code of a prefecture's plane system; null for an unknown name, never guessed."""
    return _looked_up(F.btrim(prefecture), PREFECTURES, "int")


def plane_utm(epsg: Column) -> Column:
    """EPSG code of the UTM system in which a plane's distances are checked."""
    return _looked_up(epsg, PLANE_UTM, "int")


def projected(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct(x, y) in metres in a plane system, in a UTM system of 6689 to 6691, or in a northern UTM zone (32601 to 32660); null for others."""
    zone = F.when(epsg.between(6689, 6691), epsg - 6637).when(epsg.between(32601, 32660), epsg - 32600)
    lon0 = F.coalesce(zone * 6.0 - 183.0, _looked_up(epsg, {k: float(v[1]) for k, v in PLANE_ORIGINS.items()}, "double"))
    lat0 = F.coalesce(F.when(zone.isNotNull(), 0.0), _looked_up(epsg, {k: float(v[0]) for k, v in PLANE_ORIGINS.items()}, "double"))
    scale, east = F.when(zone.isNotNull(), 0.9996).otherwise(0.9999), F.when(zone.isNotNull(), 500_000.0).otherwise(0.0)
    return F.when(lon0.isNotNull(), transverse_mercator(lon, lat, lon0, lat0, scale, east))


def transverse_mercator(lon: Column, lat: Column, lon0: Column | float, lat0: Column | float = 0.0, scale: Column | float = 0.9999, east: Column | float = 0.0) -> Column:
    """struct(x, y) in metres on the GRS80 ellipsoid (series of third order in n; under a millimetre within a zone)."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = 2 * math.sqrt(n) / (1 + n)

    def conformal(phi: Column) -> Column:
        s = F.sin(phi)
        return F.sinh(F.atanh(s) - e * F.atanh(e * s))

    lon0, lat0 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lon0, lat0))
    t, dl = conformal(F.radians(lat)), F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    xi0 = F.atan(conformal(F.radians(lat0)))
    north, east_part, north0 = xi, eta, xi0
    for j, c in enumerate(alpha, 1):
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east_part = east_part + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north0 = north0 + c * F.sin(2 * j * xi0)
    return F.struct((east + scale * radius * east_part).alias("x"), (scale * radius * (north - north0)).alias("y"))


def point_segment_m(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment in a plane; a segment may be one point."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / square))).otherwise(0.0)
    return F.sqrt(F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2))
