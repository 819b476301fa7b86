"""Zip archives, shapefiles and raster tiles as tables."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import elevation


def zip_members(spark: SparkSession, glob: str, suffix: str = "") -> DataFrame:
    """(path, member, content) of the members of zip files; a file without the zip mark is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                if bytes(content[:2]) != b"PK":
                    raise ValueError(f"{path} is no zip file")
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(suffix) and not name.endswith("/"):
                            yield pd.DataFrame({"path": [path], "member": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def line_records(content: bytes) -> list[list[tuple[float, float]] | None]:
    """Points of each polyline record of a shapefile; null shapes are None, parts follow each other."""
    out, at = [], 100
    while at + 8 <= len(content):
        size = struct.unpack(">i", content[at + 4 : at + 8])[0] * 2
        body = content[at + 8 : at + 8 + size]
        at += 8 + size
        if struct.unpack("<i", body[:4])[0] not in (3, 13, 23):
            out.append(None)
            continue
        parts, points = struct.unpack("<2i", body[36:44])
        first = 44 + 4 * parts
        out.append(list(struct.iter_unpack("<2d", body[first : first + 16 * points])))
    return out


def attribute_records(content: bytes, encoding: str = "cp932") -> list[dict[str, str]]:
    """Fields of each record of a dBASE table; a text that the encoding garbles is an error."""
    count, head, size = struct.unpack("<IHH", content[4:12])
    fields = []
    for at in range(32, head - 1, 32):
        if content[at] == 0x0D:
            break
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
    out = []
    for i in range(count):
        at = head + i * size + 1
        row = {}
        for name, width in fields:
            row[name] = content[at : at + width].decode(encoding).strip()
            if "�" in row[name]:
                raise ValueError(f"garbled field {name}")
            at += width
        out.append(row)
    return out


def stream_segments(members: DataFrame, name_field: str, code_field: str) -> DataFrame:
    """(path, record, name, code, lon1, lat1, lon2, lat2): segments of the lines in pairs of .shp and .dbf members.

    ``members`` (path, member, content); null geometries have no segments.
    """
    stem = F.regexp_replace("member", r"\.(shp|dbf)$", "")
    shp = members.where(F.col("member").endswith(".shp")).select("path", stem.alias("stem"), F.col("content").alias("shp"))
    dbf = members.where(F.col("member").endswith(".dbf")).select("path", stem.alias("stem"), F.col("content").alias("dbf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, a, b in zip(frame["path"], frame["shp"], frame["dbf"]):
                for i, (points, row) in enumerate(zip(line_records(bytes(a)), attribute_records(bytes(b)))):
                    if points and len(points) > 1:
                        p = np.array(points)
                        yield pd.DataFrame({"path": path, "record": i, "name": row[name_field], "code": row[code_field], "lon1": p[:-1, 0], "lat1": p[:-1, 1], "lon2": p[1:, 0], "lat2": p[1:, 1]})

    return shp.join(dbf, ["path", "stem"]).select("path", "shp", "dbf").mapInPandas(run, "path string, record int, name string, code string, lon1 double, lat1 double, lon2 double, lat2 double")


def png_pixels(content: bytes) -> np.ndarray:
    """Rows of red, green and blue of an 8-bit PNG tile without interlace."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, width, height, channels = 8, b"", 0, 0, 0
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, *_, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace or color not in (2, 6):
                raise ValueError("only plain 8-bit RGB tiles")
            channels = 3 if color == 2 else 4
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                left = line[x - channels] if x >= channels else 0
                corner = above[x - channels] if x >= channels else 0
                if kind == 1:
                    add = left
                elif kind == 3:
                    add = (left + above[x]) // 2
                else:
                    add = min((left, above[x], corner), key=lambda v: abs(left + above[x] - corner - v))
                line[x] = (line[x] + add) & 255
        out[y] = above = line & 255
    return out.reshape(height, width, channels)[:, :, :3]


def tile_elevations(tiles: DataFrame) -> DataFrame:
    """(layer, x, y, px, py, elevation_m) of tiles (layer, x, y, content); a tile with null content has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for layer, x, y, content in zip(frame["layer"], frame["x"], frame["y"], frame["content"]):
                if content is not None:
                    p = png_pixels(bytes(content)).astype("int32")
                    py, px = np.mgrid[: p.shape[0], : p.shape[1]]
                    yield pd.DataFrame({"layer": layer, "x": x, "y": y, "px": px.ravel(), "py": py.ravel(), "r": p[..., 0].ravel(), "g": p[..., 1].ravel(), "b": p[..., 2].ravel()})

    pixels = tiles.select("layer", "x", "y", "content").mapInPandas(run, "layer string, x int, y int, px int, py int, r int, g int, b int")
    return pixels.select("layer", "x", "y", "px", "py", elevation(F.col("r"), F.col("g"), F.col("b")).alias("elevation_m"))


#: Points of one tile that a task reads; a tile with more is decoded in several tasks.
TILE_POINTS = 100_000


def point_elevations(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """(site_id, layer, x, y, px, py, elevation_m) of each point (a row for each layer) from tiles (layer, x, y, content).

    Points and tiles are grouped by tile, so that a tile is decoded once and
    only the pixels of its points leave the task.  elevation_m is null where
    the tile has no value there, is absent, or is known to be absent (null
    content); a pixel outside the tile is an error.  A tile of very many points
    is dealt over tasks.
    """
    key = ["layer", "x", "y"]
    parts = points.groupBy(*key).agg(F.ceil(F.count("*") / TILE_POINTS).cast("int").alias("parts"))
    own = points.select("site_id", *key, "px", "py").join(parts, key).withColumn("part", F.pmod(F.xxhash64("site_id", "px", "py"), F.col("parts")).cast("int"))
    dealt = tiles.where("content is not null").select(*key, "content").join(parts, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "content")
    kind = own.schema["site_id"].dataType.simpleString()

    def run(own: pa.Table, tile: pa.Table) -> pa.Table:
        columns = [own.column(c) for c in ("site_id", *key, "px", "py")]
        colors = [pa.nulls(own.num_rows, pa.int32())] * 3
        if tile.num_rows:
            pixels = png_pixels(tile.column("content")[0].as_py())
            colors = [pa.array(pixels[own.column("py").to_numpy(), own.column("px").to_numpy(), i].astype(np.int32)) for i in range(3)]
        return pa.table([*columns, *colors], names=["site_id", *key, "px", "py", "r", "g", "b"])

    read = own.drop("parts").groupBy(*key, "part").cogroup(dealt.groupBy(*key, "part")).applyInArrow(run, f"site_id {kind}, layer string, x int, y int, px int, py int, r int, g int, b int")
    return read.select("site_id", *key, "px", "py", elevation(F.col("r"), F.col("g"), F.col("b")).alias("elevation_m"))


def first_layer_with_value(points: DataFrame, tiles: DataFrame, layers: list[str]) -> DataFrame:
    """(site_id, elevation_m, layer): of each point the first layer in order that has a value; null where none has."""
    order = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    value = F.when(F.col("elevation_m").isNotNull(), F.struct("elevation_m", "layer"))
    best = point_elevations(points, tiles).groupBy("site_id").agg(F.min_by(value, F.when(value.isNotNull(), order)).alias("b"))
    return best.select("site_id", "b.elevation_m", "b.layer")


def first_layer(points: DataFrame, pixels: DataFrame, layers: list[str]) -> DataFrame:
    """(site_id, elevation_m, layer): the first layer in order that has a value at the point's pixel.

    ``points`` (site_id, layer, x, y, px, py) has a row for each layer.
    """
    order = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    met = points.join(pixels.where("elevation_m is not null"), ["layer", "x", "y", "px", "py"])
    best = met.groupBy("site_id").agg(F.min_by(F.struct("elevation_m", "layer"), order).alias("b"))
    return points.select("site_id").distinct().join(best, "site_id", "left").select("site_id", "b.elevation_m", "b.layer")
