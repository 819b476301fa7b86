"""Nearest line segments and box overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell, point_segment_m, projected, utm_zone
from ..sources.shared import cut, dealt

#: Cells of segments and half-width of a site's box in degrees, and the largest distance reported.
SEGMENT_CELL, BOX, FAR_M = 0.15, 0.15, 10_000.0
#: Segments of a cell beyond which smaller cells are tried first, and how many times.
CROWDED, FINER = 8, 8


def covering_cells(x1: str, y1: str, x2: str, y2: str, size: float):
    """Array of (cy, cx) that the box of a segment touches."""
    span = lambda a, b: F.sequence(cell(F.least(a, b), size), cell(F.greatest(a, b), size))
    return F.flatten(F.transform(span(y1, y2), lambda y: F.transform(span(x1, x2), lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


def _reach_m(lat: Column, size: float) -> Column:
    """Metres that 3 x 3 cells around a site cover for certain; a hundredth is left for the plane's scale."""
    east = 111_195 * F.cos(F.radians(F.least(F.abs(lat) + size, F.lit(89.0))))
    return 0.99 * size * F.least(F.lit(110_500.0), east)


def _sizes(sites: DataFrame, size: float, most: float) -> list[float]:
    """Cells to look into one after the other: ``size``, then three times as large, the last ones reaching ``most`` metres."""
    top = sites.select(F.max(F.abs("lat")).alias("lat")).select("lat", *[_reach_m(F.col("lat"), size * 3**i).alias(f"r{i}") for i in range(12)]).first()
    sizes = [size]
    while len(sizes) < 12 and top["lat"] is not None and top[f"r{len(sizes) - 1}"] < most:
        sizes.append(3 * sizes[-1])
    return sizes


def nearest_segment(sites: DataFrame, segments: DataFrame, size: float = SEGMENT_CELL, most: float = FAR_M) -> DataFrame:
    """(site_id, name, distance_m, note): nearest named segment in the plane of the site.

    Segments (name, lon1, lat1, lon2, lat2) are blocked by the cells that they
    touch, sites (site_id, lon, lat) look into 3 x 3 cells, smaller ones first
    where segments are crowded; sites that find nothing as near as these cover for certain look into larger ones, until
    ``most`` metres are covered.  A column epsg of the sites names the plane of
    each (``geo.prefecture_plane``); without it, or where it is null, that of
    the UTM zone is taken.  Ties go to the smaller name.  Beyond ``most``
    metres, or with nothing near, the distance is null with a note.
    """
    zone = utm_zone(F.col("lon"))
    epsg = F.coalesce("epsg", zone) if "epsg" in sites.columns else zone
    left = cut(dealt(sites.select("site_id", "lon", "lat", epsg.alias("epsg")), "site_id").withColumn("p", projected(F.col("lon"), F.col("lat"), F.col("epsg"))), "sites")
    box = [f(c).alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)]
    planes = [x for x in left.groupBy("epsg").agg(*box).collect() if x["min_lon"] is not None]  # at most 12 planes and 60 zones
    if not planes:
        return sites.select("site_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("distance_m"), F.lit("nothing in the cells around").alias("note"))
    sizes = _sizes(left, size, most)
    # each segment in the planes whose sites may look into its cells
    meets = lambda x: (
        F.least("lon1", "lon2").between(-999, x["max_lon"] + 2 * sizes[-1]) & (F.greatest("lon1", "lon2") >= x["min_lon"] - 2 * sizes[-1])
        & F.least("lat1", "lat2").between(-999, x["max_lat"] + 2 * sizes[-1]) & (F.greatest("lat1", "lat2") >= x["min_lat"] - 2 * sizes[-1])
    )
    both = lambda i: projected(F.col(f"lon{i}"), F.col(f"lat{i}"), F.col("epsg"))
    flat = segments.withColumn("epsg", F.explode(F.array_compact(F.array(*[F.when(meets(x), F.lit(x["epsg"])) for x in planes])))).withColumns({"s": both(1), "e": both(2)})
    flat, best = cut(flat, "segments"), None
    for step in [*_finer(flat, size), *sizes]:
        met = _in_cells(left, flat, step)
        nearest = cut(met.groupBy("site_id").agg(F.min("d").alias("_d"), F.min("reach").alias("_reach")), "nearest")
        done = nearest if step == sizes[-1] else nearest.where("_d <= _reach")
        # distances are a minimum of numbers, which is never sorted; names only where they are the nearest
        named = _in_cells(left.join(done, "site_id"), flat, step).where("d = _d").groupBy("site_id").agg(F.min(F.struct("d", "name")).alias("b"))
        found = cut(named, "named")
        best = found if best is None else best.union(found)
        left = cut(left.join(done.select("site_id"), "site_id", "left_anti"), "sites")
        if left.isEmpty():
            break
    out = sites.select("site_id").join(best, "site_id", "left")
    d = F.col("b.d")
    note = F.when(d.isNull(), "nothing in the cells around").when(d > most, "farther than the limit")
    return out.select("site_id", F.when(note.isNull(), F.col("b.name")).alias("name"), F.when(note.isNull(), F.round(d, 1)).alias("distance_m"), note.alias("note"))


def _finer(segments: DataFrame, size: float) -> list[float]:
    """Cells smaller than ``size`` to look into first where segments are crowded, in ascending order.

    Crowded is a cell of more than ``CROWDED`` segments, as a segment finds it
    on average; no cell is smaller than a fifth of a segment's extent, so that
    a segment is repeated for so many cells at most.
    """
    extent = (F.abs(F.col("lon1") - F.col("lon2")) + F.abs(F.col("lat1") - F.col("lat2"))) / 2
    least = (segments.agg(F.avg(extent)).first()[0] or 0.0) / 5
    out = []
    while len(out) < FINER and (now := (out[0] if out else size)) / 3 > max(least, 1e-6):
        counts = segments.groupBy("epsg", cell(F.col("lat1"), now), cell(F.col("lon1"), now)).count()
        if (counts.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0.0) <= CROWDED:
            break
        out.insert(0, now / 3)
    return out


def _in_cells(sites: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """``sites`` with d and name of each segment that touches the 3 x 3 cells around, and reach, the metres that these cover.

    Segments are repeated for the cells around those that they touch, so a site
    meets a segment once, in its own cell.  They are small on disk and large
    once repeated, so it is not left to Spark to broadcast them.
    """
    wide = [F.least(f"{c}1", f"{c}2") - size for c in ("lon", "lat")] + [F.greatest(f"{c}1", f"{c}2") + size for c in ("lon", "lat")]
    around = F.explode(covering_cells(wide[0], wide[1], wide[2], wide[3], size))
    ends = [F.col(f"{x}.{y}").alias(f"_{x}{y}") for x in "se" for y in "xy"]
    blocks = segments.select("epsg", "name", *ends, around.alias("_c")).select("epsg", "name", "_sx", "_sy", "_ex", "_ey", "_c.cy", "_c.cx")
    own = sites.withColumns({"_px": F.col("p.x"), "_py": F.col("p.y"), "cy": cell(F.col("lat"), size), "cx": cell(F.col("lon"), size), "reach": _reach_m(F.col("lat"), size)}).drop("p")
    places = ["_px", "_py", "_sx", "_sy", "_ex", "_ey"]
    d = point_segment_m(*map(F.col, places))
    return own.join(blocks.hint("merge"), ["epsg", "cy", "cx"]).withColumn("d", d).drop("epsg", "cy", "cx", *places)


def partitions_for(sites: DataFrame, todo: Column, boxes: DataFrame, half: float = BOX) -> DataFrame:
    """(code): the partitions that hold anything for the sites still to be measured."""
    return overlapping_boxes(sites.where(todo), boxes, half).select("code").distinct()


def overlapping_boxes(sites: DataFrame, boxes: DataFrame, half: float = BOX) -> DataFrame:
    """(site_id, code): partitions whose box meets the site's box, borders included.

    ``boxes`` (code, west, south, east, north) is joined on the cells that a
    box covers, not by comparing every site with every box.
    """
    size = 1.0
    own = sites.select("site_id", (F.col("lon") - half).alias("w"), (F.col("lat") - half).alias("s"), (F.col("lon") + half).alias("e"), (F.col("lat") + half).alias("n"))
    own = own.withColumn("_c", F.explode(covering_cells("w", "s", "e", "n", size)))
    other = boxes.withColumn("_c", F.explode(covering_cells("west", "south", "east", "north", size)))
    met = own.join(other, "_c").where("w <= east and e >= west and s <= north and n >= south")
    return met.select("site_id", "code").distinct()


def agreement_of_paths(first: DataFrame, second: DataFrame, key: str = "site_id") -> DataFrame:
    """Distances measured in two planes: (key, d1, d2, agrees) with a tolerance of a metre or two thousandths."""
    both = first.select(key, F.col("distance_m").alias("d1")).join(second.select(key, F.col("distance_m").alias("d2")), key)
    return both.withColumn("agrees", F.abs(F.col("d1") - F.col("d2")) <= F.greatest(F.lit(1.0), 2e-3 * F.col("d1")))


#: Pixels of a cell of map clusters, and of a tile.
CLUSTER_PIXELS, TILE_PIXELS = 44, 256


def zoom_pyramid(points: DataFrame, finest: int, coarsest: int = 0) -> DataFrame:
    """(zoom, cx, cy, n, lon, lat): points counted in cells of the map at each zoom, with the mean of their coordinates.

    The points are read once, for the finest zoom; every coarser one is added up
    from the cells of the one below it, four to one, so its work shrinks with
    the number of cells.  A point without coordinates is in no cell.
    """
    scale = 2.0**finest * TILE_PIXELS / CLUSTER_PIXELS
    cx = F.floor((F.col("lon") + 180) / 360 * scale)
    cy = F.floor((1 - F.asinh(F.tan(F.radians("lat"))) / F.pi()) / 2 * scale)
    own = points.where("lon is not null and lat is not null").groupBy(cx.alias("cx"), cy.alias("cy"))
    level = cut(own.agg(F.count("*").alias("n"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat")), "zoom")
    out = None
    for zoom in range(finest, coarsest - 1, -1):
        row = level.select(F.lit(zoom).alias("zoom"), "cx", "cy", "n", (F.col("lon") / F.col("n")).alias("lon"), (F.col("lat") / F.col("n")).alias("lat"))
        out = row if out is None else out.union(row)
        if zoom > coarsest:
            up = level.groupBy(F.floor(F.col("cx") / 2).alias("cx"), F.floor(F.col("cy") / 2).alias("cy"))
            level = cut(up.agg(F.sum("n").alias("n"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat")), "zoom")
    return out
