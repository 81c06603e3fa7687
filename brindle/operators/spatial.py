"""Geometry without extensions: validation, point in polygon, projected support of evidence regions.

Geometries are arrays of coordinates: a multipolygon is array<array<array<array<double>>>> (parts, rings, points, x and y).
"""

from __future__ import annotations

import functools
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULTIPOLYGON = "array<array<array<array<double>>>>"

# Bounds of the region in degrees (west, south, east, north), of previews, and the expected shapes of kinds.
BOUNDS = (22.5, 42.3, 24.35, 43.0)
PREVIEW_BOUNDS = (23.0, 42.55, 23.65, 42.85)
SHAPES = {"boundary": ("Polygon", "MultiPolygon"), "poi": ("Point",), "surface": ("Polygon", "MultiPolygon")}

# Lambert conformal conic with two standard parallels on GRS 80 (EPSG:7801, from the public registry).
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
ORIGIN_LATITUDE, ORIGIN_LONGITUDE = 42.6678756833333, 25.5
PARALLELS = (42.0, 43.3333333333333)
FALSE_EASTING, FALSE_NORTHING = 500000.0, 4725824.3591


def within(x: Column, y: Column, box: tuple[float, float, float, float] = BOUNDS) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


_NUMBER = r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"


def geometry(text: Column, kind: Column) -> Column:
    """A GeoJSON geometry of a kind as struct<shape, polygons (multipolygon), point, faults>.

    The coordinates' own schema says whether they are numbers at the depth that the shape asks for; JSON has no other than
    finite ones.  Polygons become multipolygons; `polygons` and `point` are null where there are faults.
    """
    value = F.try_parse_json(text)
    shape = F.try_variant_get(value, "$.type", "string")
    coordinates = F.try_variant_get(value, "$.coordinates", "variant")
    nested = F.coalesce(F.schema_of_variant(coordinates), F.lit(""))
    allowed = F.create_map(*[F.lit(x) for name, shapes in SHAPES.items() for x in (name, ",".join(shapes))])
    expected = F.coalesce(F.array_contains(F.split(F.try_element_at(allowed, kind), ","), shape), F.lit(False))

    def of_depth(n: int) -> Column:
        return nested.rlike("^" + "ARRAY<" * n + _NUMBER + ">" * n + "$")

    flat, areal = shape == "Point", shape.isin("Polygon", "MultiPolygon")
    numeric = F.when(flat, of_depth(1)).when(shape == "Polygon", of_depth(3)).otherwise(of_depth(4))
    point = F.try_variant_get(coordinates, "$", "array<double>")
    polygons = F.when(shape == "Polygon", F.array(F.try_variant_get(coordinates, "$", MULTIPOLYGON[6:-1]))).otherwise(F.try_variant_get(coordinates, "$", MULTIPOLYGON))
    rings = F.when(flat, F.array(F.array(point))).otherwise(F.flatten(polygons))
    faults = [
        (~expected, "unexpected geometry type"),
        (expected & ~numeric, "not finite coordinates at the expected depth"),
        (areal & numeric & ((F.size(polygons) == 0) | F.exists(polygons, lambda p: F.size(p) == 0)), "empty polygon"),
        (areal & numeric & F.exists(rings, lambda r: (F.size(r) < 4) | (F.get(r, F.lit(0)) != F.element_at(r, -1))), "ring not closed"),
        (numeric & F.exists(F.flatten(rings), lambda p: F.size(p) != 2), "not two-dimensional"),
        (numeric & F.exists(F.flatten(rings), lambda p: (F.size(p) == 2) & ~within(F.get(p, F.lit(0)), F.get(p, F.lit(1)))), "outside the bounds"),
    ]
    found = F.array_compact(F.array(*[F.when(expected | F.lit(i == 0), F.when(F.coalesce(wrong, F.lit(False)), message)) for i, (wrong, message) in enumerate(faults)]))
    sound = F.size(found) == 0
    return F.struct(shape.alias("shape"), F.when(sound & areal, polygons).alias("polygons"), F.when(sound & flat, point).alias("point"), found.alias("faults"))


def edges_of(ring: Column) -> Column:
    """Edges of a closed ring, as structs of their ends a and b."""
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def crosses_itself(ring: Column) -> Column:
    """Do two edges of a closed ring cross, other than at shared ends?  Each edge is compared with those after it."""

    def side(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    def cross(e: Column, f: Column) -> Column:
        return (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)

    def any_pair(edges: Column) -> Column:
        hits = F.transform(edges, lambda e, i: F.exists(F.slice(edges, i + 2, F.size(edges)), lambda f: cross(e, f)))
        return F.exists(hits, lambda x: x)

    return F.transform(F.array(edges_of(ring)), any_pair)[0]


def box_of(polygons: Column) -> Column:
    """Struct of the bounding box of a multipolygon."""
    points = F.flatten(F.flatten(polygons))
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def covers(polygons: Column, x: Column, y: Column) -> Column:
    """Is the point inside, or on an edge, of a multipolygon?  Even-odd rule over all rings of a part, holes included."""

    def on_edge(e: Column) -> Column:
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        flat = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (flat == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    def crossed(e: Column) -> Column:
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        at = F.when(ay != by, ax + (y - ay) * (bx - ax) / F.when(ay != by, by - ay))
        return ((ay > y) != (by > y)) & F.coalesce(x < at, F.lit(False))

    def part(p: Column) -> Column:
        all_edges = F.flatten(F.transform(p, edges_of))
        return F.exists(all_edges, on_edge) | (F.size(F.filter(all_edges, crossed)) % 2 == 1)

    return F.exists(polygons, part)


def points_in_units(points: DataFrame, units: DataFrame, cell: float = 0.01) -> DataFrame:
    """Inner join of points (x, y, …) and units (unit, polygons): every unit that covers a point, edges included.

    Units are listed by the grid cells their bounding box touches, so that the join is on a cell and not of all with all.
    """
    boxed = units.withColumn("_box", box_of(F.col("polygons")))
    steps = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    cells = boxed.withColumn("_cx", F.explode(steps(F.col("_box.west"), F.col("_box.east")))).withColumn("_cy", F.explode(steps(F.col("_box.south"), F.col("_box.north"))))
    placed = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    joined = placed.join(cells, ["_cx", "_cy"]).where(F.col("x").between(F.col("_box.west"), F.col("_box.east")) & F.col("y").between(F.col("_box.south"), F.col("_box.north")))
    return joined.where(covers(F.col("polygons"), F.col("x"), F.col("y"))).drop("_cx", "_cy", "_box", "polygons")


def project(longitude: np.ndarray, latitude: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north in the projected system."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: np.tan(math.pi / 4 - p / 2) / ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2)
    p1, p2, p0 = (math.radians(v) for v in (*PARALLELS, ORIGIN_LATITUDE))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    radius = AXIS * f * t(np.radians(latitude)) ** n
    angle = n * (np.radians(longitude) - math.radians(ORIGIN_LONGITUDE))
    return FALSE_EASTING + radius * np.sin(angle), FALSE_NORTHING + AXIS * f * t(p0) ** n - radius * np.cos(angle)


def inside(xs: np.ndarray, ys: np.ndarray, polygons: list) -> np.ndarray:
    """Even-odd test of many points against one multipolygon."""
    out = np.zeros(len(xs), bool)
    for part in polygons:
        odd = np.zeros(len(xs), bool)
        for ring in part:
            r = np.asarray(ring, float)
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                if ay != by:
                    odd ^= ((ay > ys) != (by > ys)) & (xs < ax + (ys - ay) * (bx - ax) / (by - ay))
        out |= odd
    return out


@functools.lru_cache(maxsize=1000)
def _projected(polygons: str) -> tuple[list, tuple[float, float, float, float]]:
    """A multipolygon in JSON, in projected metres, with its box (west, south, east, north)."""
    flat = [[np.stack(project(np.array([p[0] for p in ring], float), np.array([p[1] for p in ring], float)), axis=1) for ring in part] for part in json.loads(polygons)]
    points = np.concatenate([ring for part in flat for ring in part])
    return flat, (*points.min(axis=0), *points.max(axis=0))


def support(regions: DataFrame, units: DataFrame, resolution: int = 48, least: float = 1e-4) -> DataFrame:
    """(group_key, unit, mass): the share of each evidence region that lies in each unit.

    A region is the union of disks of radius_m around its points (group_key, x, y, radius_m); its share of a unit is measured
    on a grid of `resolution` cells a radius in projected metres, each grid point counted once however many disks hold it.
    Units arrive through a join on coarse grid cells: a disk asks on the grid whose cells are at least as wide as it is, so that
    it touches four cells at most, whatever its radius; units are listed on every grid.  Shares of at most
    `least` are dropped.  Against exact areas the error is of the order of 1 / resolution of the boundary cut.
    """
    cell, levels, strip = 0.05, 24, 1_000_000
    reach = F.col("radius_m") / 60_000.0 + 1e-6
    level = F.least(F.greatest(F.ceil(F.log2(2 * reach / cell)), F.lit(0)), F.lit(levels)).cast("int")
    wide = lambda v: F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))))
    span = lambda a, b: F.explode(F.sequence(wide(a), wide(b)))
    x, y, box = F.col("x"), F.col("y"), F.col("_box")
    near = regions.withColumn("_level", level).withColumn("_cx", span(x - reach, x + reach)).withColumn("_cy", span(y - reach, y + reach))
    boxed = units.withColumn("_box", box_of(F.col("polygons"))).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    cells = boxed.withColumn("_cx", span(box["west"], box["east"])).withColumn("_cy", span(box["south"], box["north"])).drop("polygons")
    meets = (box["west"] <= x + reach) & (box["east"] >= x - reach) & (box["south"] <= y + reach) & (box["north"] >= y - reach)
    candidates = near.join(cells, ["_level", "_cx", "_cy"]).where(meets).select("group_key", "unit").distinct().join(units.select("unit", F.to_json("polygons").alias("polygons")).distinct(), "unit")
    points = regions.groupBy("group_key").agg(F.to_json(F.array_sort(F.collect_set(F.struct("x", "y", "radius_m")))).alias("points"))
    schema = "group_key string, unit string, mass double"
    out_schema = pa.schema([("group_key", pa.string()), ("unit", pa.string()), ("mass", pa.float64())])

    def masses(rows: pa.Table) -> pa.Table:
        disks = [(p["x"], p["y"], p["radius_m"]) for p in json.loads(rows.column("points")[0].as_py())]
        px, py = project(np.array([d[0] for d in disks]), np.array([d[1] for d in disks]))
        step = min(d[2] for d in disks) / resolution
        spans = [(math.floor((v - r) / step), math.ceil((v + r) / step) + 1) for v, (_, _, r) in zip(py, disks)]
        shapes = [_projected(text) for text in rows.column("polygons").to_pylist()]
        total, counts = 0, [0] * len(shapes)
        # Some lines of the grid at a time, so that a small disk beside a large one does not ask for all of its points at once.
        high = max(1, int(strip * step / sum(2 * d[2] + 2 * step for d in disks)))
        for low in range(min(a for a, _ in spans), max(b for _, b in spans), high):
            grid: list[np.ndarray] = []
            for x, y, (_, _, r), (a, b) in zip(px, py, disks, spans):
                gx = np.arange(math.floor((x - r) / step), math.ceil((x + r) / step) + 1)
                gy = np.arange(max(a, low), min(b, low + high))
                mx, my = np.meshgrid(gx, gy)
                hit = (mx * step - x) ** 2 + (my * step - y) ** 2 <= r * r
                grid.append(mx[hit] + 1j * my[hit])
            spots = np.unique(np.concatenate(grid))
            total += len(spots)
            xs, ys = spots.real * step, spots.imag * step
            for i, (flat, (west, south, east, north)) in enumerate(shapes):
                a, b = np.searchsorted(xs, west), np.searchsorted(xs, east, "right")
                between = (ys[a:b] >= south) & (ys[a:b] <= north)
                if between.any():
                    counts[i] += int(inside(xs[a:b][between], ys[a:b][between], flat).sum())
        name = rows.column("group_key")[0].as_py()
        out = [(name, unit, n / total) for unit, n in zip(rows.column("unit").to_pylist(), counts) if n > least * total]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

    return candidates.join(points, "group_key").groupBy("group_key").applyInArrow(masses, schema)


def interior_point(polygons: list) -> tuple[float, float]:
    """A point inside a multipolygon: the middle of the longest inner stretch of a horizontal line through its middle."""
    best = (-1.0, 0.0, 0.0)
    for part in polygons:
        ys = [p[1] for p in part[0]]
        y = (min(ys) + max(ys)) / 2
        if any(p[1] == y for ring in part for p in ring):
            y += (max(ys) - min(ys)) * 1e-6
        cuts = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for ring in part for (ax, ay), (bx, by) in zip(ring, ring[1:]) if (ay > y) != (by > y))
        for a, b in zip(cuts[::2], cuts[1::2]):
            best = max(best, (b - a, (a + b) / 2, y))
    return best[1], best[2]
