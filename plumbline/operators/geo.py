"""Points and polygons through grid cells: no point is ever compared with a polygon outside its cell.

Boundaries are rows (poly_id, part, iso_a2, name, rings), a ring being a closed array of (lon, lat) with the
shell first. They are cut into horizontal bands of one cell's height. A point needs only the edges of
its own band, because a horizontal ray meets no other edge, so the test stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sizing import is_small
from plumbline.operators.skew import hot_keys, left_join_hot


METRES_PER_DEGREE = 111_195.0


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("int")


def bands(boundaries: DataFrame, cell: float = 1.0, shell_only: bool = False, buffer_m: float = 0.0) -> DataFrame:
    """(poly_id, part, iso_a2, band, edges, min_x, max_x): the edges of each polygon part per band.

    With a buffer, edges also count for the bands within that distance.
    """
    pad = buffer_m / METRES_PER_DEGREE
    rings = F.slice("rings", 1, 1) if shell_only else F.col("rings")
    ring_rows = boundaries.select("poly_id", "part", "iso_a2", F.explode(rings).alias("ring"))
    pairs = F.arrays_zip(
        F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"),
        F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"),
    )
    edges = ring_rows.filter(F.size("ring") > 1).select("poly_id", "part", "iso_a2", F.explode(pairs).alias("e")).select(
        "poly_id", "part", "iso_a2",
        F.struct(F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"),
                 F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2")).alias("e"),
    )
    low, high = F.least("e.y1", "e.y2") - pad, F.greatest("e.y1", "e.y2") + pad
    return (
        edges.withColumn("band", F.explode(F.sequence(_cell(low, cell), _cell(high, cell))))
        .groupBy("poly_id", "part", "iso_a2", "band")
        .agg(F.collect_list("e").alias("edges"), F.min(F.least("e.x1", "e.x2")).alias("min_x"),
             F.max(F.greatest("e.x1", "e.x2")).alias("max_x"))
    )


def _inside(x: Column, y: Column, edges: Column) -> Column:
    """Ray casting over the edges of the band; a point on an edge is inside."""
    def cross(e: Column) -> Column:
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])

    touches = F.exists(edges, lambda e: (
        (cross(e) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))))
    crossed = F.aggregate(edges, F.lit(False), lambda odd, e: F.when(
        ((e["y1"] > y) != (e["y2"] > y)) & (cross(e) * F.signum(e["y2"] - e["y1"]) > 0), ~odd).otherwise(odd))
    return touches | crossed


def _nearest_m(x: Column, y: Column, edges: Column) -> Column:
    """Distance in metres to the nearest edge, on a plane scaled at the point's latitude."""
    kx, ky = F.cos(F.radians(y)) * METRES_PER_DEGREE, F.lit(METRES_PER_DEGREE)

    def distance(e: Column) -> Column:
        ax, ay = (e["x1"] - x) * kx, (e["y1"] - y) * ky
        dx, dy = (e["x2"] - e["x1"]) * kx, (e["y2"] - e["y1"]) * ky
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(-(ax * dx + ay * dy), length)))).otherwise(0.0)
        px, py = ax + t * dx, ay + t * dy
        return F.sqrt(px * px + py * py)

    return F.array_min(F.transform(edges, distance))


def point_hits(points: DataFrame, boundaries: DataFrame, lat: str = "lat", lon: str = "lon", cell: float = 1.0,
               shell_only: bool = False, buffer_m: float = 0.0, radius: str | None = None) -> DataFrame:
    """(lat, lon, poly_id, iso_a2) for every distinct point and polygon that contains or covers it.

    ``radius`` names a column of ``points`` with a distance in metres for each row, which is then part of the answer: see :func:`_hits_within`.

    Points are made distinct first, so a location that holds most of the rows is tested once. The first
    join is on the cell and carries no geometry; the second fetches one band of one polygon part.
    """
    strips = bands(boundaries, cell, shell_only, buffer_m)
    pad = buffer_m / METRES_PER_DEGREE
    widest = F.least(F.lit(89.0), F.greatest(F.abs(F.col("band") * cell), F.abs((F.col("band") + 1) * cell)))
    pad_x = F.lit(pad) / F.cos(F.radians(widest))
    cells = strips.select(
        "poly_id", "part", "band",
        F.explode(F.sequence(_cell(F.col("min_x") - pad_x, cell), _cell(F.col("max_x") + pad_x, cell))).alias("cx"),
    )
    x, y = F.col("__x"), F.col("__y")
    distinct = (
        points.select(F.col(lat).cast("double").alias("__y"), F.col(lon).cast("double").alias("__x"))
        .filter(y.between(-90, 90) & x.between(-180, 180)).distinct()
    )
    if radius is not None:
        return _hits_within(points, strips, lat, lon, radius, cell)
    found = (
        distinct.withColumn("cx", _cell(x, cell)).withColumn("band", _cell(y, cell))
        .join(cells, ["cx", "band"])
        .join(strips.select("poly_id", "part", "band", "iso_a2", "edges"), ["poly_id", "part", "band"])
    )
    hit = _inside(x, y, F.col("edges"))
    if buffer_m > 0:
        hit = hit | (_nearest_m(x, y, F.col("edges")) <= buffer_m)
    return found.filter(hit).select(y.alias(lat), x.alias(lon), "poly_id", "iso_a2").distinct()


def _hits_within(points: DataFrame, strips: DataFrame, lat: str, lon: str, radius: str, cell: float) -> DataFrame:
    """(lat, lon, radius, poly_id, iso_a2) of every distinct point and polygon part within the point's own distance.

    Each point is dealt to the ring of cells that its own distance reaches, so a point without a buffer meets one cell and one with a
    wide buffer many, and the polygons' cells are the same for all. In its own band a point is inside or near; in the others it can only be near.
    """
    x, y, r = F.col("__x"), F.col("__y"), F.col("__r")
    distinct = (
        points.select(F.col(lat).cast("double").alias("__y"), F.col(lon).cast("double").alias("__x"), F.col(radius).cast("double").alias("__r"))
        .filter(y.between(-90, 90) & x.between(-180, 180) & (r >= 0)).distinct()
    )
    pad = F.least(r / METRES_PER_DEGREE, F.lit(180.0))
    # distances are measured on a plane scaled at the point's own latitude, and so is the ring
    pad_x = F.least(pad / F.greatest(F.cos(F.radians(y)), F.lit(1e-3)), F.lit(360.0))
    ring = (
        distinct.withColumn("band", F.explode(F.sequence(_cell(y - pad, cell), _cell(y + pad, cell))))
        .withColumn("cx", F.explode(F.sequence(_cell(x - pad_x, cell), _cell(x + pad_x, cell))))
    )
    cells = strips.select("poly_id", "part", "band", F.explode(F.sequence(_cell(F.col("min_x"), cell), _cell(F.col("max_x"), cell))).alias("cx"))
    met = ring.join(cells, ["band", "cx"]).select("__x", "__y", "__r", "poly_id", "part", "band").distinct()
    found = met.join(strips.select("poly_id", "part", "band", "iso_a2", "edges"), ["poly_id", "part", "band"])
    inside = (F.col("band") == _cell(y, cell)) & _inside(x, y, F.col("edges"))
    near = (r > 0) & (_nearest_m(x, y, F.col("edges")) <= r)
    return found.filter(inside | near).select(y.alias(lat), x.alias(lon), r.alias(radius), "poly_id", "iso_a2").distinct()


def point_countries(points: DataFrame, boundaries: DataFrame, lat: str = "lat", lon: str = "lon", **how) -> DataFrame:
    """(lat, lon, codes): the country codes a distinct point lies in, in polygon order; with a ``radius`` column, per point and distance."""
    hits = point_hits(points, boundaries, lat, lon, **how)
    ordered = F.array_sort(F.collect_set(F.struct("poly_id", "iso_a2")))
    return hits.groupBy(lat, lon, *([how["radius"]] if how.get("radius") else [])).agg(F.array_distinct(F.transform(ordered, lambda h: h["iso_a2"])).alias("codes"))


def point_country(df: DataFrame, boundaries: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "iso_a2",
                  **how) -> DataFrame:
    """Add the country code of each point, null outside every polygon; of several the first polygon counts.

    Answers go back to the rows by a join that keeps hot locations apart.
    """
    keyed = df.withColumn("__lat", df[lat].cast("double")).withColumn("__lon", df[lon].cast("double"))
    keys = ["__lat", "__lon"]
    hits = point_hits(keyed, boundaries, *keys, **how).groupBy(*keys).agg(F.min_by("iso_a2", "poly_id").alias(out))
    if is_small(hits):
        return keyed.join(F.broadcast(hits), keys, "left").drop(*keys)
    return left_join_hot(keyed, hits, keys, hot_keys(keyed, keys)).drop(*keys)


def point_near(df: DataFrame, boundaries: DataFrame, metres: float, lat: str = "lat", lon: str = "lon", **how) -> DataFrame:
    """:func:`point_countries` with a distance buffer around every polygon."""
    return point_countries(df, boundaries, lat, lon, buffer_m=float(metres), **how)


def point_country_grid(df: DataFrame, boundaries: DataFrame, lat: str = "lat", lon: str = "lon", size: float = 0.1,
                       out: str = "iso_a2", **how) -> DataFrame:
    """One answer per grid cell: the country of the cell's centre, given to every point in the cell."""
    g = F.lit(float(size))
    mid = df.withColumn("__clat", F.floor(F.col(lat).cast("double") / g) * g + g / 2).withColumn(
        "__clon", F.floor(F.col(lon).cast("double") / g) * g + g / 2)
    return point_country(mid, boundaries, "__clat", "__clon", out, **how).drop("__clat", "__clon")


