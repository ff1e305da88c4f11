"""Points and polygons: equi joins on grid cells, then the exact test, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators import ranking


def area(ring: Column) -> Column:
    """The area of a ring."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    twice = F.aggregate(F.arrays_zip(ring.alias("a"), after.alias("b")), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(twice) / 2


def _side(ring: Column, c: str) -> Column:
    return F.transform(ring, lambda p: p[c])


def cell_of(x: Column, y: Column, step: float) -> Column:
    return F.struct(F.floor(y / step).alias("r"), F.floor(x / step).alias("c"))


def _edges(rings: Column) -> Column:
    """The edges (a, b) of all rings of a polygon."""
    return F.flatten(F.transform(rings, lambda ring: F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))))


def _crossed(edges: Column, x: Column, y: Column) -> Column:
    """Whether an odd number of edges is crossed to a point's right."""
    crossed = F.filter(
        edges,
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a polygon of rings: an odd number of edges of all rings is crossed, so holes are outside and parts add up."""
    return _crossed(_edges(rings), x, y)


def _distance(edges: Column, x: Column, y: Column) -> Column:
    def squared(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / length))).otherwise(0.0)
        px, py = e["a"]["x"] + t * dx - x, e["a"]["y"] + t * dy - y
        return px * px + py * py

    return F.sqrt(F.array_min(F.transform(edges, squared)))


def edge_distance(rings: Column, x: Column, y: Column) -> Column:
    """The distance from a point to the nearest edge: to the foot of its perpendicular, cut to the edge's ends."""
    return _distance(_edges(rings), x, y)


#: A cell's half diagonal as a share of its side, and a little more.
HALF_DIAGONAL = 0.7072


def listed_in_cells(polygons: DataFrame, order: list[str], step: float, reach: float = 0.0) -> DataFrame:
    """(order, _edges, _box, _cell): polygons (order, rings) in the grid cells of ``step`` that their box, wider by ``reach``, touches.

    Polygons are told apart by ``order``, the first of those that contain a point
    being its answer.  So of polygons with the same rings only the first is
    listed, and in a cell that one covers as a whole none that comes after it: how
    many lie over each other doesn't count.  A cell is covered if its centre is
    inside and no edge is as near as its corners.  Polygons without points are left out.
    """
    one = polygons.filter(F.size(F.flatten("rings")) > 0).groupBy("rings").agg(F.min(F.struct(*order)).alias("_first"))
    points = F.flatten("rings")
    box = F.struct(*(f(_side(points, c)).alias(f"{n}{c}") for n, f in (("low", F.array_min), ("high", F.array_max)) for c in "xy"))
    one = one.select("_first", _edges(F.col("rings")).alias("_edges"), box.alias("_box"))
    at = {c: F.sequence(F.floor((F.col(f"_box.low{c}") - reach) / step), F.floor((F.col(f"_box.high{c}") + reach) / step)) for c in "xy"}
    cells_ = F.flatten(F.transform(at["y"], lambda r: F.transform(at["x"], lambda c: F.struct(r.alias("r"), c.alias("c")))))
    listed = one.withColumn("_cell", F.explode(cells_))
    x, y = (F.col("_cell.c") + 0.5) * step, (F.col("_cell.r") + 0.5) * step
    covers = _crossed(F.col("_edges"), x, y) & (_distance(F.col("_edges"), x, y) > HALF_DIAGONAL * step)
    least = F.min(F.when(covers, F.col("_first"))).over(Window.partitionBy("_cell"))
    listed = listed.withColumn("_least", least).filter(F.col("_least").isNull() | (F.col("_first") <= F.col("_least")))
    return listed.select("_first.*", "_edges", "_box", "_cell")


def _met(points: DataFrame, listed: DataFrame, step: float, reach: float = 0.0) -> DataFrame:
    """Points (point, x, y) with the polygons of their cell whose box, wider by ``reach``, they lie in.

    A point is a few bytes and meets many edges, so points are dealt out by
    themselves: a small file would otherwise be one task.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = points.repartition(parts, "point").withColumn("_cell", cell_of(F.col("x"), F.col("y"), step))
    within = lambda c: F.col(c).between(F.col(f"_box.low{c}") - reach, F.col(f"_box.high{c}") + reach)
    return at.join(listed, "_cell").filter(within("x") & within("y"))


def smallest_containing(points: DataFrame, polygons: DataFrame, step: float) -> DataFrame:
    """(point columns, polygon, area): the smallest polygon (polygon, ring) that contains each point (point, x, y); ties to the least polygon.

    ``step`` is a cell's side, about a polygon's size: a polygon is listed in the
    cells that its box touches, a point in its own.
    """
    listed = listed_in_cells(polygons.select("polygon", F.array("ring").alias("rings"), area(F.col("ring")).alias("area")), ["area", "polygon"], step)
    met = _met(points, listed, step).filter(_crossed(F.col("_edges"), F.col("x"), F.col("y")))
    return ranking.latest(met.select(*points.columns, "polygon", "area"), ["point"], [F.asc("area"), F.asc("polygon")])


def building_at(points: DataFrame, buildings: DataFrame, reach: float, step: float | None = None) -> DataFrame:
    """(point columns, match, distance, building, size): the building that each point (point, x, y) is in, or else near.

    ``buildings`` (building, rings, size): rings are arrays of (x, y), a part's
    outline or a hole.  ``inside``: the smallest that contains the point;
    ``near``: of those whose edge is at most ``reach`` away the nearest, of equal
    ones the smaller; ``none``: every other point.  Ties go to the least building.
    A building without rings, and a point without coordinates, meet nothing.
    A building is listed in the cells of ``step`` that it can be reached from, a
    point in its own, so each pair meets once and no pair meets in vain twice.
    """
    step = step or 4 * reach
    edges, x, y = F.col("_edges"), F.col("x"), F.col("y")
    spot = lambda out, d: F.struct(F.lit(out).alias("out"), d.cast("double").alias("d"), "size", "building")
    # The distance is bound once, and sought only where the point isn't inside.
    near = F.transform(F.array(_distance(edges, x, y)), lambda d: F.when(d <= reach, spot(True, d)))[0]
    met = _met(points, listed_in_cells(buildings, ["size", "building"], step, reach), step, reach)
    best = met.groupBy("point").agg(F.min(F.when(_crossed(edges, x, y), spot(False, F.lit(None))).otherwise(near)).alias("_best"))
    out = points.join(best, "point", "left")
    kind = F.when(F.col("_best").isNull(), "none").when(F.col("_best.out"), "near").otherwise("inside")
    return out.select(*points.columns, kind.alias("match"), F.col("_best.d").alias("distance"), F.col("_best.building").alias("building"), F.col("_best.size").alias("size"))


def boxes(points: DataFrame, gap: float, side: float | None = None) -> DataFrame:
    """(south, west, north, east, points) of points (lat, lon): boxes that no gap wider than ``gap`` crosses in either direction.

    Points are first gathered in cells of ``side`` (``gap`` / 4), with the extent of
    what lies in each.  There are at most 360 * 180 / side^2 cells, whatever the
    number of points, and a gap lies between cells; so sorting the cells of a
    group in one task is bounded.  Groups are split in both directions in turn
    until none is.  Points without both coordinates are left out.
    """
    from rosterlake.plans.session import checkpointed

    side = side or gap / 4
    cell = points.filter("lat is not null and lon is not null").groupBy(F.floor(F.col("lat") / side).alias("r"), F.floor(F.col("lon") / side).alias("c")).agg(
        F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"), F.count("*").alias("points")
    )
    now = checkpointed(cell.select(F.array().cast("array<int>").alias("group"), "south", "west", "north", "east", "points"))
    groups = -1
    while True:
        for low, high in (("west", "east"), ("south", "north")):
            before = Window.partitionBy("group").orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
            opens = F.coalesce((F.col(low) - F.max(high).over(before) > gap).cast("int"), F.lit(0))
            part = F.sum("_new").over(Window.partitionBy("group").orderBy(low, high).rowsBetween(Window.unboundedPreceding, 0)).cast("int")
            now = now.withColumn("_new", opens).withColumn("_part", part).withColumn("group", F.array_append("group", F.col("_part"))).drop("_new", "_part")
        now = checkpointed(now)
        found = now.select("group").distinct().count()
        if found == groups:
            break
        groups = found
    return now.groupBy("group").agg(F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east"), F.sum("points").alias("points")).drop("group")
