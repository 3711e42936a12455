"""Spatial joins as equi-joins on tiles, with the exact test as a residual.

A distance or overlap predicate alone is a nested loop; here both sides get tile keys so that any pair
that can satisfy the predicate shares one, and the planner has an equality to hash on.  The side that
is said to be searched is replicated to its neighbouring tiles; it isn't hinted, so a large one is
shuffled like any other.  Coordinates are metres (x, y).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from flowgrid.functions import geo
from flowgrid.session import ensure_checkpoint_dir


def _tiled(points: DataFrame, size: float) -> DataFrame:
    tx, ty = geo.tile_key(F.col("x"), F.col("y"), size)
    return points.withColumns({"tx": tx, "ty": ty})


def _replicated(points: DataFrame, size: float) -> DataFrame:
    """The searched side, in its own tile and the eight around it."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = _tiled(points, size).withColumn("around", around)
    return near.withColumns({"tx": F.col("tx") + F.col("around.dx"), "ty": F.col("ty") + F.col("around.dy")}).drop("around")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, *, key: str = "id", value: Sequence[str] = ()) -> DataFrame:
    """(key, r_id, distance, values) of all pairs of points at most so far apart."""
    r = right.select(F.col("id").alias("r_id"), "x", "y", *value)
    searched = _replicated(r, radius).withColumnsRenamed({"x": "rx", "y": "ry"})
    d = geo.distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))
    joined = _tiled(left.select(key, "x", "y"), radius).join(searched, ["tx", "ty"])
    return joined.withColumn("distance", d).where(F.col("distance") <= radius).select(key, "r_id", "distance", *value)


def nearest_capped(left: DataFrame, right: DataFrame, cap: float, name: str, *, key: str = "id") -> DataFrame:
    """left with the least distance to a point of right, null beyond the cap (or if there are none)."""
    best = pairs_within(left, right, cap, key=key).groupBy(key).agg(F.min("distance").alias(name))
    return left.join(best, key, "left")


def nearest_attribute(left: DataFrame, right: DataFrame, cap: float, value: str, *, key: str = "id") -> DataFrame:
    """left with the nearest point's id, value and distance, null beyond the cap (ties: the least id)."""
    best = pairs_within(left, right, cap, key=key, value=[value]).groupBy(key).agg(F.min(F.struct("distance", "r_id", value)).alias("n"))
    return left.join(best, key, "left").select(*left.columns, F.col("n.r_id").alias("nearest_id"), F.col(f"n.{value}").alias(value), F.col("n.distance").alias("distance"))


#: Tiles are halved so often at most.
HALVINGS = 20


def _levels(size: float, last: int, x: str = "x", y: str = "y") -> Column:
    """array<struct<level, tx, ty>>: a point's tiles of the size, half of it, and so on."""
    at = lambda level: geo.tile_key(F.col(x), F.col(y), size / 2**level)
    return F.array(*[F.struct(F.lit(n).alias("level"), at(n)[0].alias("tx"), at(n)[1].alias("ty")) for n in range(last + 1)])


def k_nearest(left: DataFrame, right: DataFrame, cap: float, k: int, *, key: str = "id") -> DataFrame:
    """The k nearest points within the cap, ranked (ties: the least id).

    Each tile of the left is searched at the smallest size at which it and the eight around it hold k
    points: all k nearest then lie within the farthest corner of those nine, which is less than three
    tiles away.  Where no size does, the cap is the tile.  One pass over the right finds the sizes.
    """
    finite = lambda c: F.abs(c) < float("inf")
    # Of the points at one place only the k least can be among the nearest.
    place = F.row_number().over(W.partitionBy("x", "y").orderBy("r_id"))
    sites = right.select(F.col("id").alias("r_id"), "x", "y").where(finite(F.col("x")) & finite(F.col("y"))).withColumn("n", place).where(F.col("n") <= k).drop("n")
    fullest = sites.select(F.inline(_levels(cap, HALVINGS))).groupBy("level", "tx", "ty").count().groupBy("level").agg(F.max("count").alias("n"))
    last = min([r.level + 1 for r in fullest.collect() if r.n <= k], default=HALVINGS)  # a row for each level

    tiled = sites.withColumnsRenamed({"x": "rx", "y": "ry"}).select("r_id", "rx", "ry", F.inline(_levels(cap, last, "rx", "ry")))
    near = lambda ring: F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1)])
    shifted = lambda name: (F.col("tx") + F.col(f"{name}.dx"), F.col("ty") + F.col(f"{name}.dy"))
    counts = tiled.where("level > 0").groupBy("level", "tx", "ty").agg(F.count("*").alias("n")).withColumn("at", F.explode(near(1)))
    ux, uy = shifted("at")
    full = counts.select("level", ux.alias("tx"), uy.alias("ty"), "n").groupBy("level", "tx", "ty").agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n")

    fx, fy = geo.tile_key(F.col("x"), F.col("y"), cap / 2**last)
    points = left.select(key, "x", "y").withColumns({"fx": fx, "fy": fy})
    # Sizes are halves of each other, so that a small tile's larger ones are shifts of its numbers.
    above = [F.expr(f"shiftright({c}, {last} - level)").alias(t) for c, t in (("fx", "tx"), ("fy", "ty"))]
    own = points.select("fx", "fy").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last)))).select("fx", "fy", "level", *above)
    chosen = own.join(full.withColumn("full", F.lit(True)), ["level", "tx", "ty"], "left").where("full OR level = 0").groupBy("fx", "fy").agg(F.max("level").alias("level")).select("fx", "fy", "level", *above)

    ring = F.when(F.col("level") == 0, near(1)).when(F.col("level") == 1, near(2)).otherwise(near(3))
    asked = chosen.select("level", "tx", "ty").distinct().withColumn("at", F.explode(ring))
    ux, uy = shifted("at")
    asked = asked.select("level", F.col("tx").alias("ox"), F.col("ty").alias("oy"), ux.alias("tx"), uy.alias("ty"))
    faced = asked.join(tiled, ["level", "tx", "ty"]).select("level", F.col("ox").alias("tx"), F.col("oy").alias("ty"), "r_id", "rx", "ry")

    size = F.lit(cap) / F.pow(F.lit(2.0), "level")
    corner = lambda c, t: size + F.greatest(F.col(c) - F.col(t) * size, (F.col(t) + 1) * size - F.col(c))
    reach = F.when(F.col("level") == 0, F.lit(cap)).otherwise(F.least(F.lit(cap), geo.distance(corner("x", "tx"), corner("y", "ty"), F.lit(0.0), F.lit(0.0)) * (1 + 1e-9)))
    placed = points.join(chosen, ["fx", "fy"]).withColumn("reach", reach).select(key, "x", "y", "level", "tx", "ty", "reach")
    # Few bytes make many pairs: both are shuffled, as a small side's file would else be one task or be sent to all.
    pairs = placed.hint("merge").join(faced, ["level", "tx", "ty"]).withColumn("distance", geo.distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry")))
    rank = F.row_number().over(W.partitionBy(key).orderBy("distance", "r_id"))
    return pairs.where(F.col("distance") <= F.col("reach")).select(key, "r_id", "distance").withColumn("rank", rank).where(F.col("rank") <= k)


def count_within(left: DataFrame, right: DataFrame, radius: float, name: str = "n", *, key: str = "id") -> DataFrame:
    """left with the number of points within the radius; 0 if none."""
    counts = pairs_within(left, right, radius, key=key).groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def within_bands(left: DataFrame, right: DataFrame, bands: Sequence[tuple[float, float]], name: str, *, key: str = "id") -> DataFrame:
    """left with the value of the first band (radius, value) that its nearest point is in; null outside all.

    Being inside the union of buffers is having the nearest point within the radius.
    """
    near = nearest_capped(left, right, max(r for r, _ in bands), "d", key=key)
    out = F.when(F.lit(False), 0.0)
    for radius, value in sorted(bands):
        out = out.when(F.col("d") <= radius, float(value))
    return near.withColumn(name, out).drop("d")


def _box_tiles(box: Column, size: float, margin: float = 0.0) -> Column:
    """Tiles that a bounding box, with a margin, touches."""
    at = lambda c, m: F.floor((box[c] + m) / size).cast("bigint")
    column = lambda tx: F.transform(F.sequence(at("y0", -margin), at("y1", margin)), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))
    return F.flatten(F.transform(F.sequence(at("x0", -margin), at("x1", margin)), column))


def _tiled_polygons(polygons: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    boxed = polygons.withColumn("box", geo.bounds(F.col("polygon")))
    return boxed.withColumn("tile", F.explode(_box_tiles(F.col("box"), size, margin))).select("zone", "polygon", "box", F.col("tile.tx").alias("tx"), F.col("tile.ty").alias("ty"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, *, size: float = 20_000.0, key: str = "id") -> DataFrame:
    """points with the zone that holds them (the least, should several), null if none does."""
    box = (F.col("x") >= F.col("box.x0")) & (F.col("x") <= F.col("box.x1")) & (F.col("y") >= F.col("box.y0")) & (F.col("y") <= F.col("box.y1"))
    hits = _tiled(points.select(key, "x", "y"), size).join(_tiled_polygons(polygons, size), ["tx", "ty"]).where(box & geo.contains(F.col("polygon"), F.col("x"), F.col("y")))
    return points.join(hits.groupBy(key).agg(F.min("zone").alias("zone")), key, "left")


def nearest_shape(points: DataFrame, shapes: DataFrame, cap: float, name: str, *, lines: bool = False, key: str = "id") -> DataFrame:
    """points with the least distance to a polygon (0 inside) or a line, null beyond the cap; shapes have zone and polygon."""
    measure = geo.line_distance(F.get("polygon", F.lit(0)), F.col("x"), F.col("y")) if lines else geo.polygon_distance(F.col("polygon"), F.col("x"), F.col("y"))
    near = _tiled(points.select(key, "x", "y"), cap).join(_tiled_polygons(shapes, cap, cap), ["tx", "ty"])
    best = near.withColumn("d", measure).where(F.col("d") <= cap).groupBy(key).agg(F.min("d").alias(name))
    return points.join(best, key, "left")


def clip_area(polygon: list, ring: list) -> float:
    """Area of a polygon (shell and holes) inside a convex counter-clockwise ring: each ring is clipped edge by edge."""

    def clipped(subject: list[tuple[float, float]]) -> float:
        points = subject
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in points]
            kept = []
            for i, (p, s) in enumerate(zip(points, side, strict=True)):
                q, t = points[i - 1], side[i - 1]
                if (s >= 0) != (t >= 0):
                    f = t / (t - s)
                    kept.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
                if s >= 0:
                    kept.append(p)
            points = kept
            if not points:
                return 0.0
        return abs(sum(x * v - u * y for (x, y), (u, v) in zip(points, points[1:] + points[:1], strict=True))) / 2

    shell, *holes = [clipped(r) for r in polygon]
    return max(0.0, shell - sum(holes))


#: Square metres below which a clip along a shared edge is rounding (1e-11 is usual), not overlap.
SLIVER = 1e-6


def overlap_areas(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs (polygon, ring and others) with the area of their overlap in place of both, where it is above the least.

    A polygon clip is a loop that column expressions can't express: an Arrow batch function.
    """
    import pyarrow as pa

    kept = [c for c in pairs.columns if c not in ("polygon", "ring")]

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pts = lambda ring: [(p["x"], p["y"]) for p in ring]
        for b in batches:
            areas = [clip_area([pts(r) for r in poly], pts(ring)) for poly, ring in zip(b.column("polygon").to_pylist(), b.column("ring").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(areas, pa.float64())], names=[*kept, "overlap"])

    schema = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in kept] + [T.StructField("overlap", T.DoubleType())])
    return pairs.mapInArrow(overlap, schema).where(F.col("overlap") > least)


def _valid(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("polygon", geo.valid_rings(F.col("polygon"))).where(F.size("polygon") > 0)


def _shares(parts: DataFrame, valid: DataFrame) -> DataFrame:
    """(zone, cell, weight): overlaps as shares of the zone's own area, all its polygons together."""
    whole = valid.groupBy("zone").agg(F.sum(geo.area(F.col("polygon"))).alias("area"))
    return parts.join(whole, "zone").select("zone", "cell", (F.col("overlap") / F.when(F.col("area") > 0, F.col("area"))).alias("weight"))


def overlay_weights(polygons: DataFrame, cells: DataFrame, *, size: float = 20_000.0) -> DataFrame:
    """(zone, cell, weight): each zone's share of area in each cell (cell, ring: convex, counter-clockwise).

    Shares are of the zone's own area, so that they sum to less than 1 where cells don't cover it.
    """
    boxed = cells.withColumn("cbox", geo.bounds(F.array("ring")))
    tiled = boxed.withColumn("tile", F.explode(_box_tiles(F.col("cbox"), size))).select("cell", "ring", "cbox", F.col("tile.tx").alias("tx"), F.col("tile.ty").alias("ty"))
    touch = (F.col("box.x0") <= F.col("cbox.x1")) & (F.col("cbox.x0") <= F.col("box.x1")) & (F.col("box.y0") <= F.col("cbox.y1")) & (F.col("cbox.y0") <= F.col("box.y1"))
    # A pair that shares several tiles is kept in the first of them only.
    first = (F.floor(F.greatest("box.x0", "cbox.x0") / size) == F.col("tx")) & (F.floor(F.greatest("box.y0", "cbox.y0") / size) == F.col("ty"))
    valid = _valid(polygons)
    pairs = _tiled_polygons(valid, size).join(tiled, ["tx", "ty"]).where(touch & first)
    areas = overlap_areas(pairs.select("zone", "cell", "polygon", "ring"))
    return _shares(areas.groupBy("zone", "cell").agg(F.sum("overlap").alias("overlap")), valid)


def _box_cells(polygons: DataFrame) -> DataFrame:
    """(zone, polygon, q, r): lattice cells that a polygon's box touches."""
    boxed = polygons.withColumn("b", geo.bounds(F.col("polygon")))
    axes = boxed.withColumn("c", F.explode(geo.cells_in_box(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"))))
    return axes.select("zone", "polygon", F.col("c.q").alias("q"), F.col("c.r").alias("r"))


def _hex_overlaps(valid: DataFrame) -> DataFrame:
    """(zone, q, r, overlap): area that each zone shares with each lattice cell, where it is more than a sliver."""
    pairs = _box_cells(valid).withColumn("ring", geo.cell_ring(F.col("q"), F.col("r")))
    return overlap_areas(pairs, SLIVER).groupBy("zone", "q", "r").agg(F.sum("overlap").alias("overlap"))


def hex_cover(polygons: DataFrame, *, full: bool = True) -> DataFrame:
    """(zone, cell, q, r, ring): lattice cells that share area with a zone (full), or whose centres its polygons hold."""
    q, r = F.col("q"), F.col("r")
    if full:
        cells = _hex_overlaps(_valid(polygons))
    else:
        cells = _box_cells(polygons).where(geo.contains(F.col("polygon"), *geo.cell_center(q, r)))
    return cells.select("zone", geo.cell_id(q, r).alias("cell"), "q", "r", geo.cell_ring(q, r).alias("ring"))


def hex_crosswalk(polygons: DataFrame) -> DataFrame:
    """Zones' weights over all lattice cells that they share area with."""
    valid = _valid(polygons)
    return _shares(_hex_overlaps(valid).withColumn("cell", geo.cell_id(F.col("q"), F.col("r"))), valid)


def cell_counts(points: DataFrame) -> DataFrame:
    """(cell, n, per_km2): points by lattice cell."""
    counts = points.groupBy(geo.cell_of(F.col("x"), F.col("y")).alias("cell")).agg(F.count("*").alias("n"))
    return counts.withColumn("per_km2", F.col("n") / (geo.CELL_AREA / 1e6))


def zonal_mean(pixels: DataFrame, nodata: Sequence[float] = (255.0,), least: float | None = None) -> DataFrame:
    """(cell, mean, pixels) of pixel values (x, y, value) by the cell of their centre, without nodata and NaN."""
    v = F.col("value")
    good = v.isNotNull() & ~F.isnan(v) & (v > -3.0e38) & ~v.isin(*nodata)
    v = F.greatest(v, F.lit(least)) if least is not None else v
    return pixels.where(good).groupBy(geo.cell_of(F.col("x"), F.col("y")).alias("cell")).agg(F.avg(v).alias("mean"), F.count("*").alias("pixels"))


def composite_median(pixels: DataFrame, gain: float = 0.00341802, offset: float = 149.0) -> DataFrame:
    """(x, y, celsius): median over time of scaled surface temperatures, without the fill value 0."""
    kelvin = F.col("value") * gain + offset
    return pixels.where("value <> 0").groupBy("x", "y").agg(F.median(kelvin - 273.15).alias("celsius"))


def baseline_delta(frame: DataFrame, value: str, name: str, quantile: float = 0.25) -> DataFrame:
    """frame with the value's difference from a quantile of all rows."""
    base = frame.agg(F.percentile(value, F.lit(quantile)).alias("base"))
    return frame.join(F.broadcast(base)).withColumn(name, F.col(value) - F.col("base")).drop("base")  # one row


def raster_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, value): the difference of two rasters on one grid."""
    return a.join(b.withColumnRenamed("value", "other"), ["x", "y"]).select("x", "y", (F.col("value") - F.col("other")).alias("value"))


def _least_reachable(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the least id that links (id, other; in both directions) reach from each id. Labels spread until they rest."""
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        spread = links.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("beside"))
        least = labels.join(spread, "id", "left").select("id", F.col("label").alias("before"), F.least("label", "beside").alias("least"))
        # A label's own label is followed as well, so that chains shorten by half each round.
        hop = labels.select(F.col("id").alias("least"), F.col("label").alias("further"))
        after = least.join(hop, "least").select("id", "before", F.least("least", "further").alias("label")).checkpoint()
        labels = after.select("id", "label")
        if after.where("label <> before").isEmpty():
            return labels


def cluster_points(points: DataFrame, radius: float, least: int) -> DataFrame:
    """Density clusters (DBSCAN): (id, cluster), the cluster being its least core id; noise has null.

    Core points have at least so many points (themselves included) within the radius; a point that isn't
    core joins the cluster of its least core neighbour.  All points of a tile lie within the radius of each
    other, so that a tile of so many points is core as a whole, and core points of one tile are in one
    cluster.  Only points of other tiles are compared with their neighbours, and two tiles' core points only
    where neither their outermost points nor other tiles link them.
    """
    ensure_checkpoint_dir(points.sparkSession)
    size = radius / math.sqrt(2) * (1 - 1e-9)
    finite = lambda c: F.abs(c) < float("inf")
    apart = lambda a, b: geo.distance(F.col(f"{a}.x"), F.col(f"{a}.y"), F.col(f"{b}.x"), F.col(f"{b}.y"))
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    shifts = lambda pairs: F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in pairs]))

    def shifted(frame: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
        moved = frame.withColumn("to", shifts(pairs))
        return moved.withColumns({"tx": F.col("tx") + F.col("to.dx"), "ty": F.col("ty") + F.col("to.dy")}).drop("to")

    # NaN's tile would be that of 0: a point without a place has no tile, and is noise.
    placed = finite(F.col("x")) & finite(F.col("y"))
    tiled = _tiled(points.select("id", "x", "y"), size).withColumns({t: F.when(placed, F.col(t)) for t in ("tx", "ty")})
    sites = tiled.where(placed).groupBy("tx", "ty", "x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")).checkpoint()
    tiles = sites.groupBy("tx", "ty").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    dense = tiles.where(F.col("n") >= least).select("tx", "ty")
    # Tiles with fewer points: each of their points meets all points of the 25 tiles around it.
    loose = sites.join(tiles.where(F.col("n") < least).select("tx", "ty"), ["tx", "ty"], "left_semi")
    point = F.struct("x", "y")
    asking = lambda frame: shifted(frame.select("tx", "ty", "id", point.alias("p")), offsets)
    facing = lambda frame, value: frame.select("tx", "ty", point.alias("q"), value)
    counted = asking(loose).join(facing(sites, "n"), ["tx", "ty"]).where(apart("p", "q") <= radius).groupBy("id").agg(F.sum("n").alias("n"))
    alone = counted.where(F.col("n") >= least).select("id").checkpoint()
    core = sites.join(dense, ["tx", "ty"], "left_semi").unionByName(loose.join(alone, "id", "left_semi").select(*sites.columns)).drop("n").checkpoint()

    # A tile with core points goes by the least of them; its outermost points stand for it first.
    turns = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    ends = F.array(*[f(point, t) for t in turns for f in (F.min_by, F.max_by)])
    box = F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    nodes = core.groupBy("tx", "ty").agg(F.min("id").alias("id"), ends.alias("ends"), box.alias("box")).checkpoint()
    named = lambda a: nodes.select("tx", "ty", F.struct("id", "tx", "ty", "ends", "box").alias(a))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a.box.{c}0") - F.col(f"b.box.{c}1"), F.col(f"b.box.{c}0") - F.col(f"a.box.{c}1"))
    met = F.exists("a.ends", lambda p: F.exists("b.ends", lambda q: geo.distance(p["x"], p["y"], q["x"], q["y"]) <= radius))
    beside = shifted(named("a"), [o for o in offsets if o > (0, 0)]).join(named("b"), ["tx", "ty"]).select("a", "b")
    beside = beside.where(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= radius).withColumn("met", met).checkpoint()
    both = lambda pairs: pairs.select("id", "other").unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))
    labels = _least_reachable(nodes, both(beside.where("met").select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))).checkpoint())

    # Pairs of tiles that are still apart: their core points are compared, as far as they are near the other's box.
    of = lambda a: labels.select(F.col("id").alias(f"{a}_id"), F.col("label").alias(a))
    flat = beside.where("NOT met").select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("id", "tx", "ty", "box")])
    open_pairs = flat.join(of("a"), "a_id").join(of("b"), "b_id").where("a <> b")
    outside = lambda c, s: F.greatest(F.lit(0.0), F.col(f"{s}_box.{c}0") - F.col(c), F.col(c) - F.col(f"{s}_box.{c}1"))
    near_box = lambda s: F.sqrt(outside("x", s) * outside("x", s) + outside("y", s) * outside("y", s)) <= radius
    members = lambda s: core.select(F.col("tx").alias(f"{s}_tx"), F.col("ty").alias(f"{s}_ty"), "x", "y")
    sided = lambda s, t, name: open_pairs.join(members(s), [f"{s}_tx", f"{s}_ty"]).where(near_box(t)).select("a_id", "b_id", "a", "b", point.alias(name))
    touching = sided("a", "b", "p").join(sided("b", "a", "q").drop("a", "b"), ["a_id", "b_id"]).where(apart("p", "q") <= radius)
    more = touching.select(F.col("a").alias("id"), F.col("b").alias("other")).distinct().checkpoint()
    if not more.isEmpty():
        whole = _least_reachable(labels.select(F.col("label").alias("id")).distinct(), both(more).checkpoint())
        labels = labels.join(whole.withColumnsRenamed({"id": "label", "label": "cluster"}), "label").select("id", F.col("cluster").alias("label")).checkpoint()
    of_tile = nodes.select("tx", "ty", "id").join(labels, "id").select("tx", "ty", "label")

    fringe = loose.join(alone, "id", "left_anti")
    shore = core.join(of_tile, ["tx", "ty"])
    border = asking(fringe).join(facing(shore, "label"), ["tx", "ty"]).where(apart("p", "q") <= radius).groupBy("p").agg(F.min("label").alias("beside"))
    inside = loose.join(alone, "id", "left_semi").join(of_tile, ["tx", "ty"]).select("x", "y", F.col("label").alias("beside"))
    single = inside.unionByName(border.select("p.x", "p.y", "beside"))
    out = tiled.join(of_tile.join(dense, ["tx", "ty"], "left_semi"), ["tx", "ty"], "left").join(single, ["x", "y"], "left")
    return out.select("id", F.coalesce("label", "beside").alias("cluster"))


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, ring): each group's convex hull. Each batch of a task is reduced to hulls, whose corners then meet."""
    import pandas as pd

    def hull(p: list[tuple[float, float]]) -> list[tuple[float, float]]:
        p = sorted(set(p))
        if len(p) < 3:
            return p

        def half(q):
            out: list[tuple[float, float]] = []
            for x, y in q:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                    out.pop()
                out.append((x, y))
            return out[:-1]

        return half(p) + half(p[::-1])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, g in b.groupby("k", dropna=False):
                yield pd.DataFrame([(k, x, y) for x, y in hull(list(zip(g["x"], g["y"], strict=True)))], columns=["k", "x", "y"])

    def final(k, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [k[0]], "ring": [[{"x": x, "y": y} for x, y in hull(list(zip(g["x"], g["y"], strict=True)))]]})

    corners = points.select(F.col(key).cast("string").alias("k"), "x", "y").mapInPandas(partial, "k string, x double, y double")
    return corners.groupBy("k").applyInPandas(final, "k string, ring array<struct<x:double,y:double>>").withColumnRenamed("k", key)
