"""Pairs of points within a radius: a range self-join as an equi-join on grid cells.

Points are put on the sphere in three dimensions, so the date line and the poles are like any other place. Cells are
cubes as wide as the chord of the radius; a row meets the rows of its own cell and of the 26 around it, each pair once,
by spreading one side over half of those neighbours that the sphere passes through. All variants give the same pairs; `method` picks how candidates are found.

A cell is the key of a shuffled join, so a dense place (a port, an anchorage) is a large partition that adaptive
execution splits. `by` columns (a minute, say) are part of the key: many snapshots are searched as one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.stages import durable, running

METHODS = ("grid", "latitude", "brute", "tree")
#: Points that the tree's splits are fitted on, and its depth.
SPLIT_SAMPLE, DEPTH = 10_000, 5
#: Rows of a cell that one task compares with what is near, and the block of pairs looked at together.
CELL_ROWS, BLOCK = 8192, (64, 512)
#: Pairs that leave a task's comparison at once.
GATHERED = 16_384


def _placed(points: DataFrame, id_col: str, by: list[str], carry: list[str]) -> DataFrame:
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"))
    row = F.struct(F.col(id_col).alias("id"), "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"), *carry)
    return points.select(*by, row.alias("p"))


def _cell(axis: str, side: float) -> Column:
    return F.floor(F.col(f"p.{axis}") / side).cast("long")


def half_neighbours(dimensions: int) -> list[tuple[int, ...]]:
    """The zero offset and one of each two opposite offsets to a neighbouring cell."""
    every = list(product((-1, 0, 1), repeat=dimensions))
    return every[len(every) // 2 :]


def _met(placed: DataFrame, by: list[str], axes: str, side: float) -> DataFrame:
    """Rows (by..., a, b) whose cells on the axes are the same or neighbours, each pair of rows once.

    Left rows are in their own cell, right rows in theirs and in half of its neighbours; of two cells only one is
    among the other's half.
    """
    names = [f"c{axis}" for axis in axes]
    own = placed.select("*", *(_cell(axis, side).alias(n) for axis, n in zip(axes, names, strict=True)))
    offsets = F.array(*(F.struct(*(F.lit(d).alias(n) for n, d in zip(names, o, strict=True))) for o in half_neighbours(len(names))))
    spread = own.withColumn("o", F.explode(offsets))
    if len(names) == 3:  # cubes that the sphere doesn't pass through hold nothing
        middle = sum(F.pow((F.col(n) + F.col(f"o.{n}") + 0.5) * side, F.lit(2.0)) for n in names)
        spread = spread.filter(F.abs(F.sqrt(middle) - geo.EARTH_RADIUS_M) <= 0.87 * side)
    same = F.greatest(F.lit(0), *(F.abs(F.col(f"o.{n}")) for n in names)) == 0
    right = spread.select(*by, F.col("p").alias("b"), same.alias("same"), *((F.col(n) + F.col(f"o.{n}")).alias(n) for n in names))
    met = own.withColumnRenamed("p", "a").join(right, [*by, *names])
    return met.filter("a.id < b.id OR (NOT same AND a.id > b.id)").select(*by, "a", "b")


def splits(placed: DataFrame, sample: int = SPLIT_SAMPLE, depth: int = DEPTH) -> list[tuple[int, str, float]]:
    """(node, axis, at) of a k-d tree: node n has children 2 n and 2 n + 1, and is split at the median of its widest axis.

    Fitted on at most `sample` points, those whose ids hash least; which points these are says how even the leaves
    are, not what is found.
    """
    some = placed.select("p.id", "p.x", "p.y", "p.z").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows, found = {1: some.select("x", "y", "z").collect()}, []
    for node in range(1, 1 << depth):
        own = rows.pop(node, [])
        if len(own) > 1:
            axis = max(range(3), key=lambda k: max(r[k] for r in own) - min(r[k] for r in own))
            at = sorted(r[axis] for r in own)[len(own) // 2]
            rows[2 * node], rows[2 * node + 1] = [r for r in own if r[axis] < at], [r for r in own if r[axis] >= at]
            found.append((node, "xyz"[axis], float(at)))
    return found


def _met_in_leaves(placed: DataFrame, by: list[str], reach: float) -> DataFrame:
    """Rows (by..., a, b): left rows are in their own leaf of a k-d tree, right rows in all leaves that lie within reach."""
    tree = {node: (axis, at) for node, axis, at in splits(placed)}

    def leaf(node: int) -> Column:
        if node not in tree:
            return F.lit(node)
        axis, at = tree[node]
        return F.when(F.col(f"p.{axis}") < at, leaf(2 * node)).otherwise(leaf(2 * node + 1))

    def leaves(node: int) -> Column:
        if node not in tree:
            return F.array(F.lit(node))
        axis, at = tree[node]
        low, high, none = F.col(f"p.{axis}") - reach < at, F.col(f"p.{axis}") + reach >= at, F.array().cast("array<int>")
        return F.concat(F.when(low, leaves(2 * node)).otherwise(none), F.when(high, leaves(2 * node + 1)).otherwise(none))

    left = placed.select(*by, F.col("p").alias("a"), leaf(1).alias("leaf"))
    right = placed.select(*by, F.col("p").alias("b"), F.explode(leaves(1)).alias("leaf"))
    return left.join(right, [*by, "leaf"]).filter("a.id < b.id").select(*by, "a", "b")


def candidates(
    points: DataFrame, radius_m: float, method: str = "grid", id_col: str = "id", by: list[str] | None = None, carry: list[str] | None = None
) -> DataFrame:
    """(by..., a, b, chord2): pairs that a method compares, a.id < b.id, with the squared chord between them.

    The grid has cubes; `latitude` has bands as high as the radius, which is the classic sweep as an equi-join; `tree` has
    the leaves of a k-d tree, where each point meets those of its own leaf and of leaves within the radius.
    """
    by, carry = by or [], carry or []
    placed = _placed(points, id_col, by, carry)
    side = max(1.0, geo.chord_m(radius_m))
    if method == "brute":
        left, right = placed.withColumnRenamed("p", "a"), placed.withColumnRenamed("p", "b")
        met = (left.join(right, by) if by else left.crossJoin(right)).filter("a.id < b.id")
    elif method == "tree":
        met = _met_in_leaves(placed, by, side)
    else:
        met = _met(placed, by, {"grid": "xyz", "latitude": "z"}[method], side)
    square = lambda axis: F.pow(F.col(f"a.{axis}") - F.col(f"b.{axis}"), F.lit(2.0))
    first = F.col("a.id") < F.col("b.id")
    return met.select(
        *by, F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"),
        (square("x") + square("y") + square("z")).alias("chord2"),
    )


def within(
    points: DataFrame, radius_m: float, method: str = "grid", id_col: str = "id", by: list[str] | None = None, carry: list[str] | None = None
) -> DataFrame:
    """(by..., a, b) structs of pairs at most radius_m apart along the sphere."""
    met = candidates(points, radius_m, method, id_col, by, carry)
    return met.filter(F.col("chord2") <= geo.chord_m(radius_m) ** 2).drop("chord2")


def _around(own: DataFrame, by: list[str], names: list[str], side: float) -> DataFrame:
    """Rows under their own cell (kind 0) and under half of its neighbours (kind 2)."""
    offsets = F.array(*(F.struct(*(F.lit(d).alias(f"o{n}") for n, d in zip(names, o, strict=True))) for o in half_neighbours(len(names))))
    spread = own.select("*", F.inline(offsets))
    middle = sum(F.pow((F.col(n) + F.col(f"o{n}") + 0.5) * side, F.lit(2.0)) for n in names)
    kind = F.when(F.greatest(*(F.abs(F.col(f"o{n}")) for n in names)) == 0, 0).otherwise(2)
    near = spread.filter((kind == 0) | (F.abs(F.sqrt(middle) - geo.EARTH_RADIUS_M) <= 0.87 * side))
    held = [c for c in own.columns if c not in names]
    return near.select(*held, kind.alias("kind"), *((F.col(n) + F.col(f"o{n}")).alias(n) for n in names))


def approaching(motions: DataFrame, radius_m: float, nearest_m: float, within_s: float, by: str = "minute", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(by, a_id, a_lat, a_lon, a_v_east, a_v_north, b_id, ...): pairs of motions (by, mmsi, lat, lon, v_east, v_north), a_id < b_id,
    that are at most radius_m apart and get as near as nearest_m within within_s, and pairs that miss a limit by a
    millionth; a caller tests the limits themselves.

    The grid of `within`, but a cell's rows and those of the cells around it are compared in blocks of arrays by the
    task that sorts them, and only pairs that approach leave it. The rows of a cell with more than cell_rows are dealt
    to several tasks, each of which gets all that is near. Rows with an unknown value meet none.
    """
    names, side = ["cx", "cy", "cz"], max(1.0, geo.chord_m(radius_m))
    values = ["lat", "lon", "v_east", "v_north"]
    cells = [F.floor(c / side).cast("long").alias(n) for n, c in zip(names, geo.ecef(F.col("lat"), F.col("lon")), strict=True)]
    known = " AND ".join(f"{c} IS NOT NULL" for c in (by, "mmsi", *values))
    own = durable(motions.select(by, "mmsi", *(F.col(v).cast("double").alias(v) for v in values)).filter(known).select("*", *cells))
    rows = _around(own, [by], names, side)
    hot = own.groupBy(by, *names).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks")).filter("blocks > 1")
    hot = durable(hot)
    if hot.count():
        mine = F.pmod(F.xxhash64("mmsi"), F.col("blocks"))
        dealt = rows.join(hot, [by, *names], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("deal"))
        rows = dealt.withColumn("kind", F.when((F.col("kind") == 0) & (F.col("deal") != mine), 1).otherwise(F.col("kind"))).drop("blocks")
    else:
        rows = rows.withColumn("deal", F.lit(0))
    key = [by, *names, "deal"]
    met = rows.repartition(*key).sortWithinPartitions(*key, "kind").select(*key, "kind", "mmsi", *values)
    sides = ", ".join(f"{s}_id long, " + ", ".join(f"{s}_{v} double" for v in values) for s in "ab")
    schema = f"{by} {dict(own.dtypes)[by]}, {sides}"
    out = [part.strip().split()[0] for part in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        meet = Meeting(radius_m, nearest_m, within_s)

        def found(group: pa.Table) -> Iterator[pa.RecordBatch]:
            at, kind, ids = group.column(0)[0], group.column("kind").to_numpy(), group.column("mmsi").to_numpy()
            motion = [group.column(v).to_numpy() for v in values]
            for a, b in _gathered(meet.pairs(kind, ids, *motion)):
                sides = [x for side in (a, b) for x in (ids[side], *(m[side] for m in motion))]
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()] * 1, at.type).take(pa.array(np.zeros(len(a), np.int64))), *map(pa.array, sides)], out)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in key]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            bounds = [0, *new.tolist(), batch.num_rows]
            for start, end in zip(bounds, bounds[1:], strict=False):
                part = batch.slice(start, end - start)
                if start == 0 and held and any(held[0].column(k)[0] != part.column(k)[0] for k in key):
                    yield from found(pa.Table.from_batches(held))
                    held = []
                elif start:
                    yield from found(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from found(pa.Table.from_batches(held))

    return met.mapInArrow(work, schema)


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in parts of some GATHERED, as each part that is sent has a price of its own."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= GATHERED:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


class Meeting:
    """Compares the rows of a cell with those near it."""

    def __init__(self, radius_m: float, nearest_m: float, within_s: float) -> None:
        self.radius2, self.nearest2, self.within = (radius_m * (1 + 1e-6) + 0.01) ** 2, (nearest_m * (1 + 1e-6) + 0.01) ** 2, within_s * (1 + 1e-6) + 0.01

    def pairs(self, kind: np.ndarray, ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, ve: np.ndarray, vn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices (a, b) of pairs of a row of kind 0 and any: of the rows of the same cell (0 and 1) each pair once.

        The frame is that of geo.closest_approach; with half the angles' functions its cosine is a product of matrices.
        """
        n = int(np.count_nonzero(kind == 0))
        east = (lon - lon[0] + 540.0) % 360.0 - 180.0
        wide = len(lon) > 0 and np.ptp(east) > 180.0
        half = np.radians(lat) / 2
        waves = np.stack([np.cos(half), np.sin(half)])
        east, north = east * geo.M_PER_DEG, (lat - lat.mean()) * geo.M_PER_DEG
        high, broad = BLOCK
        for i in range(0, n, high):
            a = slice(i, min(i + high, n))
            left = waves[:, a].T * [1.0, -1.0]
            for j in range(0, len(kind), broad):
                b = slice(j, j + broad)
                if j + broad <= i and kind[min(j + broad, len(kind)) - 1] == 0:
                    continue  # this block has met those rows already
                dx = east[None, b] - east[a, None]
                if wide:
                    dx -= 360.0 * geo.M_PER_DEG * np.rint(dx / (360.0 * geo.M_PER_DEG))
                dx *= left @ waves[:, b]
                dy = north[None, b] - north[a, None]
                vx, vy = ve[None, b] - ve[a, None], vn[None, b] - vn[a, None]
                across = dx * vy
                across -= dy * vx
                across *= across
                vv = vx * vx
                vv += vy * vy
                # the square of what is between the paths, and a slack for nearly equal velocities
                at = np.flatnonzero((across <= self.nearest2 * vv + 1e-3) & (vv > 5e-10))
                if not len(at):
                    continue
                x, y, toward, v2 = dx.ravel()[at], dy.ravel()[at], None, vv.ravel()[at]
                toward = -(x * vx.ravel()[at] + y * vy.ravel()[at])
                kept = (toward >= -1e-6 * v2 - 1e-6) & (toward <= self.within * v2 + 1e-6) & (x * x + y * y <= self.radius2)
                at = at[kept]
                one, other = i + at // dx.shape[1], j + at % dx.shape[1]
                # within the cell by place, of a cell that is dealt by number
                own = kind[other]
                kept = np.where(own == 0, other > one, np.where(own == 1, ids[other] > ids[one], True)) & (ids[one] != ids[other])
                one, other = one[kept], other[kept]
                swap = ids[one] > ids[other]
                if len(one):
                    yield np.where(swap, other, one), np.where(swap, one, other)


def statistics(points: DataFrame, radius_m: float, method: str = "grid", id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """One row (method, checks, pairs): distances computed, and pairs found."""
    near = (F.col("chord2") <= geo.chord_m(radius_m) ** 2).cast("long")
    met = candidates(points, radius_m, method, id_col, by)
    return met.agg(F.lit(method).alias("method"), F.count("*").alias("checks"), F.coalesce(F.sum(near), F.lit(0)).alias("pairs"))


def last_positions(fixes: DataFrame) -> DataFrame:
    """The last report of every vessel in file order."""
    last = F.max_by(F.struct("t", "lat", "lon"), "seq").alias("p")
    return fixes.groupBy("mmsi").agg(last).select("mmsi", "p.*")


def busiest_minute(fixes: DataFrame) -> DataFrame:
    """One row (minute, vessels): the minute with the most vessels, the first of equals."""
    counts = fixes.groupBy(F.floor(F.col("t") / 60).alias("minute")).agg(F.countDistinct("mmsi").alias("vessels"))
    best = F.max(F.struct("vessels", (-F.col("minute")).alias("first")))
    return counts.agg(best.alias("m")).select((-F.col("m.first")).alias("minute"), F.col("m.vessels").alias("vessels"))


def snapshot_of_busiest(fixes: DataFrame) -> DataFrame:
    """(minute, mmsi, t, lat, lon): each vessel's last position within the busiest minute."""
    timed = fixes.withColumn("minute", F.floor(F.col("t") / 60))
    found = timed.join(F.broadcast(busiest_minute(fixes).select("minute")), "minute", "left_semi")
    return found.groupBy("minute", "mmsi").agg(F.max_by(F.struct("t", "lat", "lon"), "seq").alias("p")).select("minute", "mmsi", "p.*")


def numbered(pairs: DataFrame) -> DataFrame:
    """Pairs with their place in the order of (a, b), from 1 on, ordered by it; numbers are running sums over ranges."""
    keyed = pairs.select("*", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    placed = running(keyed, ["id_a", "id_b"], {"n": F.lit(1).cast("long")})
    return placed.select(*pairs.columns, (F.col("n") + 1).alias("n")).orderBy("n")
