"""The k nearest points of every point of a scan, exactly, by tiles of space; lonely points ask in several. Calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.tables import written
from ..shipping import ship
from .features import MOMENTS
from .tiles import AXES, SURE, TILE, extent_of, few_nearest_of, in_order, k_nearest_of, places, tile_index, tile_width, with_halo

#: Tiles reach at first this share of their width beyond themselves.
HALO = 1 / 16
#: Points whose rows are made at a time: `rows` looks at the whole tile for each lot.
LOT = 1 << 15
#: Columns of a point that asks: its number, how far it looks, and the tile that it lies in.
ASK, BALL, HOME = "__ask", "__ball", ("__hx", "__hy", "__hz")
ASKS = (ASK, BALL, *HOME)
#: How far the k-th neighbour is at most, as seen so far; a point that looks a little further finds all.
WITHIN, FURTHER = "__within", 1.01 / SURE
#: Below this cosine of the incidence angle intensities are divided by it; a fixed value.
LEAST_COSINE = 0.3
#: A normal is taken where the two lesser eigenvalues are apart by this share of the largest.
LEAST_GAP = 1e-3


def _ranks(columns: list[str], near_columns: list[str]):
    """A row for each neighbour, with its rank."""

    def rows(tile: pa.Table, who: np.ndarray, near: np.ndarray, far: np.ndarray) -> list:
        k = near.shape[1]
        whom = pa.array(near.ravel())
        return [*(tile.column(c).take(pa.array(np.repeat(who, k))) for c in columns), pa.array(np.tile(np.arange(1, k + 1), len(who)), pa.int32()), *(tile.column(c).take(whom) for c in near_columns), pa.array(far.ravel())]

    return rows


def _covariances(at: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """Population covariances of places, each in the order of MOMENTS."""
    gap = at - sums[:, None] / at.shape[1]
    return [(gap[:, :, "xyz".index(m[0])] * gap[:, :, "xyz".index(m[1])]).mean(1) for m in MOMENTS]


def _spreads(columns: list[str]):
    """A row for each point: neighbours, squared distance of the last, sums of their places and their population covariances."""

    def rows(tile: pa.Table, who: np.ndarray, near: np.ndarray, far: np.ndarray) -> list:
        at = places(tile)[near]
        sums = at.sum(1)
        spread = _covariances(at, sums)
        return [*(tile.column(c).take(pa.array(who)) for c in columns), pa.array(np.full(len(who), near.shape[1])), pa.array(far.max(1)), *(pa.array(np.ascontiguousarray(v)) for v in sums.T), *(pa.array(v) for v in spread)]

    return rows


def least_axis(xx, xy, xz, yy, yz, zz) -> tuple[np.ndarray, np.ndarray]:
    """(unit axis of least spread of each covariance matrix, NaN where two axes have the least spread alike; its share of the
    spread), in the closed forms of eigenvalues3() and axis3()."""
    q = (xx + yy + zz) / 3
    p = np.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    determinant = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    turn = np.arccos(np.clip(np.divide(determinant, 2 * p * p * p, out=np.zeros(len(p)), where=p > 0), -1, 1)) / 3
    e1, least = q + 2 * p * np.cos(turn), q + 2 * p * np.cos(turn + 2 * np.pi / 3)
    e3 = np.maximum(least, 0)
    e2 = np.maximum(3 * q - e1 - least, e3)
    rows = [np.stack(r, 1) for r in ((xx - e3, xy, xz), (xy, yy - e3, yz), (xz, yz, zz - e3))]
    products = np.stack([np.cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))], 1)
    squares = (products * products).sum(2)
    best = squares.argmax(1)
    each = np.arange(len(best))
    length = np.sqrt(squares[each, best])
    sure = (e2 - e3 > LEAST_GAP * e1) & (length > 0)
    total = e1 + e2 + e3
    axis = np.divide(products[each, best], length[:, None], out=np.full((len(best), 3), np.nan), where=sure[:, None])
    return axis, np.divide(e3, total, out=np.zeros(len(total)), where=total > 0)


def _normals(columns: list[str]):
    """A row for each point: its normal, and the share of the spread along it."""

    def rows(tile: pa.Table, who: np.ndarray, near: np.ndarray, far: np.ndarray) -> list:
        at = places(tile)[near]
        axis, share = least_axis(*_covariances(at, at.sum(1)))
        return [*(tile.column(c).take(pa.array(who)) for c in columns), *(pa.array(np.ascontiguousarray(v), from_pandas=True) for v in axis.T), pa.array(share)]

    return rows


def _cosines(columns: list[str]):
    """A row for each point: the cosine between its normal and the ray from the scanner; 1 without either."""

    def rows(tile: pa.Table, who: np.ndarray, near: np.ndarray, far: np.ndarray) -> list:
        xyz = places(tile)
        at, ray = xyz[near], xyz[who]
        axis, _ = least_axis(*_covariances(at, at.sum(1)))
        length = np.sqrt((ray * ray).sum(1))
        cosine = np.divide(np.abs((axis * ray).sum(1)), length, out=np.full(len(who), np.nan), where=length > 0)
        return [*(tile.column(c).take(pa.array(who)) for c in columns), pa.array(np.where(np.isnan(cosine), 1.0, cosine))]

    return rows


def _together(found, lot: int):
    """The parts of a tile's search in lots of about as many points, of those that are settled."""
    parts, n = [], 0
    for part in found:
        parts.append(part)
        n += len(part[0])
        if n >= lot:
            yield tuple(np.concatenate(p) for p in zip(*parts))
            parts, n = [], 0
    if n:
        yield tuple(np.concatenate(p) for p in zip(*parts))


def _certain(found, bound: np.ndarray, within: np.ndarray):
    """Of what a tile's search found, the points whose k-th neighbour is within their bound; of the others, `within` learns its distance."""
    for which, near, far in found:
        sure = far[:, -1] <= bound[which] ** 2
        within[which[~sure]] = np.sqrt(far[~sure, -1])
        yield which[sure], near[sure], far[sure]


def _settled(rows, columns: list[str], schema: pa.Schema):
    """(rows of a part, rows of points not settled, with nulls between their columns and what is known of the k-th neighbour),
    both by the schema."""

    def part(*found) -> pa.Table:
        made = rows(*found)
        return pa.table([*(c.cast(f.type) for c, f in zip(made, schema)), pa.nulls(len(made[0]), pa.float64())], schema=schema)

    def open_(rest: pa.Table, within: np.ndarray) -> pa.Table:
        made = list(schema)[len(columns) : -1]
        return pa.table([*(rest.column(c).cast(schema.field(c).type) for c in columns), *(pa.nulls(len(rest), f.type) for f in made), pa.array(within, from_pandas=True)], schema=schema)

    return part, open_


def _in_tile(rows, k: int, width: float, reach: float, everything: bool, columns: list[str], keys: list[str], schema: pa.Schema, whole: bool):
    """What `rows` makes of the neighbours of a tile's own points; those not settled come back with nulls after their columns.

    A point sees all others that are no further from it than what the tile holds about it: `reach` and its way to the tile's border.
    """
    part, open_ = _settled(rows, columns, schema)

    def run(tile: pa.Table) -> pa.Table:
        asks = tile.filter(pa.array(tile.column("__role").to_numpy() > 0)).combine_chunks()
        if not len(asks):
            return schema.empty_table()
        tile = in_order(tile, keys).combine_chunks()
        parts, left, within = [], np.full(len(asks), True), np.full(len(asks), np.nan)
        # columns of those that ask come first, so both are one table
        both = pa.concat_tables([tile, asks])
        at = places(asks)
        low = np.array([asks.column(t)[0].as_py() for t in TILE]) * width
        inside = np.minimum(at - low, low + width - at).min(1).clip(0)
        bound = np.full(len(asks), np.inf) if everything else SURE * (reach + inside)
        found = _certain(k_nearest_of(at, places(tile), k, reach if everything else 4 * reach, everything), bound, within)
        for which, near, far in _together(found, len(asks) + 1 if whole else LOT):
            left[which] = False
            parts.append(part(both, len(tile) + which, near, far))
        return pa.concat_tables([*parts, open_(asks.filter(pa.array(left)), within[left])]).combine_chunks()

    return run


def _candidates(k: int, columns: list[str], keys: list[str], schema: pa.Schema):
    """The k nearest of a tile's points as far as each that asks looks: who asks, the point, and the squared distance."""

    def run(tile: pa.Table) -> pa.Table:
        asking = tile.column(ASK).is_valid()
        asks, here = tile.filter(asking).combine_chunks(), in_order(tile.filter(pc.invert(asking)), keys).combine_chunks()
        parts = [schema.empty_table()]
        for who, at, far in few_nearest_of(places(asks), places(here), k, asks.column(BALL).to_numpy()) if len(asks) and len(here) else ():
            who, at = pa.array(who), pa.array(at)
            made = [*(asks.column(c).take(who) for c in (*columns, *ASKS)), *(here.column(c).take(at) for c in columns), pa.array(far)]
            parts.append(pa.table([c.cast(f.type) for c, f in zip(made, schema)], schema=schema))
        return pa.concat_tables(parts).combine_chunks()

    return run


def _of_all_tiles(rows, k: int, everything: bool, columns: list[str], keys: list[str], schema: pa.Schema):
    """What `rows` makes of the best candidates from all tiles, for points that lie in one tile."""
    part, open_ = _settled(rows, columns, schema)

    def run(found: pa.Table) -> pa.Table:
        found = in_order(found, [ASK, "__d2", *(f"__near_{c}" for c in keys)]).combine_chunks()
        ask = found.column(ASK).to_numpy()
        begin = np.flatnonzero(np.append(True, ask[1:] != ask[:-1]))
        count = np.minimum(np.diff(np.append(begin, len(ask))), k)
        asks = found.select(columns).take(pa.array(begin))
        # with everything in reach a group has as many points for each that asks
        near = int(count.max()) if everything else k
        far = found.column("__d2").to_numpy()
        last = np.sqrt(far[begin + count - 1])
        settled = (count == near) & (everything | (last <= SURE * found.column(BALL).to_numpy()[begin]))
        at = begin[settled, None] + np.arange(near)
        parts = [open_(asks.filter(pa.array(~settled)), np.where(count == k, last, np.nan)[~settled])]
        if len(at):
            points = found.select([f"__near_{c}" for c in columns]).rename_columns(columns).take(pa.array(at.ravel()))
            both = pa.concat_tables([points, asks.filter(pa.array(settled))]).combine_chunks()
            parts.append(part(both, at.size + np.arange(len(at)), np.arange(at.size).reshape(at.shape), far[at]))
        return pa.concat_tables(parts).combine_chunks()

    return run


def near_rows(points: DataFrame, k: int, on: list[str], keys: list[str], rows, made: str, settled: str, whole: bool = False) -> DataFrame:
    """points' columns and `made`, what `rows` makes of the k nearest points of each, itself included, in tiles of space.
    With `whole`, `rows` sees all points that a tile settles at once.

    Each point goes to its own tile and to those that it is within reach of. A point whose k-th neighbour in its tile is no further
    than all points about it that the tile holds has found them all. The others ask again: in all tiles as far away as the k-th that
    they have seen, or within four times the reach where they have not seen so many, until these are all tiles of their group; what
    the tiles find is put together where the point lies. A task holds one tile of one group: FULL points and those in reach of it, or
    FULL points and those that ask there. Tiles keep their size. What is written is `made`, so that should be little.
    """
    ship(points.sparkSession)
    extent = extent_of(points)
    width = tile_width(points, on, extent)
    reach, everything = width * HALO, not extent > 0
    columns = points.columns
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    plain = ", ".join(f"`{c}` {types[c]}" for c in columns)
    schema = StructType.fromDDL(f"{plain}, {made}, {WITHIN} double")
    tiles = [*on, *TILE]
    placed = points.withColumns({t: tile_index(c, width) for c, t in zip(AXES, TILE)})
    here = [tile_index(c, width) == F.col(t) for c, t in zip(AXES, TILE)]
    dealt = with_halo(points, width, reach).withColumn("__role", F.when(here[0] & here[1] & here[2], 1).otherwise(0))
    found = written(dealt.groupBy(*tiles).applyInArrow(_in_tile(rows, k, width, reach, everything, columns, keys, to_arrow_schema(schema), whole), schema), "neighbours")
    out, spots = found.where(f"{settled} is not null"), None
    asked = {c: "double" if c == BALL else "long" for c in ASKS}
    met = StructType.fromDDL(", ".join([plain, *(f"{c} {t}" for c, t in asked.items()), *(f"`__near_{c}` {types[c]}" for c in columns), "__d2 double"]))
    while not everything:
        left = found.where(f"{settled} is null")
        if not left.limit(1).count():
            break
        reach *= 4
        everything = reach >= extent
        reach = max(reach, 2 * extent) if everything else reach
        ball = F.coalesce(F.col(WITHIN) * FURTHER, F.lit(reach))
        asks = left.select(*columns, F.monotonically_increasing_id().alias(ASK), ball.alias(BALL), *(tile_index(c, width).alias(h) for c, h in zip(AXES, HOME)))
        if reach <= width:
            asking = with_halo(asks, width, F.col(BALL))
        else:
            # few points are as lonely as that: they look through the tiles that there are
            spots = spots or written(placed.select(*tiles).distinct(), "tiles")
            asking = asks.join(spots, on)
            for c, t in zip(AXES, TILE):
                asking = asking.where(F.col(t).between(tile_index(c, width, -F.col(BALL)), tile_index(c, width, F.col(BALL))))
        asking = written(asking.select(*columns, *ASKS, *TILE), "asking")
        dealt = placed.join(asking.select(*tiles).distinct(), tiles, "left_semi").select(*columns, *(F.lit(None).cast(t).alias(c) for c, t in asked.items()), *TILE).unionByName(asking)
        near = dealt.groupBy(*tiles).applyInArrow(_candidates(k, columns, keys, to_arrow_schema(met)), met)
        found = written(near.groupBy(*on, *HOME).applyInArrow(_of_all_tiles(rows, k, everything, columns, keys, to_arrow_schema(schema)), schema), "neighbours")
        out = out.unionByName(found.where(f"{settled} is not null"))
    return out.drop(WITHIN)


def k_nearest(points: DataFrame, k: int, on: list[str], keys: list[str]) -> DataFrame:
    """points' columns, rank (from 1), near_<column> of the points at that rank, and d2: min(k, points of the group) rows each.

    Points of a group have equal `on`; `keys` tell them apart and settle equal distances. A point is its own first neighbour.
    """
    near = [c for c in points.columns if c not in on]
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    made = ", ".join(["rank int", *(f"`near_{c}` {types[c]}" for c in near), "d2 double"])
    return near_rows(points, k, on, keys, _ranks(points.columns, near), made, "rank")


def k_spreads(points: DataFrame, k: int, on: list[str], keys: list[str]) -> DataFrame:
    """points' columns and, over their k nearest points as in k_nearest(): n, d2 of the last, sums of places sum_x, sum_y, sum_z,
    and population covariances near_xx..near_zz. A row each, made where the neighbours are found."""
    made = ", ".join(["n long", "d2 double", *(f"sum_{c} double" for c in "xyz"), *(f"near_{m} double" for m in MOMENTS)])
    return near_rows(points, k, on, keys, _spreads(points.columns), made, "n")


def normals(points: DataFrame, k: int, on: list[str], keys: list[str]) -> DataFrame:
    """points with nx, ny, nz and curvature: the axis of least spread of the k nearest points, and its share of the spread.

    nx, ny and nz are null where two axes have the least spread alike, as for points on a line; the sign is not settled.
    """
    made = ", ".join(f"{c} double" for c in ("nx", "ny", "nz", "curvature"))
    return near_rows(points, k, on, keys, _normals(points.columns), made, "curvature")


def calibrated(points: DataFrame, k: int, max_intensity: float, on: list[str], keys: list[str], intensity: str = "intensity") -> DataFrame:
    """points with their intensity over the cosine of the incidence angle, at least 0.3, and at most max_intensity.

    Points are in the scanner's coordinates. Those without a normal, and one at the scanner itself, are only capped.
    """
    found = near_rows(points, k, on, keys, _cosines(points.columns), "__cosine double", "__cosine")
    whole = F.least(F.col(intensity).cast("double"), F.lit(float(max_intensity)))
    return found.withColumn(intensity, F.least(F.lit(float(max_intensity)), whole / F.greatest(F.lit(LEAST_COSINE), F.col("__cosine")))).select(*points.columns)
