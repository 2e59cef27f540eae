"""Neighbours of points within a reach, by tiles: each point travels once, and those near a tile's border to the tiles beside it.

A tile is a cube of EDGE times the reach; tasks sort their points by tile and pass over some hundred thousand at a time, in whole
tiles. Inside, points meet those of the cells around them, whose edge follows how densely they lie, so that the work for a few nearest
neighbours grows with the points and not with their pairs. A tile's points (bounded by space, with one reach around) are one task's.
Points without finite coordinates, and those whose frame or key is null, have no neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.plans.materialize import join_checked, materialize

#: Edge of a tile in reaches, rows of a pass at least, candidates of a step at most, cells along a tile at most.
EDGE, ROWS, CANDIDATES, FINEST = 8, 200_000, 4_000_000, 1 << 13
#: Cells are a hair larger than what is searched, so that rounding leaves no neighbour two cells away.
_HAIR = 1 + 1e-9
_TILE = ["_tx", "_ty", "_tz"]

#: What a pass does with whole tiles, whose rows stand by key: keys, tile numbers, coordinates from the tile's corner, whether a row is the tile's own, and
#: which of the tiles around it comes from.
Kernel = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, list[pa.Array]]]]


def finite(points: DataFrame) -> DataFrame:
    """The points with finite coordinates."""
    test = F.lit(True)
    for c in "xyz":
        test = test & (F.abs(F.col(c).cast("double")) < float("inf"))  # NaN is greater
    return points.where(test)


def narrow(points: DataFrame, key: str) -> DataFrame:
    """(frame_id, key, x, y, z) of the points that can have neighbours, written once."""
    own = finite(points).where(F.col("frame_id").isNotNull() & F.col(key).isNotNull())
    return materialize(own.select("frame_id", key, *(F.col(c).cast("double").alias(c) for c in "xyz")), "points")


def over_tiles(own: DataFrame, reach: float, key: str, kernel: Kernel, fields: list[T.StructField], some: DataFrame | None = None, tasks: int = 0) -> DataFrame:
    """frame_id and the kernel's fields over all tiles that hold a narrow point, or one of some (frame_id, key), if given; then only those are a tile's own.

    Tiles are dealt to so many tasks, if not 0, else as the session does.
    """
    edge, halo = reach * EDGE, reach * _HAIR
    place = {t: F.floor(F.col(c) / edge) for c, t in zip("xyz", _TILE)}
    rows = own.withColumn("_own", F.lit(True)) if some is None else own.join(some.select("frame_id", key, F.lit(True).alias("_own")), ["frame_id", key], "left")
    held = rows.where("_own").select("frame_id", *(at.alias(t) for t, at in place.items())).distinct()
    spread = rows
    for c, t in zip("xyz", _TILE):
        spread = spread.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - halo) / edge), F.floor((F.col(c) + halo) / edge))))
    side = sum((3**k * (place[t] - F.col(t)) for k, t in enumerate(_TILE)), F.lit(0)).cast("int")  # 0 at home, else towards the home tile
    spread = join_checked(spread, held, ["frame_id", *_TILE], "left_semi")
    spread = spread.select("frame_id", key, *_TILE, *((F.col(c) - F.col(t) * edge).alias(c) for c, t in zip("xyz", _TILE)), (F.coalesce("_own", F.lit(False)) & (side == 0)).alias("_own"), side.alias("_side"))
    dealt = spread.repartition(*([tasks] if tasks else []), "frame_id", *_TILE).sortWithinPartitions("frame_id", *_TILE, key)
    schema = T.StructType([T.StructField("frame_id", own.schema["frame_id"].dataType), *fields])

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole tiles, some hundred thousand rows at a time."""
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            new = np.flatnonzero(_starts(table))
            if len(new) > 1:
                yield table.slice(0, new[-1])
                table = table.slice(new[-1])
            kept, n = table.to_batches(), (0 if len(new) > 1 else -n)  # a tile larger than a pass is asked about again after as many rows
        if kept:
            yield pa.Table.from_batches(kept).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in passes(batches):
            if not table.num_rows:
                continue
            tile = np.cumsum(_starts(table)) - 1
            frames, keys = _flat(table["frame_id"]), _flat(table[key])
            xyz = np.stack([table[c].to_numpy() for c in "xyz"])
            for at, columns in kernel(keys, tile, xyz, np.asarray(table["_own"]), np.asarray(table["_side"])):
                yield pa.RecordBatch.from_arrays([frames.take(pa.array(at)), *columns], names=schema.names)

    return dealt.mapInArrow(run, schema)


def _flat(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _starts(table: pa.Table) -> np.ndarray:
    """Whether a tile's first row."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("frame_id", *_TILE):
        v = _flat(table[c])
        new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
    return new


class _Cells:
    """Points sorted by tile and cell."""

    def __init__(self, tile: np.ndarray, xyz: np.ndarray, edge: float, reach: float):
        self.across = int(np.ceil((EDGE + 2.1) * reach / edge)) + 4
        q = np.floor(xyz / (edge * _HAIR)).astype(np.int64) + int(np.ceil(1.05 * reach / edge)) + 1
        self.of = ((tile * self.across + q[0]) * self.across + q[1]) * self.across + q[2]
        self.order = np.argsort(self.of, kind="stable")
        self.sorted = self.of[self.order]

    def crowd(self) -> float:
        """How many points a point's cell has on average."""
        n = np.diff(np.append(np.flatnonzero(np.append(True, self.sorted[1:] != self.sorted[:-1])), len(self.sorted)))
        return float((n.astype(float) ** 2).sum() / max(1, n.sum()))

    def met(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place among the asked, other point) of all in the 27 cells around, some at a time; cells along z follow one another."""
        steps = np.array([(i * self.across + j) * self.across for i in (-1, 0, 1) for j in (-1, 0, 1)])
        cells, back = np.unique(self.of[asked], return_inverse=True)
        low = np.searchsorted(self.sorted, cells[:, None] + steps - 1, "left")
        count = np.searchsorted(self.sorted, cells[:, None] + steps + 1, "right") - low
        cost = np.cumsum(count.sum(1)[back])
        start = 0
        while start < len(asked):
            end = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + CANDIDATES, "right")))
            b = back[start:end]
            c, lo = count[b].ravel(), low[b].ravel()
            ends = np.cumsum(c)
            total = int(ends[-1])
            at = np.arange(total) + np.repeat(lo - (ends - c), c)
            yield np.repeat(np.repeat(np.arange(start, end), len(steps)), c), self.order[at]
            start = end


def _nearest(tile: np.ndarray, xyz: np.ndarray, own: np.ndarray, reach: float, k: int) -> np.ndarray:
    """Of each own row the squares of the distances to the k nearest rows within reach, in order, inf where there are fewer; a row doesn't meet itself."""
    out = np.full((len(tile), k), np.inf)
    order = np.lexsort((xyz[2], xyz[1], xyz[0], tile))
    new = np.append(True, (tile[order[1:]] != tile[order[:-1]]) | (xyz[:, order[1:]] != xyz[:, order[:-1]]).any(0))
    place = np.empty(len(tile), np.int64)
    place[order] = np.arange(len(tile)) - np.maximum.accumulate(np.where(new, np.arange(len(tile)), 0))
    out[place > k] = 0  # of points at one place, k + 1 stand for all
    use = np.flatnonzero(place <= k)
    tile, xyz, own = tile[use], xyz[:, use], own[use]
    left, edge = np.flatnonzero(own), float(reach)
    cells = _Cells(tile, xyz, edge, reach)
    while cells.crowd() > 6 and cells.across < FINEST:
        edge /= 2
        cells = _Cells(tile, xyz, edge, reach)
    while len(left):
        best = np.full((len(left), k), np.inf)
        for q, other in cells.met(left):
            p = left[q]
            d2 = ((xyz[:, p] - xyz[:, other]) ** 2).sum(0)
            good = (d2 <= edge * edge) & (p != other)
            q, d2 = q[good], d2[good]
            by = np.lexsort((d2, q))
            q, d2 = q[by], d2[by]
            first = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
            rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            few = rank < k
            best[q[few], rank[few]] = d2[few]
        done = np.isfinite(best[:, k - 1]) | (edge >= reach)
        out[use[left[done]]] = best[done]
        left, edge = left[~done], edge * 2
        if len(left):
            cells = _Cells(tile, xyz, edge, reach)
    return out


def nearest(own: DataFrame, reach: float, k: int, key: str, some: DataFrame | None = None) -> DataFrame:
    """(frame_id, key, near): of narrow points (of some, if given) the squares of the distances to the k nearest others within reach, in order."""
    kind = own.schema[key].dataType

    def kernel(keys, tile, xyz, mine, side):
        at = np.flatnonzero(mine)
        d2 = _nearest(tile, xyz, mine, reach, k)[at]
        held = np.isfinite(d2)
        yield at, [keys.take(pa.array(at)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held.sum(1))).astype(np.int32)), pa.array(d2[held]))]

    return over_tiles(own, reach, key, kernel, [T.StructField(key, kind), T.StructField("near", T.ArrayType(T.DoubleType()))], some)


#: Points of a chunk, slices of a tile's keys, points that ask together, points a cell of the reach's edge from which on a tile is crowded, rows of a batch, points a task.
CHUNK, SLICES, ASKING, CROWDED, BATCH, POINTS = 8, 8, 16, 100, 200_000, 25_000


def _close(xyz: np.ndarray) -> np.ndarray:
    """An order in which points that follow one another lie close: in columns as wide as a cube that holds a chunk, along the longest axis."""
    if not xyz.shape[1]:
        return np.zeros(0, np.int64)
    low = xyz.min(1)
    wide = xyz.max(1) - low
    short, middle, long = np.argsort(wide, kind="stable")
    for flat in range(3):  # axes that are shorter than the cube don't count
        edge = (np.sort(wide)[flat:].prod() * CHUNK / xyz.shape[1]) ** (1 / (3 - flat))
        if 0 < edge <= np.sort(wide)[flat]:
            break
    else:
        edge = wide[long] or 1.0
    return np.lexsort((xyz[long], (xyz[short] - low[short]) // edge, (xyz[middle] - low[middle]) // edge))


def _squares(differences: Iterator[np.ndarray]) -> np.ndarray:
    """Squares of distances, from the differences along each axis, one axis at a time in little memory."""
    return sum(d * d for d in differences)


def _crowded_links(xyz: np.ndarray, own: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(own row, later row) of all rows of one crowded tile within reach of each other.

    The rows, that is keys, are cut into slices. Of the points behind a slice, which its points all precede, every eight that lie close make a chunk. Chunks whose corners
    are in reach of a point need no distances, and are what neighbours have in common: pairs with whole chunks come first, then those with parts of chunks and
    those inside the slice. Eight ids of a Parquet dictionary fill whole bytes, so neighbours' chunks repeat bytewise, and files compress to about half.
    """
    rows, limit = len(own), reach * reach
    for s in range(SLICES):
        first, behind = s * rows // SLICES, (s + 1) * rows // SLICES
        later = behind + _close(xyz[:, behind:])
        chunks = later[: len(later) // CHUNK * CHUNK].reshape(-1, CHUNK)
        low, high = (f(xyz[:, chunks], 2) for f in (np.min, np.max))
        loose = np.append(np.arange(first, behind), later[chunks.size :])
        asked = first + np.flatnonzero(own[first:behind])
        asked = asked[_close(xyz[:, asked])]
        for start in range(0, len(asked), ASKING):
            group = asked[start : start + ASKING]
            box = [(x[group].min(), x[group].max()) for x in xyz]
            near = np.flatnonzero(_squares(np.maximum(0, np.maximum(u - most, least - v)) for u, v, (least, most) in zip(low, high, box)) <= limit)
            others = loose[_squares(np.maximum(0, np.maximum(x - most, least - x)) for x, (least, most) in zip(xyz[:, loose], box)) <= limit]
            corners, loose_xyz = list(zip(low[:, near], high[:, near])), xyz[:, others]
            step = max(1, CANDIDATES // max(1, len(near) * CHUNK + len(others)))
            for some in (group[k : k + step] for k in range(0, len(group), step)):
                at = xyz[:, some, None]
                whole = _squares(np.maximum(v - x, x - u) for x, (u, v) in zip(at, corners)) <= limit
                p, c = np.nonzero(~whole & (_squares(np.maximum(0, np.maximum(u - x, x - v)) for x, (u, v) in zip(at, corners)) <= limit))
                of, q = np.repeat(some[p], CHUNK), chunks[near[c]].ravel()
                good = (_squares(x[of] - x[q] for x in xyz) <= limit).reshape(-1, CHUNK)
                every = good.all(1)
                whole[p[every], c[every]] = True
                good[every] = False
                good = good.ravel()
                p, c = np.nonzero(whole)
                yield np.repeat(some[p], CHUNK), chunks[near[c]].ravel()
                i, j = np.nonzero((_squares(x - y for x, y in zip(at, loose_xyz)) <= limit) & (some[:, None] < others))
                p, q = np.append(of[good], some[i]), np.append(q[good], others[j])
                by = np.argsort(p, kind="stable")
                yield p[by], q[by]


def _links(tile: np.ndarray, xyz: np.ndarray, own: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(own row, later row) of all rows of a tile within reach of each other; some at a time."""
    cells = _Cells(tile, xyz, reach, reach)
    names, held = np.unique(cells.sorted, return_counts=True)
    of = names // cells.across**3
    crowd = np.bincount(of, held.astype(float) ** 2) / np.maximum(1, np.bincount(of, held))
    asked = np.flatnonzero(own & (crowd[tile] < CROWDED))
    asked = asked[np.argsort(cells.of[asked], kind="stable")]
    for q, other in cells.met(asked):
        p = asked[q]
        ahead = p < other
        p, other = p[ahead], other[ahead]
        good = ((xyz[:, p] - xyz[:, other]) ** 2).sum(0) <= reach * reach
        yield p[good], other[good]
    for t in np.flatnonzero(crowd >= CROWDED):
        start, end = np.searchsorted(tile, (t, t + 1))
        for p, other in _crowded_links(np.ascontiguousarray(xyz[:, start:end]), own[start:end], reach):
            yield start + p, start + other


def links(own: DataFrame, reach: float, key: str) -> DataFrame:
    """(frame_id, a, b), a < b, of all narrow points within reach of each other; a step's pairs are passed on before the next ones are made.

    A task has few tiles, so that its file names few points and their ids in the file's dictionary are short.
    """
    kind = own.schema[key].dataType

    def kernel(keys, tile, xyz, mine, side):
        # In the order of keys, so a pair is made by the tile of its smaller one.
        kept, n = [], 0
        for pair in _links(tile, xyz, mine, reach):
            kept.append(pair)
            n += len(pair[0])
            if n >= BATCH:
                yield from batch(keys, kept)
                kept, n = [], 0
        if n:
            yield from batch(keys, kept)

    def batch(keys, kept):
        p, other = (np.concatenate(x) for x in zip(*kept))
        yield p, [keys.take(pa.array(p)), keys.take(pa.array(other))]

    tasks = max(own.sparkSession.sparkContext.defaultParallelism, own.count() // POINTS)
    return over_tiles(own, reach, key, kernel, [T.StructField("a", kind), T.StructField("b", kind)], tasks=tasks)


#: A cell of this share of the reach holds only points that touch one another. Points of a cell that are tried first.
_TOUCHING, _TRIED = 0.577, 6


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest place of its part, when a and b are joined too."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (label[label] != label).any():
            label = label[label]


def _parts(tile: np.ndarray, xyz: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its cell's number, and the first row of all that chains of touching rows reach.

    Cells are joined and not points. Of two cells some points are tried first; all are only where that leaves them apart.
    """
    cells = _Cells(tile, xyz, reach * _TOUCHING, reach)
    order = cells.order
    start = np.flatnonzero(np.append(True, cells.sorted[1:] != cells.sorted[:-1]))
    names, size = cells.sorted[start], np.diff(np.append(start, len(order)))
    label = np.arange(len(names))
    near = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    near.sort(key=lambda m: sum(v * v for v in m))
    sorted_xyz = xyz[:, order]

    def touch(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Which pairs of cells have two points within reach, among na and nb of theirs, evenly picked."""
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        p = start[a][pair] + at // nb[pair] * size[a][pair] // na[pair]
        q = start[b][pair] + at % nb[pair] * size[b][pair] // nb[pair]
        good = ((sorted_xyz[:, p] - sorted_xyz[:, q]) ** 2).sum(0) <= reach * reach
        return np.bincount(pair[good], minlength=len(a)) > 0

    open_ = []
    for i, j, k in near:
        names_there = names + (i * cells.across + j) * cells.across + k
        b = np.minimum(np.searchsorted(names, names_there), len(names) - 1)
        a = np.flatnonzero(names[b] == names_there)
        b = b[a]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for s in range(0, len(a), CANDIDATES // _TRIED**2):
            u, v = a[s : s + CANDIDATES // _TRIED**2], b[s : s + CANDIDATES // _TRIED**2]
            hit = touch(u, v, np.minimum(size[u], _TRIED), np.minimum(size[v], _TRIED))
            label = _unite(label, u[hit], v[hit])
            rest = ~hit & ((size[u] > _TRIED) | (size[v] > _TRIED))
            open_.append((u[rest], v[rest]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*open_)) or [(), ()]))
    while len(a):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            break
        cost = np.cumsum(size[a] * size[b])
        n = max(1, int(np.searchsorted(cost, CANDIDATES, "right")))
        if cost[0] > CANDIDATES:  # two large cells: point by point of the first one
            q = sorted_xyz[:, start[b[0]] : start[b[0]] + size[b[0]]]
            hit = np.array([any((((sorted_xyz[:, r, None] - q) ** 2).sum(0) <= reach * reach).any() for r in range(start[a[0]], start[a[0]] + size[a[0]]))])
        else:
            hit = touch(a[:n], b[:n], size[a[:n]], size[b[:n]])
        label = _unite(label, a[:n][hit], b[:n][hit])
        a, b = a[n:], b[n:]
    cell = np.empty(len(order), np.int64)
    cell[order] = np.repeat(np.arange(len(names)), size)
    first = np.full(len(names), len(order))
    np.minimum.at(first, label[cell], np.arange(len(order)))
    return cell, first[label[cell]]


def parts(own: DataFrame, reach: float, key: str) -> DataFrame:
    """(frame_id, key, part, here): of narrow points the smallest key that chains of touching points reach in their tile and around it; `here` is false in rows for points around a tile.

    Those rows say which parts of other tiles go on in this one. Points of one cell and home touch one another there as well, so one stands for them.
    """
    kind = own.schema[key].dataType

    def kernel(keys, tile, xyz, mine, side):
        cell, first = _parts(tile, xyz, reach)
        _, one = np.unique(cell * 27 + side + 13, return_index=True)
        at = np.append(np.flatnonzero(mine), one[~mine[one]])
        yield at, [keys.take(pa.array(at)), keys.take(pa.array(first[at])), pa.array(mine[at])]

    return over_tiles(own, reach, key, kernel, [T.StructField(key, kind), T.StructField("part", kind), T.StructField("here", T.BooleanType())])
