"""Exact search for the most similar earlier vector, by cells and angles.

Vectors of one epoch that are exact copies of one another are one place, a row with its members' times and names: it moves and is multiplied
once. The places of an epoch are dealt to a few parts by a hash, and those that ask go once to each part: what moves grows with the places, not
with their pairs. A task keeps a part in temporary files. It links places that stand close together in some order of their signs under fixed
projections and are within ``LINKED`` degrees; linked places are a group. Targets are put into blocks of about ``BLOCK`` places, queries too,
group by group; a block of each is in memory at a time. The targets of a group, or of a divided one, are a cell with a centre and a radius.

Queries meet their own group first. What they find there says how far away a better target may be. Angles obey the triangle inequality: a cell
whose centre is further from the centre of a group of queries than their angles to it, what they may still reach and the cell's radius together
holds nothing better for any of them. So far most cells are passed over in one product of centres; queries that found little are compared with
the centres one by one. What is left is compared by the cosine. Nothing is lost whatever the groups are; they decide how much is passed over.
Products are taken in single precision first; pairs that may be at the threshold, and no worse than what the query has, are multiplied again in
double precision.
"""

from __future__ import annotations

import math
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import times
from tidewatch.runtime import materialize

SETTLED, BLOCK, PART_PLACES = 25.0, 16_384, 1 << 21
# Orders of signs and signs in each, and how many neighbours in an order are compared at once; degrees for a link, and of the widest cell left whole.
TABLES, SIGNS, WINDOW, LINKED, WIDE = 8, 32, 64, 35.0, 40.0
# Degrees from a group's centre within which a query may stay with its group; pairs of centres left, as a share, at which all are multiplied.
TOGETHER, DENSE = 52.0, 1 / 16
# Pairs of places multiplied one by one at once; pairs of a cell from which they are one product.
PAIRS, TILE = 1 << 15, 4096
# Rows picked in a round of narrowing, and how many times as many it must settle for another round.
PICKED, GATHERED = 256, 1.25
# Shuffle partitions for each one of the session; tasks with blocks for each core, where there are blocks enough.
TASKS, PARTS = 4, 1
# Slices of time in an epoch; rows of queries and of targets in one product; against rounding, in radians.
EPOCH_SLICES, QUERY_ROWS, TARGET_ROWS, SLACK = 16, 1024, 1024, 1e-6
# Pairs of members compared at once; cells compared with queries at once; the error of a cosine in single precision, amply.
MEMBER_PAIRS, CELL_ROWS, COARSE = 1 << 20, 4096, 1e-5
# Pairs multiplied again one by one, as a share of a product; where there are more, the whole product is taken again.
AGAIN = 1 / 32
# Products after which what a target must reach is raised to what was found.
RAISED = 8


_WIDTHS = {2: np.dtype(np.int16), 4: np.dtype(np.int32), 8: np.dtype(np.float64), 5: np.dtype(np.float32)}


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of numbers, or of ``packed_raw`` values."""
    if pa.types.is_binary(column.type):
        return unpacked(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def packed_raw(column: pa.Array) -> pa.Array:
    """Lists of numbers, or nulls, as binary values of their own width, and the byte that says which."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    data = column.drop_null().flatten().to_numpy(zero_copy_only=False)
    data = np.ascontiguousarray(data, np.float32 if data.dtype == np.float32 else np.float64).reshape(int(known.sum()), -1 if known.any() else 0)
    rows = np.empty((len(data), data.shape[1] * data.itemsize + 1), np.uint8)
    rows[:, :-1], rows[:, -1] = data.view(np.uint8), 5 if data.itemsize == 4 else 8
    ends = np.append(0, np.cumsum(np.where(known, rows.shape[1], 0))).astype(np.int32)
    valid = pa.py_buffer(np.packbits(known, bitorder="little")) if not known.all() else None
    return pa.Array.from_buffers(pa.binary(), len(known), [valid, pa.py_buffer(ends), pa.py_buffer(rows)])


def packed(vectors: np.ndarray) -> pa.Array:
    """Rows as binary values: they move between Spark and Python as whole blocks, not number by number."""
    data = np.ascontiguousarray(vectors, dtype=np.float64)
    ends = np.arange(len(data) + 1, dtype=np.int64) * (data.shape[1] * 8 if data.ndim == 2 else 0)
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def packed_whole(vectors: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binary values of two, four or eight bytes a number, as each row needs, and the byte that says how many."""
    most = np.abs(vectors).max(axis=1, initial=0)
    width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    rows: list[bytes] = [b""] * len(vectors)
    for size, kind in list(_WIDTHS.items())[:3]:
        mine = np.flatnonzero(width == size)
        data, step, tag = vectors[mine].astype(kind).tobytes(), vectors.shape[1] * size, bytes([size])
        for k, row in enumerate(mine.tolist()):
            rows[row] = data[k * step : (k + 1) * step] + tag
    return pa.array(rows, pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    """Rows of ``packed`` or ``packed_whole`` values without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data, sizes = np.frombuffer(column.buffers()[2], np.uint8), np.diff(ends)
    if not len(sizes) or sizes[0] % 2 == 0:
        return data[ends[0] : ends[-1]].view(np.float64).reshape(len(column), -1)
    width = data[ends[1:] - 1]
    if (sizes == sizes[0]).all() and (width == width[0]).all():
        return np.ascontiguousarray(data[ends[0] : ends[-1]].reshape(len(sizes), -1)[:, :-1]).view(_WIDTHS[int(width[0])]).astype(np.float64)
    out = np.empty((len(sizes), int(sizes[0]) // _WIDTHS[int(width[0])].itemsize))
    for tag, kind in _WIDTHS.items():
        mine = np.flatnonzero(width == tag)
        if len(mine):
            at = ends[mine][:, None] + np.arange(out.shape[1] * kind.itemsize)
            out[mine] = data[at].view(kind)
    return out


def units(column: pa.Array) -> np.ndarray:
    """The directions of ``packed`` or ``packed_whole`` vectors."""
    rows = unpacked(column)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def reach_of(threshold: float) -> float:
    """The largest angle at which two vectors are similar enough."""
    return math.acos(min(max(threshold, -1.0), 1.0))


def narrow_cells(vectors: np.ndarray) -> np.ndarray:
    """A cell number for each row: within ``SETTLED`` degrees of one of the rows picked, in rounds over what is left.

    When a round settles hardly more than the rows it picked, there is nothing to gather and the rest is one wide cell.
    """
    cells, left, number = np.zeros(len(vectors), np.int64), np.arange(len(vectors)), 0
    least = math.cos(math.radians(SETTLED))
    while len(left):
        picked = left[:: -(-len(left) // PICKED)]
        scores = vectors[left] @ vectors[picked].T
        best = scores.argmax(axis=1)
        near = scores[np.arange(len(left)), best] >= least
        cells[left[near]] = number + best[near]
        number += len(picked)
        cells[left[~near]] = number
        left = left[~near]
        if near.sum() < GATHERED * len(picked):
            break
        number += 1
    return cells


class Cells:
    """Vectors grouped by cell, each cell with its centre and the largest angle to it."""

    def __init__(self, vectors: np.ndarray, numbers: np.ndarray | None = None) -> None:
        cells = narrow_cells(vectors) if numbers is None else numbers
        self.order = np.argsort(cells, kind="stable")
        self.vectors = vectors[self.order]
        self.single = self.vectors.astype(np.float32)
        self.starts = np.flatnonzero(np.diff(cells[self.order], prepend=cells.min() - 1))
        self.ends = np.append(self.starts[1:], len(cells))
        sums = np.add.reduceat(self.vectors, self.starts)
        self.centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        own = (self.vectors * np.repeat(self.centers, self.ends - self.starts, axis=0)).sum(axis=1)
        self.radius = np.arccos(np.clip(np.minimum.reduceat(own, self.starts), -1, 1))

    def tiles(self, queries: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, slice]]:
        """Rows of ``queries`` and slices of the ordered targets, that together hold every pair that may be within reach."""
        single = queries.astype(np.float32)
        near = np.empty((len(self.starts), len(queries)), bool)
        limit = np.cos(np.minimum(reach + self.radius + SLACK, math.pi)).astype(np.float32) - np.float32(COARSE)
        for c in range(0, len(self.starts), CELL_ROWS):
            centers = self.centers[c : c + CELL_ROWS].astype(np.float32)
            for q in range(0, len(queries), QUERY_ROWS):
                near[c : c + CELL_ROWS, q : q + QUERY_ROWS] = centers @ single[q : q + QUERY_ROWS].T >= limit[c : c + CELL_ROWS, None]
        for c in np.flatnonzero(near.any(axis=1)):
            every = np.flatnonzero(near[c])
            for first in range(0, len(every), QUERY_ROWS):
                for a in range(int(self.starts[c]), int(self.ends[c]), TARGET_ROWS):
                    yield every[first : first + QUERY_ROWS], slice(a, min(a + TARGET_ROWS, int(self.ends[c])))

    def products(self, queries: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """Rows of ``queries``, a slice of the ordered targets, and their cosines, for all that may be within reach."""
        for rows, part in self.tiles(queries, reach):
            yield rows, part, np.round(queries[rows] @ self.vectors[part].T, 9)

    def close(self, queries: np.ndarray, reach: float, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of ``queries``, positions of ordered targets, and cosines of all pairs of at least ``least``, a number per query that may
        rise meanwhile."""
        single = queries.astype(np.float32)
        for rows, part in self.tiles(queries, reach):
            yield from self._fit(queries, single, rows, part, least)

    def _fit(self, queries: np.ndarray, single: np.ndarray, rows: np.ndarray, part: slice, least: np.ndarray) -> Iterator[tuple]:
        coarse = single[rows] @ self.single[part].T
        a, b = np.nonzero(coarse >= (least[rows] - COARSE)[:, None].astype(np.float32))
        if not len(a):
            return
        if len(a) > AGAIN * coarse.size:
            cosine = (queries[rows] @ self.vectors[part].T)[a, b]
        else:
            cosine = np.einsum("ij,ij->i", queries[rows[a]], self.vectors[part.start + b])
        cosine = np.round(cosine, 9)
        fit = cosine >= least[rows[a]]
        if fit.any():
            yield rows[a[fit]], part.start + b[fit], cosine[fit]

    def close_pairs(self, queries: np.ndarray, single: np.ndarray, rows: np.ndarray, cells: np.ndarray, least: np.ndarray, may) -> Iterator[tuple]:
        """The same for pairs of a query and a cell; ``may`` tells of rows of queries and positions of targets which to look at."""
        order = np.argsort(cells, kind="stable")
        rows, cells = rows[order], cells[order]
        size = self.ends[cells] - self.starts[cells]
        firsts = np.flatnonzero(np.diff(cells, prepend=-1))
        counts = np.diff(np.append(firsts, len(cells)))
        big = counts * size[firsts] >= TILE
        for k in np.flatnonzero(big).tolist():
            every, c = rows[firsts[k] : firsts[k] + counts[k]], cells[firsts[k]]
            for first in range(0, len(every), QUERY_ROWS):
                for a in range(int(self.starts[c]), int(self.ends[c]), TARGET_ROWS):
                    yield from self._fit(queries, single, every[first : first + QUERY_ROWS], slice(a, min(a + TARGET_ROWS, int(self.ends[c]))), least)
        few = np.repeat(~big, counts)
        rows, starts, size = rows[few], self.starts[cells[few]], size[few]
        for first, last in _bounded(size, PAIRS):
            n = size[first:last]
            a = np.repeat(rows[first:last], n)
            b = np.repeat(starts[first:last] - (np.cumsum(n) - n), n) + np.arange(len(a))
            fit = may(a, b)
            a, b = a[fit], b[fit]
            fit = np.einsum("ij,ij->i", single[a], self.single[b]) >= least[a] - COARSE
            a, b = a[fit], b[fit]
            cosine = np.round(np.einsum("ij,ij->i", queries[a], self.vectors[b]), 9)
            fit = cosine >= least[a]
            if fit.any():
                yield a[fit], b[fit], cosine[fit]


def _bounded(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` at most, of one row at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")), first + 1)
        yield first, last
        first = last


def cells_of(vectors: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A cell number for each row: that of its group, or one of several where the group is wider than ``WIDE`` degrees around its centre."""
    _, numbers = np.unique(groups, return_inverse=True)
    angles, top = _own_angles(vectors, numbers)[1], int(numbers.max(initial=-1)) + 1
    wide = np.zeros(top, bool)
    wide[numbers[angles > math.radians(WIDE)]] = True
    for g in np.flatnonzero(wide).tolist():
        mine = np.flatnonzero(numbers == g)
        parts = narrow_cells(vectors[mine])
        numbers[mine] = top + parts
        top += int(parts.max()) + 1
    return numbers


def _own_angles(vectors: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centres of numbered groups, and each row's angle to its own."""
    order = np.argsort(numbers, kind="stable")
    starts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
    sums = np.add.reduceat(vectors[order], starts) if len(starts) else np.zeros((0, vectors.shape[1]))
    centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers, np.arccos(np.clip(np.einsum("ij,ij->i", vectors, centers[numbers]), -1, 1))


def sign_codes(vectors: np.ndarray) -> np.ndarray:
    """``TABLES`` numbers a row, each made of ``SIGNS`` signs under fixed projections."""
    planes = np.random.default_rng(5).normal(size=(vectors.shape[1], TABLES * SIGNS)).astype(np.float32)
    return np.packbits(vectors.astype(np.float32) @ planes > 0, axis=1).view(">u4").astype(np.uint32)


def groups_of(codes: np.ndarray, vectors: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A group number for each row: rows with the same codes, and rows that are within ``LINKED`` degrees and stand in one window of an order
    of codes, are in one group."""
    _, some, same = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    root, least, step = np.arange(len(some)), np.float32(math.cos(math.radians(LINKED))), max(1, QUERY_ROWS // window)
    for t in range(TABLES):
        order = np.argsort(codes[some, t], kind="stable")
        a, b = [], []
        for first in range(0, len(order), step * window):
            mine = order[first : first + step * window]
            x = np.zeros((-(-len(mine) // window) * window, vectors.shape[1]), np.float32)
            x[: len(mine)] = vectors[some[mine]]
            x = x.reshape(-1, window, x.shape[1])
            near = np.matmul(x, x.transpose(0, 2, 1)) >= least
            # each row is linked to the first of its window that is near, which may be itself
            to = (near.argmax(axis=2) + np.arange(len(x))[:, None] * window).ravel()[: len(mine)]
            linked = np.flatnonzero((to != np.arange(len(mine))) & near.any(axis=2).ravel()[: len(mine)])
            a.append(mine[linked])
            b.append(mine[to[linked]])
        _join(root, np.concatenate(a), np.concatenate(b))
    return root[same.ravel()]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a`` and ``b``, pair by pair; every row points to the root of its set, the smallest of it."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


_FIELDS = ["run", "epoch", "part", "query", "centroid", "members"]


class _Members:
    """The members of places, one after another: when each began, its name, its slice and its last one, and whose it is."""

    def __init__(self, column: pa.Array) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.count = column.value_lengths().to_numpy()
        self.start = np.cumsum(self.count) - self.count
        flat = column.flatten()
        self.us, self.slice, self.alive = (flat.field(c).to_numpy() for c in ("us", "slice", "alive"))
        self.nodes = np.array(flat.field("node").to_pylist(), dtype=object)


class _Targets:
    """The places of one block with their members, which are ranked by time, so that the first of equals is the earliest."""

    def __init__(self, rows: pa.Table, groups: np.ndarray | None = None) -> None:
        vectors = units(rows.column("centroid"))
        self.cells = c = Cells(vectors, None if groups is None else cells_of(vectors, groups))
        self.members = m = _Members(rows.column("members"))
        self.rank = np.empty(len(m.us), np.int64)
        self.rank[sorted(range(len(m.us)), key=lambda k: (m.us[k], m.nodes[k]))] = np.arange(len(m.us))
        # of the ordered places, and of the cells
        self.first, self.last = np.minimum.reduceat(m.us, m.start)[c.order], np.maximum.reduceat(m.alive, m.start)[c.order]
        self.cell_group = None if groups is None else groups[c.order][c.starts]

    def head(self) -> "_Head":
        return _Head(
            self.cells.centers.astype(np.float32), self.cells.radius, self.cell_group,
            np.minimum.reduceat(self.first, self.cells.starts), np.maximum.reduceat(self.last, self.cells.starts),
        )

    def write(self, path: str) -> None:
        """Plain arrays, as the classes of this module travel to tasks by value; the vectors in files of their own, of which only the rows in use are read."""
        cells = dict(vars(self.cells))
        for name in ("vectors", "single"):
            np.save(f"{path}.{name}.npy", cells.pop(name))
        with open(path, "wb") as f:
            pickle.dump((cells, vars(self.members), self.rank, self.first, self.last, self.cell_group), f, protocol=5)

    @classmethod
    def read(cls, path: str) -> "_Targets":
        out = cls.__new__(cls)
        out.cells, out.members = Cells.__new__(Cells), _Members.__new__(_Members)
        with open(path, "rb") as f:
            cells, members, out.rank, out.first, out.last, out.cell_group = pickle.load(f)
        vars(out.cells).update(cells, **{name: np.load(f"{path}.{name}.npy", mmap_mode="r") for name in ("vectors", "single")})
        vars(out.members).update(members)
        return out

    def best(self, rows: pa.RecordBatch, threshold: float) -> Iterator[tuple]:
        """``src, dst, us, cosine`` of the queries that have an earlier live target at the threshold."""
        queries = _Queries(rows)
        return self.better(queries, np.arange(len(queries.units)), threshold)

    def better(self, queries: "_Queries", asked: np.ndarray, threshold: float) -> Iterator[tuple]:
        """The same of the members of some places, where the target here is no worse than what they have."""
        least = queries.least(threshold)[asked]
        found = ((asked[a], b, cosine) for a, b, cosine in self.cells.close(queries.units[asked], reach_of(threshold), least))
        yield from self._taken(queries, found, lambda: least.__setitem__(slice(None), queries.least(threshold)[asked]))

    def better_pairs(self, queries: "_Queries", rows: np.ndarray, cells: np.ndarray, threshold: float) -> Iterator[tuple]:
        """The same of pairs of a place and a cell."""
        least = queries.least(threshold)
        found = self.cells.close_pairs(
            queries.units, queries.single, rows, cells, least, lambda a, b: (self.first[b] <= queries.last[a]) & (queries.first[a] <= self.last[b])
        )
        yield from self._taken(queries, found, lambda: least.__setitem__(slice(None), queries.least(threshold)))

    def _taken(self, queries: "_Queries", found: Iterator[tuple], raise_least) -> Iterator[tuple]:
        mine, theirs, best = queries.members, self.members, queries.best
        who, n = np.full(len(mine.us), -1), 0
        for a, b, cosine in found:
            b = self.cells.order[b]
            # as many pairs of places as have a bounded number of pairs of members, one at least
            for first, last in _bounded(mine.count[a] * theirs.count[b], MEMBER_PAIRS):
                self._meet(mine, a[first:last], b[first:last], cosine[first:last], best, who)
            n += 1
            if n % RAISED == 0:
                raise_least()
        for k in np.flatnonzero(who >= 0):
            yield mine.nodes[k], theirs.nodes[who[k]], int(theirs.us[who[k]]), float(best[k])

    def _meet(self, mine: _Members, a: np.ndarray, b: np.ndarray, cosine: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        """Members of places ``a`` take members of places ``b`` that began before them and live, if these are better than what they have."""
        theirs = self.members
        n = mine.count[a] * theirs.count[b]
        pair = np.repeat(np.arange(len(a)), n)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        q = mine.start[a][pair] + within // theirs.count[b][pair]
        t = theirs.start[b][pair] + within % theirs.count[b][pair]
        before = theirs.us[t] < mine.us[q]
        same = np.flatnonzero(theirs.us[t] == mine.us[q])
        if len(same):
            before[same] = theirs.nodes[t[same]] < mine.nodes[q[same]]
        fit = np.flatnonzero(before & (theirs.slice[t] <= mine.slice[q]) & (mine.slice[q] <= theirs.alive[t]))
        q, t, cosine = q[fit], t[fit], cosine[pair[fit]]
        order = np.lexsort((self.rank[t], -cosine, q))
        order = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
        q, t, cosine = q[order], t[order], cosine[order]
        # one of another block that is as similar is left to the end to decide
        better = (cosine > best[q]) | ((cosine == best[q]) & ((who[q] < 0) | (self.rank[t] < self.rank[who[q]])))
        best[q[better]], who[q[better]] = cosine[better], t[better]


class _Queries:
    """The places of a batch that ask, and how similar the best target is that each of their members has."""

    def __init__(self, rows: pa.RecordBatch | pa.Table) -> None:
        self.units = units(rows.column("centroid"))
        self.single = self.units.astype(np.float32)
        self.members = m = _Members(rows.column("members"))
        self.best = np.full(len(m.us), -np.inf)
        self.first, self.last = np.minimum.reduceat(m.slice, m.start), np.maximum.reduceat(m.us, m.start)

    def least(self, threshold: float) -> np.ndarray:
        """What a target must reach to be of use to any member of a place."""
        return np.maximum(np.minimum.reduceat(self.best, self.members.start), threshold)


class _Head:
    """What tells of the cells of a block which of them a query may need."""

    def __init__(self, centers: np.ndarray, radius: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.centers, self.radius, self.group, self.first, self.last = centers, radius, group, first, last

    def write(self, path: str) -> None:
        with open(path, "wb") as f:
            pickle.dump((self.centers, self.radius, self.group, self.first, self.last), f, protocol=5)

    @classmethod
    def read(cls, path: str) -> "_Head":
        with open(path, "rb") as f:
            return cls(*pickle.load(f))

    def within(self, queries: _Queries, rows: np.ndarray, cells: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which pairs of a place and a cell may hold something better; ``reach`` is of all places."""
        fit = np.zeros(len(rows), bool)
        for a in range(0, len(rows), PAIRS):
            r, c = rows[a : a + PAIRS], cells[a : a + PAIRS]
            some = np.flatnonzero((self.first[c] <= queries.last[r]) & (queries.first[r] <= self.last[c]))
            r, c = r[some], c[some]
            limit = np.cos(np.minimum(reach[r] + self.radius[c] + SLACK, math.pi).astype(np.float32)) - np.float32(COARSE)
            fit[a + some[np.einsum("ij,ij->i", queries.single[r], self.centers[c]) >= limit]] = True
        return fit


class _Probes:
    """Groups of queries with a centre and how far from it something better may be; queries that reach far are alone."""

    def __init__(self, queries: _Queries, groups: np.ndarray, threshold: float) -> None:
        self.reach = np.arccos(np.clip(queries.least(threshold), -1, 1))
        known, numbers = np.unique(groups, return_inverse=True)
        centers, own = _own_angles(queries.units, numbers)
        far = own + self.reach
        alone = far > math.radians(TOGETHER)
        most = np.full(len(known), -1.0)
        np.maximum.at(most, numbers[~alone], far[~alone])
        kept = most >= 0
        single = np.flatnonzero(alone)
        self.rows = np.concatenate([np.flatnonzero(~alone)[np.argsort(numbers[~alone], kind="stable")], single])
        self.count = np.concatenate([np.bincount(numbers[~alone], minlength=len(known))[kept], np.ones(len(single), np.int64)])
        self.start = np.cumsum(self.count) - self.count
        self.group = np.concatenate([known[kept], groups[single]])
        self.far = np.concatenate([most[kept], self.reach[single]]) + SLACK
        # one product tells whether the cosine of two centres is at least that of the sum of two angles
        both = np.concatenate([centers[kept], queries.units[single]])
        self.centers = np.concatenate([both, -np.cos(self.far)[:, None], np.sin(self.far)[:, None]], axis=1).astype(np.float32)

    def near(self, head: _Head) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Pairs of a place and a cell of another group, and whether there were so many that all are to be multiplied."""
        cells = np.concatenate([head.centers, np.cos(head.radius)[:, None], np.sin(head.radius)[:, None]], axis=1).astype(np.float32)
        always = head.radius + self.far.max(initial=0.0) >= math.pi
        for p in range(0, len(self.centers), QUERY_ROWS):
            near = self.centers[p : p + QUERY_ROWS] @ cells.T >= -COARSE
            near[:, always] = True
            a, c = np.nonzero(near)
            a += p
            other = self.group[a] != head.group[c]
            a, c = a[other], c[other]
            dense = len(a) > DENSE * near.size
            if dense:
                mine = np.arange(self.start[p], self.start[min(p + QUERY_ROWS, len(self.start)) - 1] + self.count[min(p + QUERY_ROWS, len(self.start)) - 1])
                yield self.rows[mine], c[:0], True
                continue
            for first, last in _bounded(self.count[a], MEMBER_PAIRS):
                n = self.count[a[first:last]]
                at = np.repeat(self.start[a[first:last]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield self.rows[at], np.repeat(c[first:last], n), False


class _Rows:
    """Rows in a temporary file, in the order they came, and then group by group."""

    def __init__(self, folder: str, name: str) -> None:
        self.path, self.writer, self.sizes, self.parts = os.path.join(folder, name), None, [], []

    def add(self, batch: pa.RecordBatch) -> None:
        if self.writer is None:
            self.writer = pa.ipc.new_file(self.path, batch.schema)
        self.writer.write_batch(batch)
        self.sizes.append(batch.num_rows)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.writer is not None:
            self.writer.close()
            with pa.memory_map(self.path) as file:
                reader = pa.ipc.open_file(file)
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    def regroup(self, numbers: np.ndarray) -> "_Rows":
        """Rows with consecutive numbers from 0 to be read by number."""
        out, done = _Rows(os.path.dirname(self.path), os.path.basename(self.path) + "-grouped"), 0
        for batch in self.batches():
            mine = numbers[done : done + batch.num_rows]
            order = np.argsort(mine, kind="stable")
            out.add(batch.take(pa.array(order)))
            out.parts.append((mine[order], done + order))
            done += batch.num_rows
        out.writer.close()
        os.remove(self.path)
        out.file = pa.memory_map(out.path)
        out.reader = pa.ipc.open_file(out.file)
        return out

    def get(self, number: int) -> tuple[pa.Table, np.ndarray]:
        """The rows of a number and where they were."""
        slices, places = [], []
        for i, (mine, at) in enumerate(self.parts):
            a, b = np.searchsorted(mine, [number, number + 1])
            if a < b:
                slices.append(self.reader.get_batch(i).slice(a, b - a))
                places.append(at[a:b])
        return pa.Table.from_batches(slices).combine_chunks(), np.concatenate(places)


def _blocks(groups: np.ndarray, block: int) -> np.ndarray:
    """A block number for each row, from 0 without gaps: small groups stay whole, large ones are cut."""
    order, half = np.argsort(groups, kind="stable"), max(1, block // 2)
    firsts = np.flatnonzero(np.diff(groups[order], prepend=-1))
    start = np.repeat(firsts, np.diff(np.append(firsts, len(groups))))
    numbers = np.empty(len(groups), np.int64)
    numbers[order] = start // half + (np.arange(len(groups)) - start) // half
    return np.unique(numbers, return_inverse=True)[1]


class _Part:
    """The targets and queries of a part in temporary files of the task; one block of each is in memory."""

    def __init__(self, block: int, window: int) -> None:
        self.block, self.window, self.folder = block, window, tempfile.TemporaryDirectory()
        self.kept = [_Rows(self.folder.name, "targets"), _Rows(self.folder.name, "queries")]
        self.codes: list[list[np.ndarray]] = [[], []]

    def _path(self, name: str) -> str:
        return os.path.join(self.folder.name, name)

    def add(self, rows: pa.RecordBatch, query: bool) -> None:
        self.kept[query].add(rows)

    def best(self, threshold: float) -> Iterator[list[tuple]]:
        """``src, dst, us, cosine`` of the queries that have an earlier live target at the threshold, some at a time."""
        n_targets, n_queries = (sum(k.sizes) for k in self.kept)
        if not n_targets or not n_queries:
            return
        if n_targets <= self.block:
            targets = _Targets(pa.Table.from_batches(list(self.kept[0].batches())).combine_chunks())
            for batch in self.kept[1].batches():
                yield list(targets.best(batch, threshold))
            return
        groups = self._groups(n_targets + n_queries)
        theirs, mine = groups[:n_targets], groups[n_targets:]
        spans = self._write_blocks(theirs)
        numbers = _blocks(mine, self.block)
        queries = self.kept[1].regroup(numbers)
        for k in range(int(numbers.max()) + 1):
            rows, at = queries.get(k)
            yield from self._met(_Queries(rows), mine[at], spans, threshold)

    def _groups(self, n: int) -> np.ndarray:
        codes, done = np.empty((n, TABLES), np.uint32), 0
        with open(self._path("units"), "wb") as f:
            for rows in self.kept:
                for batch in rows.batches():
                    vectors = units(batch.column("centroid")).astype(np.float32)
                    codes[done : done + len(vectors)] = sign_codes(vectors)
                    done += len(vectors)
                    f.write(np.ascontiguousarray(vectors).data)
        vectors = np.memmap(self._path("units"), np.float32, "r", shape=(n, os.path.getsize(self._path("units")) // (4 * n)))
        groups = groups_of(codes, vectors, self.window)
        del vectors
        os.remove(self._path("units"))
        return groups

    def _write_blocks(self, groups: np.ndarray) -> list[tuple[int, int]]:
        """The first and last group of each block of targets."""
        numbers, spans = _blocks(groups, self.block), []
        targets = self.kept[0].regroup(numbers)
        for k in range(int(numbers.max()) + 1):
            rows, at = targets.get(k)
            block = _Targets(rows, groups[at])
            block.write(self._path(f"block{k}"))
            block.head().write(self._path(f"head{k}"))
            spans.append((int(groups[at].min()), int(groups[at].max())))
        return spans

    def _met(self, queries: _Queries, groups: np.ndarray, spans: list[tuple[int, int]], threshold: float) -> Iterator[list[tuple]]:
        reach = np.full(len(groups), reach_of(threshold))
        for k, (low, high) in enumerate(spans):
            if groups.min() <= high and low <= groups.max():
                head = _Head.read(self._path(f"head{k}"))
                order = np.argsort(head.group, kind="stable")
                first, last = (np.searchsorted(head.group[order], groups, side) for side in ("left", "right"))
                n = last - first
                own = np.flatnonzero(n)
                if not len(own):
                    continue
                block = _Targets.read(self._path(f"block{k}"))
                if n.sum() > DENSE * len(own) * len(order) and n.sum() > TILE:
                    yield list(block.better(queries, own, threshold))
                    continue
                rows = np.repeat(np.arange(len(n)), n)
                cells = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(rows))]
                fit = head.within(queries, rows, cells, reach)
                yield list(block.better_pairs(queries, rows[fit], cells[fit], threshold))
        probes = _Probes(queries, groups, threshold)
        for k in range(len(spans)):
            head, block = _Head.read(self._path(f"head{k}")), None
            for rows, cells, dense in probes.near(head):
                fit = slice(None) if dense else head.within(queries, rows, cells, probes.reach)
                if not len(rows[fit]):
                    continue
                block = block or _Targets.read(self._path(f"block{k}"))
                yield list(block.better(queries, rows, threshold) if dense else block.better_pairs(queries, rows[fit], cells[fit], threshold))

    def close(self) -> None:
        self.folder.cleanup()


def _search(thresholds: dict[str, float], block: int, window: int):
    """Rows by part, targets before queries, to the best targets of each query in the part."""
    names = ["run", "src", "dst", "us", "cosine"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()]

    def told(key: tuple | None, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part:
            for found in part.best(thresholds[key[0]]):
                columns = list(zip(*found)) or [()] * (len(names) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), types[0]), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names=names)
            part.close()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
                cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    *now, query = keys[a]
                    if now != key:
                        yield from told(key, part)
                        key, part = now, _Part(block, window)
                    part.add(batch.slice(a, b - a).select(["centroid", "members"]), query)
            yield from told(key, part)
        finally:
            if part:
                part.close()

    return search


def most_similar_before(vectors: DataFrame, thresholds: dict[str, float], reach: Column, block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """``run, src, dst``: each of ``run, node, us, slice, alive, centroid`` and the most similar one at its run's threshold that began before
    it (by ``us``, then ``node``) and whose life, from ``slice`` to ``alive``, holds its slice. Of equals the earliest.

    ``centroid`` holds ``packed`` or ``packed_whole`` vectors, of which the direction counts. ``reach``, the angle of the run's threshold, is what
    ``thresholds`` say as well and is not read. ``vectors`` is read several times: a written table.
    """
    member = F.struct("us", "node", "slice", "alive")
    last = times.floor_div(F.col("alive"), EPOCH_SLICES)
    spans = F.sequence(times.floor_div(F.col("slice"), EPOCH_SLICES), last)
    # places alive in an epoch; those with a member that began in it ask in it
    # dealt by what places are told by but their epoch, so vectors move before they are taken into several
    targets = _places(vectors.repartition("run", "centroid").withColumn("epoch", F.explode(spans)), member)
    targets = materialize(targets, "targets")
    sizes = materialize(targets.groupBy("run", "epoch").agg(F.count(F.lit(1)).alias("places")), "sizes")
    spark = vectors.sparkSession
    least = math.ceil(PARTS * spark.sparkContext.defaultParallelism / max(sizes.count(), 1))
    sizes = sizes.select("run", "epoch", F.greatest(F.lit(least), F.ceil(F.col("places") / PART_PLACES)).cast("int").alias("parts"))
    placed = targets.join(sizes, ["run", "epoch"])
    held = placed.withColumns({"query": F.lit(False), "part": F.pmod(F.xxhash64("centroid"), F.col("parts")).cast("int")}).select(*_FIELDS)
    mine = F.filter("members", lambda m: times.floor_div(m["slice"], EPOCH_SLICES) == F.col("epoch"))
    queries = placed.withColumn("members", mine).filter(F.size("members") > 0).withColumn("query", F.lit(True))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*_FIELDS)
    # parts are few and dear, so they are dealt to more tasks than there are parts a core
    tasks = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = held.unionByName(queries).repartition(tasks, "run", "epoch", "part").sortWithinPartitions("run", "epoch", "part", "query")
    found = rows.mapInArrow(_search(thresholds, block, window), "run string, src string, dst string, us bigint, cosine double")
    # of equally similar ones the earliest, which keeps the trees flat
    best = F.min(F.struct((-F.col("cosine")).alias("cosine"), "us", "dst")).alias("best")
    return found.groupBy("run", "src").agg(best).select("run", "src", "best.dst")


def _places(vectors: DataFrame, member: Column) -> DataFrame:
    """``run, epoch, centroid, members``: exact copies of an epoch in one row."""
    return vectors.groupBy("run", "epoch", "centroid").agg(F.collect_list(member).alias("members"))
