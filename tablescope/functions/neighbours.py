"""Numpy helpers of the anomaly detectors: kd cuts of the space, nearest points inside one leaf or region, isolation trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

CHUNK = 256
# Points per cell of a search inside a region, and per box that a region tells the others about.
CELL, BOX = 96, 512
# Allowance for rounding where boxes and balls decide what is looked at.
SLACK = 1 + 1e-9


class KdTree:
    """Median cuts of bounded samples; leaves that hold too many points are split again from a sample of their own.

    Nodes are (dim, cut, left, right); a negative child -l - 1 is leaf l. ``home`` gives the box and the weight of the
    smallest part of the tree around a leaf that holds enough points for a search.
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[list] = []
        self.leaves = 0
        self.above: dict[int, tuple[int, int]] = {}  # leaf: its node and side
        self.root = self._grow(sample, leaves)
        self.home: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.lo = self.hi = np.zeros((0, 0))

    def _grow(self, points: np.ndarray, want: int) -> int:
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        dim = int(np.argmax(spread))
        if want < 2 or len(points) < 2 or spread[dim] == 0:
            self.leaves += 1
            return -self.leaves
        cut = float(np.median(points[:, dim]))
        right = points[:, dim] > cut
        if not right.any():
            cut = float(np.max(points[points[:, dim] < cut, dim]))
            right = points[:, dim] > cut
        at = len(self.nodes)
        self.nodes.append([dim, cut, 0, 0])
        for side, part, share in ((2, points[~right], want // 2), (3, points[right], want - want // 2)):
            child = self.nodes[at][side] = self._grow(part, share)
            if child < 0:
                self.above[-child - 1] = at, side
        return at

    def split(self, leaf: int, points: np.ndarray, want: int) -> bool:
        """Cut a leaf in about ``want`` parts; false if its sample has too few different points."""
        before = len(self.nodes)
        child = self._grow(points, max(2, want))
        if len(self.nodes) == before:
            return False
        if self.root == -leaf - 1:
            self.root = child
        else:
            at, side = self.above.pop(leaf)
            self.nodes[at][side] = child
        return True

    def settle(self, leaf: dict[int, tuple[float, np.ndarray, np.ndarray]], enough: float) -> None:
        """From (weight, least, most coordinates) of every leaf that holds points: its box, and ``home`` of the leaves below ``enough`` weight."""
        if leaf:
            self.lo = np.full((self.leaves, len(next(iter(leaf.values()))[1])), np.inf)
            self.hi = -self.lo
            for number, (_, lo, hi) in leaf.items():
                self.lo[number], self.hi[number] = lo, hi
        stack, order = [(self.root, [])], []
        while stack:  # every leaf with the nodes above it
            at, above = stack.pop()
            if at < 0:
                order.append((-at - 1, above))
            else:
                stack += [(self.nodes[at][2], [*above, at]), (self.nodes[at][3], [*above, at])]
        part: dict[int, tuple] = {}
        for number, above in order:
            if number in leaf:
                for at in above:
                    w, lo, hi = part.get(at, (0, np.inf, -np.inf))
                    part[at] = w + leaf[number][0], np.minimum(lo, leaf[number][1]), np.maximum(hi, leaf[number][2])
        for number, above in order:
            if number in leaf and leaf[number][0] < enough:
                at = next((at for at in reversed(above) if part[at][0] >= enough), None)
                if at is not None:
                    self.home[number] = part[at][1:]

    def farthest(self, leaf: np.ndarray, x: np.ndarray, norm: str) -> np.ndarray:
        """Distance within which a point surely finds enough others: to the farthest corner of its leaf's home; infinite without."""
        out = np.full(len(x), np.inf)
        for i, number in enumerate(leaf.tolist()):
            if number in self.home:
                lo, hi = self.home[number]
                gap = np.maximum(np.abs(x[i] - lo), np.abs(hi - x[i]))
                out[i] = gap.max() if norm == "max" else np.sqrt((gap * gap).sum())
        return out * (1 + 1e-12)

    def touches(self, x: np.ndarray, radius: np.ndarray, leaf: np.ndarray, norm: str) -> np.ndarray:
        """Does the box of the leaf's points come within ``radius`` (rounding allowed for) of the row? An empty leaf has none."""
        gap = np.maximum(np.maximum(self.lo[leaf] - x, x - self.hi[leaf]), 0.0)
        far = gap.max(axis=1) if norm == "max" else np.sqrt((gap * gap).sum(axis=1))
        return np.isfinite(far) & (far <= radius * (1 + 1e-9))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            if at < 0:
                out[rows] = -at - 1
                continue
            dim, cut, left, right = self.nodes[at]
            high = x[rows, dim] > cut
            stack += [(child, part) for child, part in ((left, rows[~high]), (right, rows[high])) if len(part)]
        return out

    def leaves_in_reach(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf whose half-spaces come within ``radius`` of the row."""
        rows_out, leaf_out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            if at < 0:
                rows_out.append(rows)
                leaf_out.append(np.full(len(rows), -at - 1))
                continue
            dim, cut, left, right = self.nodes[at]
            gap = x[rows, dim] - cut
            stack += [(child, part) for child, part in ((left, rows[gap <= radius[rows]]), (right, rows[-gap <= radius[rows]])) if len(part)]
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def nearest(queries, query_ids, points, ids, weights, k, norm="euclid"):
    """For each query the closest points until their weights reach k: (query index, point index, distance).

    A point's own copies (weight - 1) count as neighbours at distance 0.
    """
    qi, pi, ds = [], [], []
    take = min(len(points), k + 1)
    for start in range(0, len(queries), CHUNK):
        q = queries[start:start + CHUNK]
        d2 = np.zeros((len(q), len(points)))
        for j in range(points.shape[1]):
            gap = q[:, j:j + 1] - points[None, :, j]
            d2 = np.maximum(d2, np.abs(gap)) if norm == "max" else d2 + gap ** 2
        near = np.argpartition(d2, take - 1, axis=1)[:, :take] if take < len(points) else np.tile(np.arange(len(points)), (len(q), 1))
        dist = np.take_along_axis(d2, near, axis=1)
        dist = dist if norm == "max" else np.sqrt(dist)
        order = np.lexsort((ids[near], dist), axis=1)
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        own = ids[near] == query_ids[start:start + len(q), None]
        w = weights[near] - own
        before = np.cumsum(w, axis=1) - w
        keep = (before < k) & (w > 0)
        r, c = np.nonzero(keep)
        qi.append(r + start)
        pi.append(near[r, c])
        ds.append(dist[r, c])
    return np.concatenate(qi), np.concatenate(pi), np.concatenate(ds)


def pack(**columns: np.ndarray) -> bytes:
    """Columns of one region as compressed Arrow bytes."""
    out = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(v) for v in columns.values()], list(columns))
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack(parts: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of one or several packed parts, one after the other."""
    tables = [pa.ipc.open_stream(p).read_all() for p in parts]
    return {c: np.concatenate([t[c].to_numpy() for t in tables]) for c in (tables[0].column_names if tables else ())}


def cells(x: np.ndarray, size: int, around: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, cell, box) of the points in that order: median cuts down to ``size`` points; a box is the first part of at most ``around``.

    A cut does not part equal values, unless all of a cell's points are the same.
    """
    order, cell, box = [], [], []
    stack, n_cells, n_boxes = [(np.arange(len(x)), -1)], 0, 0
    while stack:
        rows, inside = stack.pop()
        if inside < 0 and len(rows) <= around:
            inside, n_boxes = n_boxes, n_boxes + 1
        part = x[rows]
        spread = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= size or not spread.max() > 0:
            if len(rows):
                if inside < 0:
                    inside, n_boxes = n_boxes, n_boxes + 1
                order.append(rows)
                cell.append(np.full(len(rows), n_cells, np.int32))
                box.append(np.full(len(rows), inside, np.int32))
                n_cells += 1
            continue
        v = part[:, int(np.argmax(spread))]
        cut = np.partition(v, len(v) // 2)[len(v) // 2]
        low, upto = v < cut, v <= cut
        left = low if abs(int(low.sum()) - len(v) // 2) <= abs(int(upto.sum()) - len(v) // 2) and low.any() or upto.all() else upto
        stack += [(rows[~left], inside), (rows[left], inside)]
    if not order:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(order), np.concatenate(cell), np.concatenate(box)


def runs(label: np.ndarray) -> np.ndarray:
    """Where the runs of equal labels start, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [len(label)]]) if len(label) else np.zeros(1, np.int64)


def boxes(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most coordinates of every run."""
    if len(starts) < 2:
        return np.zeros((0, x.shape[1])), np.zeros((0, x.shape[1]))
    return np.minimum.reduceat(x, starts[:-1]), np.maximum.reduceat(x, starts[:-1])


def between(lo: np.ndarray, hi: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray) -> np.ndarray:
    """Squared distance of every box (or point, if lo is hi) to every other."""
    out = np.zeros((len(lo), len(to_lo)))
    for j in range(lo.shape[1]):
        gap = np.maximum(np.maximum(to_lo[None, :, j] - hi[:, None, j], lo[:, None, j] - to_hi[None, :, j]), 0.0)
        out += gap * gap
    return out


def across(lo: np.ndarray, hi: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray) -> np.ndarray:
    """Squared distance of the farthest corners of every two boxes."""
    out = np.zeros((len(lo), len(to_lo)))
    for j in range(lo.shape[1]):
        gap = np.maximum(to_hi[None, :, j] - lo[:, None, j], hi[:, None, j] - to_lo[None, :, j])
        out += gap * gap
    return out


def enough(far: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Per row the least of the distances ``far`` within which the boxes weigh more than ``k``; infinite if all weigh less."""
    order = np.argsort(far, axis=1)
    reached = np.cumsum(weight[order], axis=1) > k
    first = np.where(reached.any(axis=1), reached.argmax(axis=1), -1)
    return np.where(first >= 0, np.take_along_axis(far, np.take_along_axis(order, first[:, None], axis=1), axis=1)[:, 0], np.inf)


class Region:
    """The points of one region, cell by cell (the first ``own`` of them), and points of others near it."""

    def __init__(self, x: np.ndarray, w: np.ndarray, cell: np.ndarray, guests: np.ndarray, guest_w: np.ndarray, k: int):
        order, guest_cell, _ = cells(guests, CELL, BOX)
        self.own, self.order, self.k = len(x), order, k
        self.x, self.w = np.concatenate([x, guests[order]]), np.concatenate([w, guest_w[order]])
        own = runs(cell)
        self.starts = np.concatenate([own, len(x) + runs(guest_cell)[1:]])
        self.cells = len(own) - 1
        self.lo, self.hi = boxes(self.x, self.starts)
        # equal distances are taken in the order of the coordinates, wherever the points lie
        self.rank = np.empty(len(self.x), np.int64)
        self.rank[np.lexsort(self.x.T[::-1])] = np.arange(len(self.x))
        self.weight = np.add.reduceat(self.w, self.starts[:-1])

    def bounds(self) -> np.ndarray:
        """Squared distance within which a point of the region finds enough others in its cell, or in the cells nearest to it."""
        out = np.full(self.own, np.inf)
        poor = []
        for c in range(self.cells):
            a, b = self.starts[c], self.starts[c + 1]
            if b - a > self.k:
                out[a:b] = np.partition(self._gaps(a, b, np.arange(a, b)), self.k, axis=1)[:, self.k]
            else:
                poor.append(c)
        for at in range(0, len(poor), CHUNK):
            c = np.array(poor[at:at + CHUNK])
            far = enough(across(self.lo[c], self.hi[c], self.lo, self.hi), self.weight, self.k) * SLACK
            for i, r in zip(c, far, strict=True):
                out[self.starts[i]:self.starts[i + 1]] = r
        return out

    def _gaps(self, a: int, b: int, near: np.ndarray) -> np.ndarray:
        out = np.zeros((b - a, len(near)))
        for j in range(self.x.shape[1]):
            gap = self.x[a:b, j:j + 1] - self.x[near, j][None]
            gap *= gap
            out += gap
        return out

    def lists(self, reach: np.ndarray, exact: bool, touched: bool = False):
        """Per piece of a cell (row, point, squared distance, weight) of the nearest points until their weights reach k, by row and distance.

        ``reach`` bounds the squared distances; if ``exact``, it is the k-th itself. With ``touched``, only cells that
        guests can change. A point's own copies (weight - 1) count at distance 0.
        """
        k = self.k
        most = np.maximum.reduceat(reach, self.starts[:self.cells])
        for first in range(0, self.cells, CHUNK):
            some = np.arange(first, min(first + CHUNK, self.cells))
            close = between(self.lo[some], self.hi[some], self.lo, self.hi) <= most[some, None] * SLACK
            for c, hit in zip(some, close, strict=True):
                if touched and not hit[self.cells:].any():
                    continue
                near = np.concatenate([np.arange(self.starts[i], self.starts[i + 1]) for i in np.flatnonzero(hit)])
                near = near[np.argsort(self.rank[near])]
                step = max(1, (1 << 22) // len(near))
                for a in range(self.starts[c], self.starts[c + 1], step):
                    b = min(a + step, self.starts[c + 1])
                    gaps = self._gaps(a, b, near)
                    limit = reach[a:b, None] if exact else np.partition(gaps, k, axis=1)[:, k:k + 1] if len(near) > k else np.inf
                    row, col = np.nonzero(gaps <= limit)
                    d = gaps[row, col]
                    order = np.lexsort((d, row))
                    row, point, d = row[order] + a, near[col[order]], d[order]
                    w = self.w[point] - (point == row)
                    there = w > 0
                    row, point, d, w = row[there], point[there], d[there], w[there]
                    upto = np.cumsum(w)
                    begin = np.searchsorted(row, np.arange(a, b))
                    before = upto - w - np.concatenate([[0], upto])[begin][row - a]
                    kept = before < k
                    yield a, b, row[kept], point[kept], d[kept], np.minimum(w[kept], k - before[kept])


def kth(region: Region, reach: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
    """Squared distance to the k-th nearest of every point of the region, infinite where there are too few; ``found`` holds where guests change nothing."""
    out = np.full(region.own, np.inf) if found is None else found.copy()
    for a, b, row, _, d, w in region.lists(reach, exact=False, touched=found is not None):
        most, total = np.zeros(b - a), np.zeros(b - a)
        np.maximum.at(most, row - a, d)
        np.add.at(total, row - a, w)
        out[a:b] = np.where(total >= region.k, most, np.inf)
    return out


def density(region: Region, reach: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Local reachability density from the k-th distances of all points, guests included."""
    out = np.zeros(region.own)
    for a, b, row, point, d, w in region.lists(reach, exact=True):
        at = row - a
        sums = np.bincount(at, w * np.maximum(np.sqrt(d), distance[point]), b - a)
        out[a:b] = 1.0 / (sums / np.bincount(at, w, b - a) + 1e-10)
    return out


def outlier_factor(region: Region, reach: np.ndarray, lrd: np.ndarray) -> np.ndarray:
    """Mean density of the neighbours over the own one."""
    out = np.zeros(region.own)
    for a, b, row, point, _, w in region.lists(reach, exact=True):
        at = row - a
        out[a:b] = np.bincount(at, w * lrd[point], b - a) / np.bincount(at, w, b - a) / lrd[a:b]
    return out


class Boxes:
    """Boxes of all regions, region by region: which of them do the balls of a region's points reach?"""

    def __init__(self, region: np.ndarray, box: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        order = np.lexsort((box, region))
        self.region, self.box, self.w, self.lo, self.hi = region[order], box[order], w[order], lo[order], hi[order]
        self.starts = runs(self.region)
        self.numbers = self.region[self.starts[:-1]]
        self.all_lo, self.all_hi = np.minimum.reduceat(self.lo, self.starts[:-1]), np.maximum.reduceat(self.hi, self.starts[:-1])

    def asks(self, number: int, x: np.ndarray, cell: np.ndarray, reach: np.ndarray, k: int):
        """(region, its boxes reached, least, most coordinates wanted of each) for every other region that a ball reaches.

        A ball also shrinks to the nearest box that holds enough points for the search.
        """
        starts = runs(cell)
        lo, hi = boxes(x, starts)
        most = np.maximum.reduceat(reach, starts[:-1])
        reach, open_ = reach.copy(), np.flatnonzero(np.isinf(most))
        for c in open_:
            far = enough(across(lo[c:c + 1], hi[c:c + 1], self.lo, self.hi), self.w, k)[0] * SLACK
            a, b = starts[c], starts[c + 1]
            reach[a:b] = np.minimum(reach[a:b], far)
            most[c] = reach[a:b].max()
        near = between(lo, hi, self.all_lo, self.all_hi) <= most[:, None] * SLACK
        met = [s for s in np.flatnonzero(near.any(axis=0)) if self.numbers[s] != number]
        poking = {}
        for s in met:
            rows = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in np.flatnonzero(near[:, s])])
            rows = rows[between(x[rows], x[rows], self.all_lo[s:s + 1], self.all_hi[s:s + 1])[:, 0] <= reach[rows] * SLACK]
            poking[s] = rows
            part = np.arange(self.starts[s], self.starts[s + 1])
            part = part[self.w[part] > k]
            for at in range(0, len(rows) if len(part) else 0, CHUNK * 16):
                r = rows[at:at + CHUNK * 16]
                reach[r] = np.minimum(reach[r], across(x[r], x[r], self.lo[part], self.hi[part]).min(axis=1) * SLACK)
        for s, rows in poking.items():
            part = np.arange(self.starts[s], self.starts[s + 1])
            want_lo, want_hi = np.full((len(part), x.shape[1]), np.inf), np.full((len(part), x.shape[1]), -np.inf)
            for at in range(0, len(rows), CHUNK * 16):
                r = rows[at:at + CHUNK * 16]
                hit, b = np.nonzero(between(x[r], x[r], self.lo[part], self.hi[part]) <= reach[r, None] * SLACK)
                ball = np.sqrt(reach[r[hit]])[:, None] * SLACK + 1e-15 * np.abs(x[r[hit]])
                np.minimum.at(want_lo, b, x[r[hit]] - ball)
                np.maximum.at(want_hi, b, x[r[hit]] + ball)
            asked = np.flatnonzero(want_lo[:, 0] < np.inf)
            if len(asked):
                yield int(self.numbers[s]), self.box[part[asked]], want_lo[asked], want_hi[asked]


def path_length(n):
    """Average depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        big = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def isolation_tree(x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth value); a leaf has feature -1."""
    rng = np.random.default_rng(seed)
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes: list = []

    def grow(rows, depth):
        at = len(nodes)
        nodes.append(None)
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_dims = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) < 2 or len(open_dims) == 0:
            nodes[at] = (-1, 0.0, -1, -1, depth + float(path_length(len(rows))))
            return at
        dim = int(rng.choice(open_dims))
        cut = float(rng.uniform(lo[dim], hi[dim]))
        left = x[rows, dim] <= cut
        a = grow(rows[left], depth + 1)
        b = grow(rows[~left], depth + 1)
        nodes[at] = (dim, cut, a, b, 0.0)
        return at

    grow(np.arange(len(x)), 0)
    return nodes


def isolation_score(trees, sample_size: int, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean depth / expected depth): near 1 is isolated."""
    total = np.zeros(len(x))
    for feature, cut, left, right, depth in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = np.where(x[rows, f[rows]] <= cut[here], left[here], right[here])
        total += depth[at]
    return 2.0 ** (-(total / len(trees)) / max(float(path_length(sample_size)), 1e-9))
