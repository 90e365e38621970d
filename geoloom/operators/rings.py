"""Which rings of two blocks meet: whole rings side by side, each pair judged once.

Most pairs are settled by cells: where a cell lies inside one ring as a whole, and the other ring fills it too or has a
vertex there, the two meet. For what is left, the edges that reach into both rings' boxes are compared exactly, and where
none touch, a vertex of each is put into the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CELLS = 32  # cells along a side of the square that is drawn, two tiles wide
STRIP = 1 << 20  # pairs of rings compared by their boxes at a time
MOST = 1 << 20  # edges of pairs of rings, and pairs of edges, held at a time; or those of one pair, and those of one edge
BATCH = 1 << 16  # rows of a batch that is returned
FAR = 1 << 31  # coordinates of rings that are compared differ by less, so that products of differences fit a long


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ranges: its number, and its places, one after the other."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    return own, np.arange(len(own)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Block:
    """Rings of a tile, with their boxes; a table's last five columns are the ring and lists of its edges' x0, y0, x1 and y1, an edge at least."""

    def __init__(self, table: pa.Table, origin: tuple[int, int], side: int):
        self.ring, *lists = [c.combine_chunks() for c in table.columns[-5:]]
        self.start = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
        x0, y0, x1, y1 = (c.flatten().to_numpy().astype(np.int64) - origin[i % 2] for i, c in enumerate(lists))
        self.ends = x0, y0, x1, y1
        self.low, self.high = (np.minimum(x0, x1), np.minimum(y0, y1)), (np.maximum(x0, x1), np.maximum(y0, y1))
        self.box = [f.reduceat(v, self.start[:-1]) for f, of in ((np.minimum, self.low), (np.maximum, self.high)) for v in of]
        if max(abs(int(v.min())) for v in self.box) >= FAR // 2 or max(abs(int(v.max())) for v in self.box) >= FAR // 2:
            raise ValueError(f"rings that lie in one tile differ by {FAR} or more")
        self.first = [(v >= 0) & (v < side) for v in self.box[:2]]  # the box begins in the tile, not before it
        self.full, self.sure = self._drawn(2 * side / CELLS)

    def _drawn(self, cell: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each ring, the cells inside it that no edge touches; and those with the ones that hold a vertex."""
        n, own = len(self.ring), np.repeat(np.arange(len(self.ring)), np.diff(self.start))
        x0, y0, x1, y1 = self.ends
        at = lambda v: np.clip(np.floor(v / cell), -1, CELLS).astype(np.int64)
        # An edge passes each row of cells between two places, a unit more is taken as touched.
        low, high = np.maximum(at(self.low[1] - 1), 0), np.minimum(at(self.high[1] + 1), CELLS - 1)
        e, row = _ragged(low, np.maximum(high - low + 1, 0))
        rise = (y1 - y0)[e]
        flat = rise == 0
        along = lambda y: x0[e] + (np.clip(y, self.low[1][e], self.high[1][e]) - y0[e]) * ((x1 - x0)[e] / np.where(flat, 1, rise))
        a, b = np.where(flat, x0[e], along(row * cell - 1)), np.where(flat, x1[e], along((row + 1) * cell + 1))
        left, right = at(np.minimum(a, b) - 1), at(np.maximum(a, b) + 1)
        seen = (right >= 0) & (left < CELLS)
        wide, line = CELLS + 1, (own[e] * CELLS + row) * (CELLS + 1)
        shape = (n, CELLS, wide)
        count = lambda places, **k: np.bincount(places, minlength=n * CELLS * wide, **k).reshape(shape)
        touched = count(line[seen] + np.maximum(left[seen], 0)) - count(line[seen] + np.minimum(right[seen] + 1, CELLS))
        touched = np.cumsum(touched, axis=2)[:, :, :CELLS] > 0
        # A cell's centre is inside if the edges that cross its line to the right are odd in number.
        centre = (row + 0.5) * cell
        over = (y0[e] > centre) != (y1[e] > centre)
        place = at(along(centre))[over]
        odd = count((line[over] + np.maximum(place, 0))[place >= 0])
        odd = np.cumsum(odd[:, :, ::-1], axis=2)[:, :, ::-1][:, :, 1:] % 2 == 1
        full = odd & ~touched
        sure = full.copy()
        gx, gy = at(x0), at(y0)
        drawn = (gx >= 0) & (gx < CELLS) & (gy >= 0) & (gy < CELLS)
        sure[own[drawn], gy[drawn], gx[drawn]] = True
        return full.reshape(n, -1).astype(np.float32), sure.reshape(n, -1).astype(np.float32)


def _reaching(block: Block, i: np.ndarray, box: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the rings i that reach into their boxes: the pair's number and the edge's place, in order."""
    own, e = _ragged(block.start[i], np.diff(block.start)[i])
    keep = (block.low[0][e] <= box[2][own]) & (block.high[0][e] >= box[0][own]) & (block.low[1][e] <= box[3][own]) & (block.high[1][e] >= box[1][own])
    return own[keep], e[keep]


def _cross(a: Block, b: Block, e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The places at which edge e of a and edge f of b touch."""
    near = np.flatnonzero((a.low[0][e] <= b.high[0][f]) & (b.low[0][f] <= a.high[0][e]) & (a.low[1][e] <= b.high[1][f]) & (b.low[1][f] <= a.high[1][e]))
    (x0, y0, x1, y1), (u0, v0, u1, v1) = (c[e[near]] for c in a.ends), (c[f[near]] for c in b.ends)
    turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    meets = turn(x0, y0, x1, y1, u0, v0) * turn(x0, y0, x1, y1, u1, v1) <= 0
    return near[meets & (turn(u0, v0, u1, v1, x0, y0) * turn(u0, v0, u1, v1, x1, y1) <= 0)]


def _touching(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether an edge of ring i of a touches one of ring j of b."""
    box = [f(p[i], q[j]) for f, p, q in zip((np.maximum, np.maximum, np.minimum, np.minimum), a.box, b.box, strict=True)]
    found = np.zeros(len(i), bool)
    (own, e), (other, f) = _reaching(a, i, box), _reaching(b, j, box)
    sizes = np.bincount(other, minlength=len(i))
    starts = np.cumsum(sizes) - sizes
    # A pair's first edges come first, then twice as many more: most pairs that meet do so soon.
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    turn = np.log2(rank // 2 + 1).astype(int)
    for now in range(turn.max(initial=-1) + 1):
        some = np.flatnonzero(turn == now)
        some = some[~found[own[some]]]
        upto = np.cumsum(sizes[own[some]])
        for part in np.split(some, np.searchsorted(upto, np.arange(MOST, upto[-1] if len(upto) else 0, MOST))):
            at, place = _ragged(starts[own[part]], sizes[own[part]])
            found[own[part[at[_cross(a, b, e[part[at]], f[place])]]]] = True
    return found


def _held(a: Block, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether ring i of a holds the place (x, y): a ray to the right crosses its edges an odd number of times."""
    own, e = _ragged(a.start[i], np.diff(a.start)[i])
    over = (a.ends[1][e] > y[own]) != (a.ends[3][e] > y[own])
    own, e = own[over], e[over]
    x0, y0, x1, y1 = (c[e] for c in a.ends)
    side = (x[own] - x0) * (y1 - y0) - (y[own] - y0) * (x1 - x0)
    return np.bincount(own[np.where(y1 > y0, side < 0, side > 0)], minlength=len(i)) % 2 == 1


def _pairs(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places i in a and j in b of rings that meet, if the boxes' common part begins in the tile; same: b is a, and i < j."""
    done = []
    step = max(STRIP // max(len(b.ring), 1), 1)
    for at in range(0, len(a.ring), step):
        s = slice(at, at + step)
        lows, highs = [v[s, None] for v in a.box[:2]], [v[s, None] for v in a.box[2:]]
        near = (a.first[0][s, None] | b.first[0]) & (a.first[1][s, None] | b.first[1])
        for k in (0, 1):
            near &= (lows[k] <= b.box[2 + k]) & (b.box[k] <= highs[k])
        if same:
            near &= np.arange(len(a.ring))[s, None] < np.arange(len(b.ring))
        sure = near & ((a.full[s] @ b.sure.T + a.sure[s] @ b.full.T) > 0)
        i, j = np.nonzero(sure)
        done.append((i + at, j))
        i, j = np.nonzero(near & ~sure)
        upto = np.cumsum(np.diff(a.start)[i + at] + np.diff(b.start)[j])
        cuts = np.searchsorted(upto, np.arange(MOST, upto[-1] if len(upto) else 0, MOST))
        for left, right in zip(np.split(i + at, cuts), np.split(j, cuts), strict=True):
            met = _touching(a, b, left, right)
            rest = np.flatnonzero(~met)
            li, rj = left[rest], right[rest]
            met[rest] = _held(a, li, *(c[b.start[rj]] for c in b.ends[:2])) | _held(b, rj, *(c[a.start[li]] for c in a.ends[:2]))
            done.append((left[met], right[met]))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, int), np.zeros(0, int))


def meeting(tile: int, once: bool):
    """For a cogroup by tile and blocks (tx, ty, i, j): ring, other. once: the blocks are of one table, and i = j is one block."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("ring", left.schema.field("ring").type), ("other", right.schema.field("other").type)])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        tx, ty, i, j = (k.as_py() for k in key)
        same = once and i == j
        a = Block(left, (tx * tile, ty * tile), tile)
        b = a if same else Block(right, (tx * tile, ty * tile), tile)
        at, to = _pairs(a, b, same)
        parts = [[a.ring.take(pa.array(at[p : p + BATCH])), b.ring.take(pa.array(to[p : p + BATCH]))] for p in range(0, len(at), BATCH)]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=schema) for x in parts], schema)

    return run
