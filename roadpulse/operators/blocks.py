"""Nearest points inside one block of the spatial index, request by request.

A block is a cell with a bounded number of points.  Spark deals requests and
points to blocks; what is here measures one block's requests against its
points and tells how far the search has to reach beyond the block.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: requests measured at a time
STEP = 512
#: slack on the unit sphere (6 mm) for the rounding of chords
SLACK = 1e-9


def finder(carry: list[str], held: list[str], k: int, root: int, home: bool):
    """A function of a block's requests and points: the requests' ``carry``
    columns, ``_ub`` (the chord that the k nearest lie within), ``_done`` (no
    point outside of the block can be nearer) and ``_found``, the points'
    ``held`` columns of all that may be among the k nearest, at least k unless
    fewer lie within the request's ``_ub``.  With ``home`` requests that are
    not done get none.

    It uses nothing else of this package, so workers need not import it."""

    def one(column: pa.ChunkedArray) -> pa.Array:
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)

    def sides_of(asked: list[np.ndarray], code: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Distance of requests to the nearest side of their cell (below zero: outside)."""
        width, low = 2.0 ** (level - (root - 1)), (1 << root) - 1
        cells = (code >> 2 * root, (code >> root) & low, code & low)
        return np.min([np.minimum(v - (c * width - 1), (c + 1) * width - 1 - v) for v, c in zip(asked, cells)], axis=0)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("_pid", "ascending")], null_placement="at_start"))
        # points at one place: the first k ids of each stand for all
        place = right["_plat"].to_numpy() + 1j * right["_plon"].to_numpy()
        _, first, site = np.unique(place, return_index=True, return_inverse=True)
        site = site.reshape(-1)
        count = np.bincount(site, minlength=len(first))
        fill, start = np.minimum(count, k), np.cumsum(count) - count
        by_site = np.argsort(site, kind="stable")
        at = [right[f"_p{a}"].to_numpy()[first] for a in "xyz"]
        asked = [left[f"_{a}"].to_numpy() for a in "xyz"]
        given, level = left["_ub"].to_numpy(), left["_blevel"].to_numpy()
        sides = sides_of(asked, left["_bcode"].to_numpy(), level)
        reach, done, sizes, taken = [], [], [], []
        for a in range(0, left.num_rows, STEP):
            part = slice(a, a + STEP)
            away = sum((v[part, None] - p[None, :]) ** 2 for v, p in zip(asked, at))
            away[np.isnan(away)] = np.inf
            few = min(k, len(first))
            near = np.argpartition(away, few - 1, axis=1)[:, :few] if few < len(first) else np.tile(np.arange(few), (len(away), 1))
            dist = np.take_along_axis(away, near, 1)
            order = np.argsort(dist, axis=1)
            dist, full = np.take_along_axis(dist, order, 1), np.cumsum(fill[np.take_along_axis(near, order, 1)], axis=1) >= k
            kth = np.where(full.any(1), dist[np.arange(len(dist)), full.argmax(1)], np.inf)
            bound = np.minimum(np.sqrt(kth) + SLACK, given[part])
            over = (sides[part] >= bound + SLACK) | (level[part] == root)
            wanted = away <= (bound ** 2)[:, None]
            if home:
                wanted &= over[:, None]
            row, spot = np.nonzero(wanted)
            many = fill[spot]
            turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            taken.append(by_site[np.repeat(start[spot], many) + turn])
            sizes.append(np.bincount(row, many, len(away)).astype(np.int64))
            reach.append(bound)
            done.append(over)
        points = right.select(held).take(pa.array(np.concatenate(taken).astype(np.int64)))
        fields = [pa.field(c, points.schema.field(c).type) for c in held]
        values = pa.StructArray.from_arrays([one(points[c]) for c in held], fields=fields)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), values, type=pa.list_(pa.field("element", pa.struct(fields))))
        return pa.table([*(left[c] for c in carry), pa.array(np.concatenate(reach)), pa.array(np.concatenate(done)), lists],
                        names=[*carry, "_ub", "_done", "_found"])

    return find
