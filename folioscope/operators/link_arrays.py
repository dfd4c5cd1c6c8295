"""Graphs whose links fit into one process as sorted arrays: neighbours, hops and the hash of the engine over arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Links that one process may hold (about 40 bytes a link while they are sorted, 8 afterwards).
ARRAY_LINKS = 12_000_000
#: Neighbours that a vertex tries one by one before all that remain are looked at together.
TRIES = 16
#: Links that are looked at together.
BLOCK = 1 << 21


def link_arrays(pairs: DataFrame, hubs_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, begin, near) of distinct links (src, dst), src < dst: the neighbours of vertex v are near[begin[v]:begin[v + 1]],
    rising. Vertices are numbered in the order of their names, or by falling degree."""
    table = pairs.select("src", "dst").toArrow()
    ends = [table.column(c).to_numpy().astype(np.int64, copy=False) for c in ("src", "dst")]
    del table
    names = np.unique(np.concatenate([np.unique(x) for x in ends]))
    src = np.searchsorted(names, ends[0]).astype(np.int32)
    dst = np.searchsorted(names, ends.pop()).astype(np.int32)
    ends.clear()
    if hubs_first:
        order = np.argsort(-(np.bincount(src, minlength=len(names)) + np.bincount(dst, minlength=len(names))), kind="stable")
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names), dtype=np.int32)
        names, src, dst = names[order], place[src], place[dst]
    n = len(names)
    codes = np.empty(2 * len(src), np.int64)
    codes[: len(src)], codes[len(src) :] = src, dst
    codes *= n
    codes[: len(src)] += dst
    codes[len(src) :] += src
    del src, dst
    codes.sort()
    begin = np.searchsorted(codes, np.arange(n + 1, dtype=np.int64) * n)
    near = np.empty(len(codes), np.int32)
    for at in range(0, len(codes), BLOCK):
        near[at : at + BLOCK] = codes[at : at + BLOCK] % max(n, 1)
    return names, begin, near


def places_of(begin: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    """Where the neighbours of some vertices stand, vertex after vertex."""
    n = begin[vertices + 1] - begin[vertices]
    return np.repeat(begin[vertices] - np.cumsum(n) + n, n) + np.arange(n.sum())


def hops_from(source: int, begin: np.ndarray, near: np.ndarray, alive: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Hops of each vertex from ``source`` over the links that are alive, -1 where none leads there. ``degree`` counts the
    links alive. A small front looks at its neighbours; for a large one the vertices not met yet look for a neighbour that
    was met, and stop at the first, so hubs should have the first numbers."""
    hops = np.full(len(degree), -1, np.int32)
    hops[source] = 0
    front, hop = np.array([source]), 0
    while len(front):
        hop += 1
        if int((begin[front + 1] - begin[front]).sum()) <= len(degree) // 4:
            places = places_of(begin, front)
            new = near[places[alive[places]]]
            new = new[hops[new] < 0]
        else:
            rest = np.flatnonzero((hops < 0) & (degree > 0))
            at, end, met = begin[rest], begin[rest + 1], []
            for _ in range(TRIES):
                ok = alive[at] & (hops[near[at]] >= 0)
                met.append(rest[ok])
                at = at + 1
                left = ~ok & (at < end)
                rest, at, end = rest[left], at[left], end[left]
            size = end - at
            bounds = np.searchsorted(np.cumsum(size), np.arange(BLOCK, int(size.sum()) + BLOCK, BLOCK)) if len(rest) else []
            first = 0
            for last in bounds:
                last = min(int(last) + 1, len(rest))
                if last > first:
                    n, a = size[first:last], at[first:last]
                    starts = np.cumsum(n) - n
                    places = np.repeat(a - starts, n) + np.arange(n.sum())
                    ok = alive[places] & (hops[near[places]] >= 0)
                    met.append(rest[first:last][np.logical_or.reduceat(ok, starts)])
                first = max(first, last)
            new = np.concatenate(met)
        hops[new] = hop
        front = np.flatnonzero(hops == hop)
    return hops


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def hash_of(*values: np.ndarray | int) -> np.ndarray:
    """What xxhash64 of the engine gives for columns of bigint (arrays) and int (plain numbers), as bigint."""
    code = np.array([42], np.uint64)
    with np.errstate(over="ignore"):
        for v in values:
            if isinstance(v, int):
                code = code + _P5 + np.uint64(4)
                code = _mixed(_turned(code ^ (np.uint64(v & 0xFFFFFFFF) * _P1), 23) * _P2 + _P3)
            else:
                code = code + _P5 + np.uint64(8)
                code = _mixed(_turned(code ^ (_turned(np.atleast_1d(v).astype(np.int64).view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4)
    return code.view(np.int64)


def one_of_each_hop(sources: np.ndarray, wanted: np.ndarray, names: np.ndarray, begin: np.ndarray, near: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """(source, hops, id): of the ``wanted`` vertices that a source (at most 64 of them, as numbers of vertices) reaches after
    so many hops the one with the least hash, then id. All sources go together, one bit each."""
    n = len(names)
    bits = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
    seen = np.zeros(n, np.uint64)
    np.bitwise_or.at(seen, sources, bits)
    front, every, hop = seen.copy(), np.bitwise_or.reduce(bits) if len(bits) else np.uint64(0), 0
    size = np.diff(begin)
    out = []
    while front.any():
        hop += 1
        new = np.zeros(n, np.uint64)
        at = np.flatnonzero(front)
        if int(size[at].sum()) * 8 < len(near):
            to, what = near[places_of(begin, at)], np.repeat(front[at], size[at])
            order = np.argsort(to, kind="stable")
            to, what = to[order], what[order]
            starts = np.flatnonzero(np.diff(to, prepend=-1))
            if len(to):
                new[to[starts]] = np.bitwise_or.reduceat(what, starts)
        else:
            first = 0
            while first < n:  # every vertex of a graph of links has a neighbour
                last = min(n, max(first + 1, int(np.searchsorted(begin, begin[first] + BLOCK))))
                new[first:last] = np.bitwise_or.reduceat(front[near[begin[first] : begin[last]]], begin[first:last] - begin[first])
                first = last
        front = new & ~seen
        seen |= front
        at = np.flatnonzero((front != 0) & wanted)
        what, ids = front[at], names[at]
        for bit, source in zip(bits, names[sources]):
            met = ids[(what & bit) != 0]
            if len(met):
                codes = hash_of(np.array([source]), met, seed)
                out.append((int(source), hop, int(met[codes == codes.min()].min())))
        if (seen == every).all():
            break
    return out


def _blocks(begin: np.ndarray):
    """(first, last) of runs of vertices with about BLOCK links, at least one vertex."""
    first, n = 0, len(begin) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(begin, begin[first] + BLOCK))))
        yield first, last
        first = last


def _summed(codes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, rising, with the sums of their values."""
    order = np.argsort(codes, kind="stable")
    codes, value = codes[order], value[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], np.add.reduceat(value, starts) if len(starts) else value[:0]


def moved_on_arrays(names: np.ndarray, begin: np.ndarray, near: np.ndarray, value: np.ndarray, resolution: float, moves: int) -> np.ndarray:
    """The community of each vertex, as the number of a vertex, after rounds of moves; the same as those of ``graph._moved``."""
    n = len(names)
    weight = np.add.reduceat(value, begin[:-1])
    m2 = weight.sum()
    own = np.arange(n)
    for turn in range(moves):
        total = np.bincount(own, weight, n)
        mine = hash_of(names, turn) & 1 == 0
        best, went = own.copy(), 0
        for first, last in _blocks(begin):
            here = np.flatnonzero(mine[first:last]) + first
            places = places_of(begin, here)
            v = np.repeat(here, begin[here + 1] - begin[here])
            other = near[places] != v
            v, places = v[other], places[other]
            # a vertex may always stay
            codes = np.concatenate([v * n + own[near[places]], here * n + own[here]])
            codes, w = _summed(codes, np.concatenate([value[places], np.zeros(len(here))]))
            v, c = np.divmod(codes, n)
            home = c == own[v]
            gain = w - resolution * (total[c] - np.where(home, weight[v], 0.0)) * weight[v] / m2
            order = np.lexsort((c, ~home, -gain, v))  # of each vertex the highest gain, its own community, the smallest
            pick = order[np.flatnonzero(np.diff(v[order], prepend=-1))]
            best[v[pick]] = c[pick]
            went += int((~home[pick]).sum())
        own = best
        if turn > 0 and went == 0:
            break
    return own


def contracted(begin: np.ndarray, near: np.ndarray, value: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sums) of the links between groups, both ways and with loops; a code is group times ``groups`` plus group."""
    codes, sums = np.empty(0, np.int64), np.empty(0)
    for first, last in _blocks(begin):  # added up block by block: all links at once would take several times their memory
        v = np.repeat(group[first:last], np.diff(begin[first : last + 1]))
        part = _summed(v * groups + group[near[begin[first] : begin[last]]], value[begin[first] : begin[last]])
        codes, sums = _summed(np.concatenate([codes, part[0]]), np.concatenate([sums, part[1]]))
    return codes, sums
