"""A hierarchical navigable small-world graph over the vectors of one shard, as flat neighbour arrays.

Nodes are numbered by descending level, so that each layer's nodes are the first ones and a layer is a plain matrix of
neighbours (-1: none). Many nodes or queries walk a layer side by side in numpy; each walk is its own beam.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

#: Neighbours of a node in an upper layer (twice as many in the lowest), and beams while building and searching.
LINKS, BUILD_BEAM, BEAM = 20, 80, 160
#: Nodes that are inserted, and queries that walk, side by side.
BATCH = 256
#: A layer of so many nodes is compared as a whole instead of walked.
FEW = 192


class Graph(NamedTuple):
    """``points`` (nodes x width, float32) and the layers, lowest first; layer l holds the nodes below its row count."""

    points: np.ndarray
    layers: list[np.ndarray]


def level_counts(n: int, seed: int) -> list[int]:
    """How many nodes have at least level 0, 1, ...: each rises with probability 1 / LINKS."""
    levels = np.floor(-np.log(np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(int) if n else np.zeros(0, int)
    return [int((levels >= k).sum()) for k in range(levels.max(initial=0) + 1)]


def _distance(points: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances (rows x k) of each row's own ids to its vector in ``to``."""
    gap = points[ids] - to[:, None, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


def _beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (rows x width, -1 and inf beyond) that beams of ``width`` find among nodes below ``limit``.

    ``starts`` (rows x s) are where each row begins; all that are not -1 must differ.
    """
    n = len(queries)
    ids, far, done = np.full((n, width), -1), np.full((n, width), np.inf, np.float32), np.ones((n, width), bool)
    seen = np.zeros((n, limit + 1), bool)  # the last column takes the -1s
    seen[:, limit] = True
    s = min(width, starts.shape[1])
    there = starts[:, :s] >= 0
    ids[:, :s] = starts[:, :s]
    far[:, :s] = np.where(there, _distance(points, np.maximum(starts[:, :s], 0), queries), np.inf)
    done[:, :s] = ~there
    np.put_along_axis(seen, np.where(there, starts[:, :s], limit), True, 1)
    row = np.arange(n)
    while len(row):
        open_ = np.where(done[row], np.inf, far[row])
        at = open_.argmin(1)
        go = np.isfinite(open_[np.arange(len(row)), at])
        row, at = row[go], at[go]
        if not len(row):
            break
        done[row, at] = True
        near = links[ids[row, at]]
        near = np.where((near >= 0) & (near < limit), near, limit)
        fresh = ~seen[row[:, None], near]
        seen[row[:, None], near] = True
        d = np.where(fresh, _distance(points, np.where(fresh, near, 0), queries[row]), np.inf)
        better = (d < far[row].max(1)[:, None]).any(1)
        r, near, d = row[better], near[better], d[better]
        if len(r):
            all_d, all_i = np.concatenate((far[r], d), 1), np.concatenate((ids[r], near), 1)
            all_done = np.concatenate((done[r], np.isinf(d)), 1)
            best = np.argpartition(all_d, width - 1, 1)[:, :width]
            ids[r], far[r], done[r] = np.take_along_axis(all_i, best, 1), np.take_along_axis(all_d, best, 1), np.take_along_axis(all_done, best, 1)
    by = np.argsort(far, 1, kind="stable")
    ids, far = np.take_along_axis(ids, by, 1), np.take_along_axis(far, by, 1)
    return np.where(np.isinf(far), -1, ids), far


def _spread(points: np.ndarray, ids: np.ndarray, far: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates in ascending distance (-1: none), at most ``keep``: first those that are nearer to the
    row's vector than to each one taken before, so that links lead to all sides, then the nearest others."""
    n, k = ids.shape
    out = np.full((n, keep), -1)
    for a in range(0, n, 64):
        i, d = ids[a : a + 64], far[a : a + 64]
        x = points[np.maximum(i, 0)]
        norm = np.einsum("ijk,ijk->ij", x, x)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        taken, blocked = np.zeros(i.shape, bool), i < 0
        for j in range(k):
            now = ~blocked[:, j] & (taken.sum(1) < keep)
            taken[:, j] = now
            blocked |= now[:, None] & (between[:, j] < d)
        rank = np.where(i < 0, 2 * k, np.where(taken, 0, k)) + np.arange(k)
        order = np.argsort(rank, 1)[:, :keep]
        best = np.take_along_axis(i, order, 1)
        out[a : a + 64, : best.shape[1]] = best
    return out


def _link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Adds the new nodes to the lists of those that they chose; a list that overflows is chosen anew."""
    to, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
    source, to = source[to >= 0], to[to >= 0]
    apart = ~(links[to] == source[:, None]).any(1)  # two of a batch may have chosen each other
    source, to = source[apart], to[apart]
    if not len(to):
        return
    gap = points[source] - points[to]
    d = np.einsum("ij,ij->i", gap, gap)
    by = np.lexsort((d, to))
    to, source, d = to[by], source[by], d[by]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    m = links.shape[1]
    have = (links[targets] >= 0).sum(1)
    room = np.repeat(have, count) + place < m
    full = have + count > m
    fits = room & ~np.repeat(full, count)
    links[to[fits], (np.repeat(have, count) + place)[fits]] = source[fits]
    if full.any():
        over = targets[full]
        mine = np.repeat(full, count) & (place < m)  # of more new ones than a list holds, the nearest
        extra = np.full((len(over), m), -1)
        extra[np.searchsorted(over, to[mine]), place[mine]] = source[mine]
        both = np.concatenate((links[over], extra), 1)
        far = np.where(both >= 0, _distance(points, np.maximum(both, 0), points[over]), np.inf)
        order = np.argsort(far, 1, kind="stable")
        links[over] = _spread(points, np.take_along_axis(both, order, 1), np.take_along_axis(far, order, 1), m)


def _descend(graph_layers: list[np.ndarray], points: np.ndarray, queries: np.ndarray, down_to: int) -> np.ndarray:
    """The node (rows x 1) at which each query enters layer ``down_to``, from the upper layers; node 0 is the top."""
    at = np.zeros((len(queries), 1), int)
    for links in reversed(graph_layers[down_to + 1 :]):
        at = _beam(points, links, queries, at, 4, len(links))[0][:, :1]
    return at


def _reachable(links: np.ndarray) -> np.ndarray:
    """Which nodes a walk from node 0 can reach."""
    seen = np.zeros(len(links) + 1, bool)
    front = np.zeros(min(1, len(links)), int)
    while len(front):
        seen[front] = True
        near = np.unique(links[front])
        front = near[~seen[near] & (near >= 0)]
    return seen[:-1]


def _join_up(points: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The links with further columns through which every node is reached.

    Lists that overflow may drop the only link to a node. Such a node is linked from the nearest one of its own
    neighbours that is reached; if none is, from node 0, so that each round reaches more.
    """
    while not (seen := _reachable(links)).all():
        lost = np.flatnonzero(~seen)
        own = links[lost]
        far = np.where((own >= 0) & seen[own], _distance(points, np.maximum(own, 0), points[lost]), np.inf)
        best = far.argmin(1)
        some = np.isfinite(far[np.arange(len(lost)), best])
        if some.any():
            lost, source = lost[some], own[some, best[some]]
        else:
            lost, source = lost[:1], np.zeros(1, int)
        by = np.argsort(source, kind="stable")
        targets, first, count = np.unique(source[by], return_index=True, return_counts=True)
        place = np.arange(len(by)) - np.repeat(first, count) + np.repeat((links[targets] >= 0).sum(1), count)
        more = int(place.max()) + 1 - links.shape[1]
        if more > 0:
            links = np.concatenate((links, np.full((len(links), more), -1)), 1)
        links[source[by], place] = lost[by]
    return links


def build(points: np.ndarray, seed: int = 0) -> Graph:
    """The graph over ``points``; no two should be equal, as equal ones would link to one another alone.

    Layers are built from the top. A batch of nodes walks the part of the layer that is there, its nodes also meet each
    other; then each links to the chosen ones among what it found, and they link back.
    """
    points = np.ascontiguousarray(points, np.float32)
    counts = level_counts(len(points), seed)
    layers: list[np.ndarray] = [np.zeros((0, 0), int)] * len(counts)
    for level in range(len(counts) - 1, -1, -1):
        n, m = counts[level], LINKS * (2 if level == 0 else 1)
        links = np.full((n, m), -1)
        done = 0
        while done < n:
            size = min(n - done, max(16, min(BATCH, done)))
            new = np.arange(done, done + size)
            mine = points[new]
            if done <= FEW:
                ids = np.broadcast_to(np.arange(done), (size, done))
                far = _distance(points, ids, mine)
            else:
                known = counts[level + 1] if level + 1 < len(counts) else 0
                start = _descend(layers, points, mine, level) if 0 < known <= done else np.zeros((size, 1), int)
                ids, far = _beam(points, links, mine, start, BUILD_BEAM, done)
            mates = np.broadcast_to(new, (size, size))
            apart = _distance(points, mates, mine)
            np.fill_diagonal(apart, np.inf)
            ids, far = np.concatenate((ids, np.where(np.isinf(apart), -1, mates)), 1), np.concatenate((far, apart), 1)
            by = np.argsort(far, 1, kind="stable")[:, :BUILD_BEAM]
            ids, far = np.take_along_axis(ids, by, 1), np.take_along_axis(far, by, 1)
            chosen = _spread(points, ids, far, LINKS)
            links[new, :LINKS] = chosen
            _link_back(points, links, new, chosen)
            done += size
        layers[level] = _join_up(points, links)
    return Graph(points, layers)


def search(graph: Graph, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """For each query the ids of the nearest nodes found (rows x at most max(k, beam)), nearest first, -1 beyond."""
    n, beam = len(graph.points), max(k, beam)
    queries = np.ascontiguousarray(queries, np.float32)
    if n <= beam:
        far = _distance(graph.points, np.broadcast_to(np.arange(n), (len(queries), n)), queries) if n else np.zeros((len(queries), 0))
        return np.argsort(far, 1, kind="stable")
    found = [np.zeros((0, beam), int)]
    for a in range(0, len(queries), BATCH):
        q = queries[a : a + BATCH]
        found.append(_beam(graph.points, graph.layers[0], q, _descend(graph.layers, graph.points, q, 0), beam, n)[0])
    return np.concatenate(found)
