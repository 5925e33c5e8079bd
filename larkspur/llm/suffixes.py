"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, and content anchors."""

from __future__ import annotations

import numpy as np

from .bytesarr import BASE, BYTE_CODE, mix

#: Bytes hashed for an anchor.
GRAM = 64
_TOP = np.uint64(2**64 - 1)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of ``width``, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of content-chosen anchors, and for every start the hash of the anchor of the string there.

    Every string of ``length`` bytes inside a row holds an anchor, and equal strings hold equal anchors at equal
    places: an anchor is a GRAM-byte hash that is the least of all in some such string.
    """
    n, width = len(buf), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h, base, k = BYTE_CODE[buf], BASE, 1
    while k < GRAM:
        h = h[:-k] * base + h[k:]
        with np.errstate(over="ignore"):
            base = base * base
        k *= 2
    h = mix(h)
    h[h == _TOP] -= np.uint64(1)
    for end in offsets[1:]:
        h[max(0, end - GRAM + 1) : end] = _TOP
    low = _sliding(h, width, np.minimum)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        low[max(a, b - length + 1) : b] = 0
    pad = np.zeros(len(h) + width - 1, np.uint64)
    pad[width - 1 : width - 1 + len(low)] = low
    at = np.flatnonzero((_sliding(pad, width, np.maximum) == h) & (h != _TOP))
    return at, h[at], low


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``symbols`` (ints under 256) in order; a 0 ends a piece, and suffixes are compared up to it.

    Larsson-Sadakane: a first sort on eight symbols, then every group that is still unsorted is refined by the ranks a
    doubled distance ahead, until ``depth``; sorted groups are left alone. Equal suffixes stand in the order of places.
    """
    n = len(symbols)
    order = np.arange(n, dtype=np.int32)
    if not n:
        return order
    places = np.arange(n, dtype=np.int32)
    ends = symbols == 0
    stop = np.minimum.accumulate(np.where(ends, places, np.int32(n))[::-1])[::-1]  # of each place, the end of its piece
    key = np.zeros(n, np.uint64)
    padded = np.append(symbols, np.zeros(8, symbols.dtype))
    alive = np.ones(n, bool)
    for k in range(8):
        alive &= padded[k : k + n] != 0
        key <<= np.uint64(8)
        key |= np.where(alive, padded[k : k + n], 0).astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    head = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=head[1:])
    del key, padded, alive
    rank = np.zeros(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, places, 0)) + 1
    rank[:n][ends] = 0
    h = 8
    while h < depth:
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(slots):
            break
        members = order[slots]
        pair = rank[members].astype(np.int64) * (n + 1) + rank[np.minimum(members + h, stop[members])]
        by = np.argsort(pair)
        pair, members = pair[by], members[by]
        order[slots] = members
        changed = np.ones(len(slots), bool)
        np.not_equal(pair[1:], pair[:-1], out=changed[1:])
        head[slots] = changed
        rank[members] = slots[np.maximum.accumulate(np.where(changed, np.arange(len(slots)), 0))] + 1
        rank[:n][ends] = 0
        h *= 2
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    members = order[slots]
    order[slots] = members[np.argsort(rank[members].astype(np.int64) * (n + 1) + members)]
    return order


def kasai(symbols: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in ``order``, counted up to ``most``.

    Kasai's walk, in which the prefix shrinks by at most one from a position to the next, runs over all pieces
    [starts, ends) at once, one lane each.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int16)
    padded = np.append(symbols, np.zeros(1, symbols.dtype))
    at, stop = starts.copy(), ends.copy()
    have = np.zeros(len(at), np.int64)
    live = at < stop
    at, stop, have = at[live], stop[live], have[live]
    while len(at):
        other = before[at]
        x, y = at + have, other + have
        same = (other >= 0) & (have < most) & (x < n) & (y < n)
        ahead = padded[np.minimum(x, n)]
        same &= (ahead != 0) & (ahead == padded[np.minimum(y, n)])
        have = have + same
        done = ~same
        out[at[done]] = have[done]
        have = np.where(done, np.maximum(have - 1, 0), have)
        at = at + done
        if (gone := at >= stop).any():
            keep = ~gone
            at, stop, have = at[keep], stop[keep], have[keep]
    return out
