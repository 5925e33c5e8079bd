"""A weighted backoff automaton over the n-grams of one block of texts, and walks of many texts through it side by side."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Tokens of a piece; a longer text is walked in several pieces at once.
PIECE = 512


class Automaton(NamedTuple):
    """State 0 is the empty history, which has an arc for each of the block's token types. An arc is found by the number
    state * types + token; a state without one fails to the state without its first word, at a cost."""

    types: int
    keys: np.ndarray
    weights: np.ndarray
    ends: np.ndarray
    fail: np.ndarray
    cost: np.ndarray
    start: int


class Grams(NamedTuple):
    """The distinct n-grams of one length: how often training has them; the place in a list of such tables of their
    context (first words), of their ending (last words) and of their last token. The first table is of single tokens."""

    count: np.ndarray
    context: np.ndarray
    ending: np.ndarray
    token: np.ndarray


def build(tables: list[Grams], root: np.ndarray, prior: float, start: int) -> Automaton:
    """``root`` has the single tokens' probabilities, ``start`` is the token that stands before a text.

    An n-gram h of up to N - 1 tokens is a state if training has it n(h) > 0 times. It has an arc for each w after it that
    training has: (n(hw) + prior * p(w without h's first word)) / (n(h) + prior), and fails at prior / (n(h) + prior). An
    arc leads to the state of hw, or of its ending if hw is too long to be one.
    """
    order = len(tables)
    states, n = [], 1
    for table in tables[: order - 1]:
        seen = table.count > 0
        states.append(np.where(seen, n + np.cumsum(seen) - 1, 0))
        n += int(seen.sum())
    fail, cost = np.zeros(n, np.int64), np.zeros(n)
    for k, (table, ids) in enumerate(zip(tables, states)):
        own = ids > 0
        fail[ids[own]] = states[k - 1][table.ending[own]] if k else 0
        cost[ids[own]] = np.log10(prior / (table.count[own] + prior))
    types, likely = len(tables[0].count), root
    first = states[0] if states else np.zeros(types, np.int64)
    keys, weights, ends = [np.arange(types)], [np.log10(root)], [first]
    for k in range(1, order):
        table, shorter = tables[k], tables[k - 1]
        times = shorter.count[table.context]
        likely = np.where(times > 0, (table.count + prior * likely[table.ending]) / (times + prior), likely[table.ending])
        arc = table.count > 0
        keys.append(states[k - 1][table.context[arc]] * types + table.token[arc])
        weights.append(np.log10(likely[arc]))
        ends.append(states[k][arc] if k < order - 1 else states[k - 1][table.ending[arc]])
    key = np.concatenate(keys)
    by = np.argsort(key, kind="stable")
    return Automaton(types, key[by], np.concatenate(weights)[by], np.concatenate(ends)[by], fail, cost, int(first[start]))


def walk(machine: Automaton, tokens: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """The summed weights of each text's walk from left to right, the state carried from token to token.

    ``tokens`` are the texts' token types one after another. A state is decided by the last ``order`` - 1 tokens, so a
    long text is cut into pieces that first read so many tokens before them without counting, and all pieces walk at once.
    """
    first = np.cumsum(lengths) - lengths
    pieces = np.maximum(1, -(-lengths // PIECE))
    text = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[text] + number * PIECE
    end = np.minimum(begin + PIECE, first[text] + lengths[text])
    warm = np.minimum(order - 1, number * PIECE)
    at = begin - warm
    state = np.where(number * PIECE == warm, machine.start, 0)  # what begins at the text's begin starts as texts do
    total = np.zeros(len(text))
    by = np.argsort(at - end, kind="stable")  # pieces with most tokens first, so that those that still walk are in front
    at, end, begin, state = at[by], end[by], begin[by], state[by]
    sums = total[by]
    going = len(at)
    while True:
        going = int(np.searchsorted(-(end - at)[:going], 0, side="left")) if going else 0
        if not going:
            break
        counted = at[:going] >= begin[:going]
        token, now = tokens[at[:going]], state[:going]
        left = np.arange(going)
        while len(left):
            key = now[left] * machine.types + token[left]
            arc = np.searchsorted(machine.keys, key)
            hit = machine.keys[np.minimum(arc, len(machine.keys) - 1)] == key
            gain = np.where(hit, machine.weights[np.minimum(arc, len(machine.keys) - 1)], machine.cost[now[left]])
            sums[left] += np.where(counted[left], gain, 0.0)
            now[left] = np.where(hit, machine.ends[np.minimum(arc, len(machine.keys) - 1)], machine.fail[now[left]])
            left = left[~hit]
        at[:going] += 1
    total[by] = sums
    return np.bincount(text, weights=total, minlength=len(lengths))
