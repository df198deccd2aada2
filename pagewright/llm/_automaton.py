"""A suffix automaton of several sequences of numbers, and the streaming of others through it.

States are those of the generalised automaton: each holds the strings that end at
the same places of all sequences. It is built with dictionaries, in one pass, and
frozen into arrays; streams are read in lockstep, many pieces of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

NONE = -1
#: Tokens that one piece of a stream reads in lockstep with the others.
LANE = 256


class Builder:
    """Grows by ``add``; ``freeze`` gives the arrays."""

    def __init__(self) -> None:
        self.length, self.link, self.moves = [0], [NONE], [{}]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.moves.append(moves)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, token: int) -> int:
        """The state that ``at`` reaches by ``token``, made to hold no string longer than those."""
        to = self.moves[at][token]
        if self.length[to] == self.length[at] + 1:
            return to
        twin = self._state(self.length[at] + 1, dict(self.moves[to]), self.link[to])
        self.link[to] = twin
        while at != NONE and self.moves[at].get(token) == to:
            self.moves[at][token] = twin
            at = self.link[at]
        return twin

    def _step(self, last: int, token: int) -> int:
        if token in self.moves[last]:  # an earlier sequence has it
            return self._split(last, token)
        new = self._state(self.length[last] + 1, {}, NONE)
        at = last
        while at != NONE and token not in self.moves[at]:
            self.moves[at][token] = new
            at = self.link[at]
        self.link[new] = 0 if at == NONE else self._split(at, token)
        return new

    def add(self, tokens: Iterable[int]) -> None:
        last = 0
        for t in tokens:
            last = self._step(last, t)

    def walk(self, tokens: Iterable[int]) -> list[int]:
        """The states of an added sequence's beginnings."""
        out, at = [], 0
        for t in tokens:
            at = self.moves[at][t]
            out.append(at)
        return out

    def freeze(self, width: int) -> dict[str, np.ndarray]:
        """Arrays of the automaton over tokens below ``width``; edges as sorted numbers ``state * width + token``."""
        pairs = np.array([(s * width + t, to) for s, moves in enumerate(self.moves) for t, to in moves.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        return {"length": np.array(self.length, np.int32), "link": np.array(self.link, np.int32), "edge": pairs[:, 0].copy(), "to": pairs[:, 1].astype(np.int32), "width": np.array(width)}


def _advance(own: dict[str, np.ndarray], state: np.ndarray, held: np.ndarray, token: np.ndarray) -> None:
    """Each stream reads its token: ``state`` and the length ``held`` become those of the longest match that ends there."""
    edge, to, link, length, width = own["edge"], own["to"], own["link"], own["length"], int(own["width"])
    todo = np.arange(len(state))
    while len(todo):
        key = state[todo].astype(np.int64) * width + token[todo]
        at = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
        found = edge[at] == key
        done = todo[found]
        state[done] = to[at[found]]
        held[done] += 1
        todo = todo[~found]
        stuck = state[todo] == 0
        held[todo[stuck]] = 0
        todo = todo[~stuck]
        state[todo] = link[state[todo]]
        held[todo] = length[state[todo]]


def stream(own: dict[str, np.ndarray], tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, length) of the longest match that ends at each token of the streams ``tokens[starts[i]:ends[i]]``.

    Streams are cut into lanes that begin anew; what a lane's match carries over its
    end is then read on until it is no longer than what the lanes behind found by
    themselves, from where on both are the same.
    """
    state, held = np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int32)
    if not len(own["edge"]) or not len(starts):
        return state, held
    many = np.maximum(0, -(-(ends - starts) // LANE))
    of = np.repeat(np.arange(len(starts)), many)
    place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    first = starts[of] + place * LANE
    last = np.minimum(first + LANE, ends[of])
    order = np.argsort(first - last, kind="stable")  # longest first
    lane, size = first[order], (last - first)[order]
    now, length = np.zeros(len(lane), np.int32), np.zeros(len(lane), np.int32)
    for t in range(int(size.max(initial=0))):
        active = int(np.searchsorted(-size, -t))  # lanes longer than t
        _advance(own, now[:active], length[:active], tokens[lane[:active] + t])
        state[lane[:active] + t], held[lane[:active] + t] = now[:active], length[:active]
    more = np.flatnonzero(last < ends[of])
    at, end = last[more], ends[of[more]]
    now, length = state[at - 1].copy(), held[at - 1].copy()
    while len(at):
        _advance(own, now, length, tokens[at])
        on = length > held[at]
        at, end, now, length = at[on], end[on], now[on], length[on]
        state[at], held[at] = now, length
        at = at + 1
        on = at < end
        at, end, now, length = at[on], end[on], now[on], length[on]
    return state, held
