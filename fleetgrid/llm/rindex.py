"""Run-length index of byte strings, and matching statistics of others streamed against it.

The strings stand one after the other, each closed by an end mark that sorts before all bytes; equal
suffixes sort by position. Of the Burrows-Wheeler transform of them only the runs are kept: symbol, first row,
length, where the first row maps to, and as samples the text positions of the run's first and last suffix.

Another string is read from its end. While the run holds the next byte, the row maps on and the match
grows by one. Where it doesn't, the match goes on from the nearest end of a run of that byte, above or
below, whichever shares more with what is matched; the samples say where in the text that is, and names of
stretches of 1, 2, 4, ... symbols how much is shared. So every place gets the length of its longest match.
Rows of suffixes that share their first ``match`` symbols form a class, which knows its smallest owner.
"""

from __future__ import annotations

import numpy as np


def laid_out(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings one after the other as byte values plus one, zero as end marks; and places of the end marks."""
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    shift = np.repeat(starts - (ends - lengths), lengths)
    symbols[inside] = data[np.flatnonzero(inside) + shift].astype(np.int64) + 1
    return symbols, ends


class RunIndex:
    """Index over the strings ``data[start : start + length]`` with an owner each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray, match: int) -> None:
        self.match = match
        symbols, ends = laid_out(data, starts, lengths)
        left = np.repeat(ends, lengths + 1) - np.arange(len(symbols))
        used = np.flatnonzero(np.bincount(symbols))
        # Bytes by their rank among those that occur; -1 for others.
        self.dense = np.full(257, -1, np.int64)
        self.dense[used] = np.arange(len(used))
        self.names, order = stretch_names(self.dense[symbols], left, len(used), max(int(lengths.max(initial=0)) + 1, match))

        before = self.dense[symbols[order - 1]]
        first = np.concatenate([[True], before[1:] != before[:-1]])
        self.starts = np.flatnonzero(first)
        self.sizes = np.diff(np.append(self.starts, len(symbols)))
        self.heads = before[self.starts]
        self.first_sample = order[self.starts]
        self.last_sample = order[self.starts + self.sizes - 1]
        # Runs by symbol, then place: what they map to, and the nearest run of a symbol by binary search.
        self.by_head = np.argsort(self.heads.astype(np.int16), kind="stable")
        self.head_keys = self.heads[self.by_head] * len(self.starts) + self.by_head
        rising = np.cumsum(self.sizes[self.by_head]) - self.sizes[self.by_head]
        self.maps_to, self.run_of = np.empty(len(self.by_head), np.int64), np.empty(len(self.by_head), np.int64)
        self.maps_to[self.by_head] = rising
        self.run_of[self.by_head] = np.searchsorted(self.starts, rising, "right") - 1

        owner = np.repeat(owners, lengths + 1)[order]
        differ = self.differ(order[:-1], order[1:], match)
        self.class_starts = np.flatnonzero(np.concatenate([[True], differ]))
        self.class_owner = np.minimum.reduceat(owner, self.class_starts)

    def differ(self, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
        """Whether the first ``length`` symbols at two places differ."""
        level = length.bit_length() - 1
        last = len(self.names[0]) - 1
        rest = length - (1 << level)
        name = self.names[level]
        return (name[x] != name[y]) | (name[np.minimum(x + rest, last)] != name[np.minimum(y + rest, last)])

    def shared(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols two places share, ``most`` at most, which must not reach an end mark at x."""
        last = len(self.names[0]) - 1
        found = np.zeros(len(x), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            same = name[np.minimum(x + found, last)] == name[np.minimum(y + found, last)]
            found += same.astype(np.int64) << level
        return np.minimum(found, most)

    def owners_of_matches(
        self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, place, owner) wherever the longest match of a string's suffix has ``match`` symbols or more.

        The owner is the smallest one that holds these ``match`` symbols. All strings are streamed at once.
        """
        by_length = np.argsort(-lengths, kind="stable")
        sizes = lengths[by_length]
        ends = starts[by_length] + sizes
        run = np.zeros(len(sizes), np.int64)
        inside, length = run.copy(), run.copy()
        place = np.full(len(sizes), self.first_sample[0])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(1, int(sizes.max(initial=0)) + 1):
            going = int(np.searchsorted(-sizes, -step, "right"))
            run, inside, length, place = run[:going], inside[:going], length[:going], place[:going]
            symbol = self.dense[data[ends[:going] - step].astype(np.int64) + 1]
            away = np.flatnonzero(self.heads[run] != symbol)
            lost = self.jump(away, symbol[away], run, inside, length, place) if len(away) else away
            inside += self.maps_to[run]
            run = self.run_of[run]
            inside -= self.starts[run]
            beyond = np.flatnonzero(inside >= self.sizes[run])
            while len(beyond):
                inside[beyond] -= self.sizes[run[beyond]]
                run[beyond] += 1
                beyond = beyond[inside[beyond] >= self.sizes[run[beyond]]]
            place = place - 1
            length = length + 1
            if len(lost):
                run[lost], inside[lost], length[lost], place[lost] = 0, 0, 0, self.first_sample[0]
            long_ = np.flatnonzero(length >= self.match)
            if len(long_):
                row = self.starts[run[long_]] + inside[long_]
                owner = self.class_owner[np.searchsorted(self.class_starts, row, "right") - 1]
                found.append((by_length[long_], sizes[long_] - step, owner))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(column) for column in zip(*found))

    def jump(self, away: np.ndarray, symbol: np.ndarray, run: np.ndarray, inside: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Move the strings ``away`` to the nearest run end of their symbol; returns those whose symbol never occurs."""
        at = np.searchsorted(self.head_keys, symbol * len(self.starts) + run[away])
        below = self.by_head[np.minimum(at, len(self.by_head) - 1)]
        above = self.by_head[np.maximum(at - 1, 0)]
        is_below = (at < len(self.by_head)) & (self.heads[below] == symbol)
        is_above = (at > 0) & (self.heads[above] == symbol)
        here, most = place[away], length[away]
        down = np.where(is_below, self.shared(here, self.first_sample[below], most), -1)
        up = np.where(is_above, self.shared(here, self.last_sample[above], most), -1)
        take_up = up > down
        target = np.where(take_up, above, below)
        some = np.maximum(up, down) >= 0
        moved = away[some]
        target, take_up = target[some], take_up[some]
        run[moved] = target
        inside[moved] = np.where(take_up, self.sizes[target] - 1, 0)
        place[moved] = np.where(take_up, self.last_sample[target], self.first_sample[target])
        length[moved] = np.maximum(up, down)[some]
        return away[~some]


def ranks(high: np.ndarray, low: np.ndarray, low_bits: int) -> np.ndarray:
    """Dense ranks from 1 on of pairs of non-negative integers; ``low`` has up to ``low_bits`` bits.

    Where the pair and the position fit into 64 bits, sorting values is much faster than an argsort.
    """
    n = len(high)
    place_bits = max(n - 1, 1).bit_length()
    key = (high.astype(np.uint64) << np.uint64(low_bits)) | low.astype(np.uint64)
    if int(key.max(initial=0)).bit_length() + place_bits <= 64:
        packed = np.sort((key << np.uint64(place_bits)) | np.arange(n, dtype=np.uint64))
        order = (packed & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        sorted_ = packed >> np.uint64(place_bits)
    else:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
    found = np.empty(n, np.int64)
    found[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return found


def stretch_names(symbols: np.ndarray, left: np.ndarray, kinds: int, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Names of the 1, 2, 4, ... symbols from every place up to its end mark, in their order; and the suffix order.

    ``left`` is the distance of each place to its end mark. Stretches of up to four symbols are named by
    their packed symbols, longer ones by the ranks of pairs; the last level covers the longest string.
    """
    n = len(symbols)
    bits = max(kinds - 1, 1).bit_length()

    def later(values: np.ndarray, by: int) -> np.ndarray:
        moved = np.zeros(n, np.int64)
        moved[: max(n - by, 0)] = values[by:]
        moved[left < by] = 0
        return moved

    names = [symbols]
    for _ in range(2):
        depth = 1 << (len(names) - 1)
        names.append((names[-1] << (bits * depth)) | later(names[-1], depth))
    rank = ranks(names[-1], np.zeros(n, np.int64), 0)
    rank_bits = n.bit_length()
    while 1 << (len(names) - 1) < longest:
        depth = 1 << (len(names) - 1)
        rank = ranks(rank, later(rank, depth), rank_bits)
        names.append(rank)
    place_bits = max(n - 1, 1).bit_length()
    order = np.sort((rank << place_bits) | np.arange(n)) & ((1 << place_bits) - 1)
    return [name.astype(np.int32) if name.max(initial=0) < 1 << 31 else name for name in names], order
