"""External induced sorting of a shard's suffixes, with common-prefix values, to a bounded depth.

The S* suffixes (smaller than the one before them) are ranked recursively: by their next eight bytes, and those that tie
by the eight after, down to the depth; or, on demand, by an induction that sorts the substrings between them and a recursion
on those substrings' names (``by_names``). All other suffixes follow by induction: a scan of the sorted L suffixes and S*
suffixes from small to large sorts all L suffixes, and a scan of those from large to small sorts all S suffixes. What a
scan finds goes into priority queues by first byte; a bucket's entries arrive in their final order, so its queue is
first in, first out, and is read by blocks. Each entry is a tuple of position and common prefix with the entry before;
a pushed tuple's common prefix is one more than the smallest over the scanned tuples since the last push to that bucket.

Queues hold ``memory`` bytes at most; blocks beyond go to an unnamed scratch file that ends with the task.
The order is by the first ``depth`` symbols (values are capped there), which is all that windows of that length need.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np


class Spool:
    """Blocks of arrays, kept in memory up to a limit and in a scratch file beyond it."""

    def __init__(self, memory: int) -> None:
        self.free, self.file = memory, None

    def put(self, *arrays: np.ndarray) -> tuple:
        size = sum(a.nbytes for a in arrays)
        if size <= self.free:
            self.free -= size
            return (size, arrays)
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        at = self.file.tell()
        for a in arrays:
            self.file.write(a.data)
        return (at, [(a.dtype, len(a)) for a in arrays], None)

    def get(self, block: tuple) -> list[np.ndarray]:
        """Read a block and give its memory back."""
        if len(block) == 2:
            self.free += block[0]
            return list(block[1])
        self.file.seek(block[0])
        return [np.frombuffer(self.file.read(n * kind.itemsize), kind) for kind, n in block[1]]

    def taken(self, queue: list, n: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A queue's tuples in order, in blocks of about ``n``, with those that are put there meanwhile."""
        done = 0
        while done < len(queue):
            got, size = [], 0
            while done < len(queue) and size < n:
                got.append(self.get(queue[done]))
                queue[done] = None
                done += 1
                size += len(got[-1][0])
            yield tuple(got[0]) if len(got) == 1 else (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def words_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight symbols from each position as one big-endian number."""
    eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    return np.ascontiguousarray(eight[at]).view(">u8").ravel().astype(np.uint64)


def s_star(text: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Positions whose suffix is smaller than the next one and follows a larger one; the last position is one."""
    n = len(text)
    found = [np.array([n - 1] if n > 1 and text[n - 2] > text[n - 1] or n == 1 else [], np.int64)]
    after = False  # whether the suffix after the block is smaller than the one after it; towards the end all fall
    for lo in range((n - 2) // block * block, -1, -block) if n > 1 else ():
        hi = min(lo + block, n - 1)
        step = text[lo + 1 : hi + 1].astype(np.int16) - text[lo:hi]
        turn = np.flatnonzero(step)  # where neighbours differ; equal ones have the type of the next turn
        rising = np.full(hi - lo, after)
        if len(turn):
            rising[: turn[-1] + 1] = np.repeat(step[turn] > 0, np.diff(np.r_[-1, turn]))
        # Position p is one if it rises and p - 1 doesn't; p - 1 falls at once, as its suffix is larger.
        star = rising.copy()
        star[1:] &= ~rising[:-1]
        star[0] &= lo > 0 and text[lo - 1] > text[lo]
        found.append(lo + np.flatnonzero(star))
        after = bool(rising[0])
    return np.concatenate(found[::-1])


def ranked(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions in the order of their first ``depth`` symbols."""
    word = words_at(padded, at)
    order = np.argsort(word, kind="stable")
    at, word = at[order], word[order]
    same = np.zeros(len(at), bool)  # equal to the one before
    same[1:] = word[1:] == word[:-1]
    for done in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(~same[where])
        word = words_at(padded, at[where] + done)
        order = np.lexsort((word, group))
        at[where] = at[where][order]
        word = word[order]
        split = np.ones(len(where), bool)
        split[1:] = word[1:] != word[:-1]
        same[where] &= ~split
    return at


def shared(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each position with the one before it in the list, capped at ``depth``."""
    out = np.zeros(len(at), np.uint8)
    live = np.arange(1, len(at))
    for done in range(0, depth, 8):
        if not len(live):
            break
        differ = words_at(padded, at[live] + done) ^ words_at(padded, at[live - 1] + done)
        ended = differ != 0
        if ended.any():
            top = np.zeros(int(ended.sum()), np.int64)
            rest = differ[ended]
            for k in range(7):  # symbols that agree before the first that doesn't
                top += (rest >> np.uint64(8 * (7 - k))) == 0
            out[live[ended]] = np.minimum(depth, done + top)
        live = live[~ended]
    out[live] = depth
    return out


class Lows:
    """Smallest value of any range of a block, by doubling."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        n = self.n = len(values)
        self.rows = np.empty((max(1, int(longest).bit_length()), n), np.uint8)
        self.rows[0] = values
        for k in range(1, len(self.rows)):
            half = 1 << (k - 1)
            if n >= 2 * half:
                np.minimum(self.rows[k - 1, : n - 2 * half + 1], self.rows[k - 1, half : n - half + 1], out=self.rows[k, : n - 2 * half + 1])

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float32))[1].astype(np.int64) - 1
        flat, row = self.rows.ravel(), level * self.n
        return np.minimum(flat[row + first], flat[row + last + 1 - (1 << level)])


class Scan:
    """One of the two scans: queues by first symbol, and what their pushes need to know of common prefixes."""

    def __init__(self, spool: Spool, depth: int) -> None:
        self.spool, self.depth = spool, depth
        self.queues: list[list] = [[] for _ in range(256)]
        self.filled = np.zeros(256, bool)
        self.low = np.zeros(256, np.uint8)
        self.since = np.full(256, -1)

    def block(self, c: int, lcp: np.ndarray, before: np.ndarray, symbol: np.ndarray, index: np.ndarray) -> None:
        """Push ``before`` (positions) by ``symbol``; ``index`` says which scanned tuple of bucket c each comes from."""
        if not len(lcp):
            return
        touched = np.zeros(256, bool)
        if len(before):
            order = np.argsort(symbol, kind="stable")
            symbol, before, index = symbol[order], before[order], index[order]
            first = np.ones(len(symbol), bool)
            first[1:] = symbol[1:] != symbol[:-1]
            starts = np.flatnonzero(first)
            ends = np.r_[starts[1:], len(symbol)]
            value = np.empty(len(symbol), np.uint8)
            rest = np.flatnonzero(~first)
            if len(rest):
                lo, hi = index[rest - 1] + 1, index[rest]
                value[rest] = Lows(lcp, int((hi - lo).max()) + 1).over(lo, hi)
            heads, tails = np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])[::-1]
            for s, e in zip(starts.tolist(), ends.tolist()):
                d = int(symbol[s])
                value[s] = min(self.low[d], heads[index[s]]) if self.since[d] == c else 0
                touched[d] = True
                last = int(index[e - 1])
                self.low[d] = tails[last + 1] if last + 1 < len(lcp) else 255
                self.since[d] = c
            value = np.minimum(value, self.depth - 1) + np.uint8(1)
            for s, e in zip(starts.tolist(), ends.tolist()):
                d = int(symbol[s])
                if not self.filled[d]:
                    value[s], self.filled[d] = 0, True
                self.queues[d].append(self.spool.put(before[s:e], value[s:e]))
        rest = ~touched
        self.low[rest] = np.minimum(self.low[rest], lcp.min())


def run_length(text: np.ndarray, at: int, depth: int) -> int:
    piece = text[at : at + depth]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def by_names(text: np.ndarray, padded: np.ndarray, stars: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """The S* positions in the order of their first ``depth`` symbols, by a recursion on names.

    A first induction, from the S* suffixes in the order of their first symbols alone, sorts the substrings from each S*
    position to the next. Equal ones, compared with their neighbours, get the same name; then pairs of names get names, and
    pairs of those, until all are different or cover the depth: an S* substring has two symbols of its own at least.
    """
    first = text[stars]
    order = np.argsort(first, kind="stable")
    seeds = stars[order]
    inner = seeds != len(text) - 1
    same = np.ones(len(seeds), np.uint8)
    place = np.full(len(text), -1, np.int32 if len(stars) < 1 << 31 else np.int64)
    place[stars] = np.arange(len(stars))
    found = []
    for at, _ in induced(text, seeds[inner], same[inner], depth, memory):  # from the largest to the smallest
        at = place[at]
        found.append(at[at >= 0][::-1])
    found = np.concatenate(found[::-1]) if found else np.zeros(0, np.int64)
    return _named(padded, stars, found, depth)


def _named(padded: np.ndarray, stars: np.ndarray, found: np.ndarray, depth: int) -> np.ndarray:
    """found: indices of stars by their substrings, smallest first."""
    size = np.diff(np.r_[stars, stars[-1:]]) + 1
    common = shared(padded, stars[found], depth)
    a, b = size[found[:-1]], size[found[1:]]
    new = np.r_[True, ~((common[1:] >= depth) | (a == b) & (common[1:] >= np.minimum(a, depth)))]
    rank = np.empty(len(found), np.int64)
    rank[found] = np.cumsum(new) - 1
    step = 1
    while int(rank.max(initial=0)) + 1 < len(rank) and 2 * step < depth:
        after = np.r_[rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)]
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1]
        step *= 2
    return stars[np.argsort(rank, kind="stable")]


def sorted_suffixes(text: np.ndarray, depth: int = 50, memory: int = 192 << 20, names: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the one before), from the largest suffix to the smallest.

    text: uint8 with 0 as its last symbol; a suffix that reaches the end is smaller than what it is a prefix of. ``names``
    ranks the S* suffixes by a recursion on names, which takes a second induction, instead of by successive words.
    """
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    stars = s_star(text)
    seeds = by_names(text, padded, stars, depth, memory) if names else ranked(padded, stars, depth)
    seeds = seeds[seeds != len(text) - 1]
    yield from induced(text, seeds, shared(padded, seeds, depth), depth, memory)


def induced(text: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, depth: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from S* suffixes in order, with common prefixes; the two scans."""
    n = len(text)
    kind = np.uint32 if n < 1 << 32 else np.int64
    first = text[seeds]
    bounds = np.searchsorted(first, np.arange(257))
    spool = Spool(memory)
    try:
        small, sorted_l = Scan(spool, depth), [[] for _ in range(256)]
        small.queues[0].append(spool.put(np.array([n - 1], kind), np.zeros(1, np.uint8)))  # the end is smaller than all others
        small.filled[0] = True
        last_l = [-1] * 256
        for c in range(256):
            first_block = True
            for at, lcp in spool.taken(small.queues[c]):
                sorted_l[c].append(spool.put(at, lcp))
                last_l[c] = int(at[-1])
                if first_block:
                    lcp = lcp.copy()
                    lcp[0], first_block = 0, False
                has = np.flatnonzero(at > 0)
                before = at[has] - kind(1)
                symbol = text[before]
                down = symbol >= c
                small.block(c, lcp, before[down], symbol[down], has[down])
            small.queues[c] = []
            lo, hi = int(bounds[c]), int(bounds[c + 1])
            if lo < hi:
                at, lcp = seeds[lo:hi].astype(kind), seed_lcp[lo:hi].copy()
                lcp[0] = 0 if first_block else min(run_length(text, last_l[c], depth), run_length(text, int(at[0]), depth))
                has = np.flatnonzero(at > 0)
                before = at[has] - kind(1)
                symbol = text[before]
                down = symbol > c
                small.block(c, lcp, before[down], symbol[down], has[down])
        del seeds, seed_lcp, first
        large = Scan(spool, depth)
        for c in range(255, -1, -1):
            first_block, last = True, -1
            for at, lcp in spool.taken(large.queues[c]):
                lcp = lcp.copy()
                if first_block:
                    lcp[0], first_block = 0, False
                yield at, lcp
                last = int(at[-1])
                has = np.flatnonzero(at > 0)
                before = at[has] - kind(1)
                symbol = text[before]
                up = symbol <= c
                large.block(c, lcp, before[up], symbol[up], has[up])
            large.queues[c] = []
            carry = None  # common prefix of the L tuple scanned last with the next smaller one
            for block in reversed(sorted_l[c]):
                at, lcp = spool.get(block)
                at, down_lcp = at[::-1].copy(), lcp[::-1]
                lcp = np.empty(len(at), np.uint8)
                lcp[1:] = down_lcp[:-1]
                if carry is None:
                    lcp[0] = 0 if first_block else min(run_length(text, last, depth), run_length(text, int(at[0]), depth))
                else:
                    lcp[0] = carry
                carry, first_block = down_lcp[-1], False
                yield at, lcp
                has = np.flatnonzero(at > 0)
                before = at[has] - kind(1)
                symbol = text[before]
                up = symbol < c
                large.block(c, lcp, before[up], symbol[up], has[up])
            sorted_l[c] = []
    finally:
        spool.close()
