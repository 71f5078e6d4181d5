"""Suffix arrays of many strings at once, by linear grouping construction.

Suffixes begin in groups by their first character.  Groups are taken in descending order, and then hold the suffixes
that share a Lyndon prefix; each suffix points at the previous one of a smaller group, and what is pointed at k times moves, by
k, behind the rest of its own group.  When all groups were taken, they stand in the order of the Lyndon prefixes.
Then the order within the groups is emitted from the smallest suffix on: a suffix that has its place gives the next place of
their groups to the one before it and to those that one's pointers lead to, up to one that has a place.  Nothing is
renamed and nothing recurses.

One string at a time, that is a Python loop over characters.  Here the strings of a batch advance in step: every
round takes one group, or places one suffix, of each string, as array operations.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _firsts(changed: np.ndarray) -> np.ndarray:
    """Where runs begin; ``changed`` tells it for all places but the first."""
    return np.flatnonzero(np.concatenate(([True], changed)))


def _grouped(text: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Groups in the order of the Lyndon prefixes: each suffix's group, by the place where it begins, and its pointer."""
    n = len(text)
    key = np.repeat(np.arange(len(begin), dtype=np.int64), end - begin) << 9 | text
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    starts = _firsts(np.diff(key[order]) != 0)
    group, until = np.empty(n, np.int64), np.zeros(n, np.int64)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    until[starts] = np.append(starts[1:], n)
    before, marked = np.arange(-1, n - 1), np.zeros(n, bool)
    at, low = end[1:].copy(), begin[1:]  # the first string is a guard
    while True:
        left = at > low + 1  # the sentinel points at nothing
        if not left.all():
            at, low = at[left], low[left]
            if not len(at):
                return group, before
        first = group[order[at - 1]]
        size = at - first
        if len(at) == size.sum():
            members, own, lowest = order[first], first, low
        else:
            members, own, lowest = order[_ranges(first, size)], np.repeat(first, size), np.repeat(low, size)
        at = first
        # Previous suffix of a smaller group: jump along pointers, which skip no such one.
        ask, limit = members, own
        while True:
            seen = before[ask]
            far = group[seen] >= limit
            if not far.any():
                break
            ask, limit, seen = ask[far], limit[far], seen[far]
            before[ask] = before[seen]
        seen = before[members]
        seen = np.sort(seen[seen >= lowest])
        if not len(seen):
            continue
        runs = _firsts(seen[1:] != seen[:-1])
        times = np.diff(np.append(runs, len(seen)))
        seen = seen[runs]
        # Into the last places of their groups, by the number of pointers.
        theirs = group[seen]
        by = np.lexsort((times, theirs))
        seen, times, theirs = seen[by], times[by], theirs[by]
        runs = _firsts(theirs[1:] != theirs[:-1])
        size = np.diff(np.append(runs, len(seen)))
        old = theirs[runs]
        tail = until[old] - size
        target = _ranges(tail, size)
        marked[seen] = True
        there = order[target]
        there = there[~marked[there]]
        marked[seen] = False
        if len(there):
            vacant = place[seen]
            vacant = vacant[vacant < np.repeat(tail, size)]
            order[vacant] = there
            place[there] = vacant
        order[target] = seen
        place[seen] = target
        parts = _firsts((theirs[1:] != theirs[:-1]) | (times[1:] != times[:-1]))
        until[old] = tail
        until[target[parts]] = np.append(target[parts[1:] - 1], target[-1]) + 1
        group[seen] = np.repeat(target[parts], np.diff(np.append(parts, len(seen))))


def suffix_arrays(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of each string in ascending order, one string after the other.

    ``text`` holds the strings, characters 1 to 511, each ending with a 0; ``end`` says where they end.
    """
    text = np.concatenate((np.zeros(1, np.int64), text.astype(np.int64)))
    end = np.concatenate(([1], np.asarray(end, np.int64) + 1))
    begin = np.concatenate(([0], end[:-1]))
    group, before = _grouped(text, begin, end)
    free, placed, out = np.arange(len(text)), np.zeros(len(text), bool), np.zeros(len(text), np.int64)
    placed[end - 1] = True
    out[begin] = end - 1
    at, low, high = begin[1:].copy(), begin[1:], end[1:]
    now = out[at] - 1
    while len(at):
        fits = ~placed[now]  # the sentinel of the string before stands in front
        some = now[fits]
        mine = group[some]
        where = free[mine]
        out[where] = some
        free[mine] = where + 1
        placed[some] = True
        now[fits] = before[some]
        done = np.flatnonzero(placed[now])
        at[done] += 1
        over = at == high
        if over.any():
            at, high, now = at[~over], high[~over], now[~over]
            done = np.flatnonzero(placed[now])
            # Those that had not advanced in this round have an unplaced suffix.
        now[done] = out[at[done]] - 1
    return out[1:] - 1
