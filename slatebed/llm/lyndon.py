"""Suffix arrays by linear grouping, for many strings at a time.

First every suffix is put into the group of its Lyndon prefix: groups start as
those of equal first symbols and are processed from the highest to the lowest.
Each member points to the nearest suffix on its left that is in a lower group;
the suffixes pointed at leave their groups for new ones right above, the higher
the more members point at them. Then the order comes out in one sweep: the
suffix to the left of each placed one, and those that its pointers lead to,
take the next place of their groups. No suffix is renamed or sorted again.

The strings are independent and go in lockstep: one step processes one group,
or one suffix, of every string.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one range after the other."""
    sizes = ends - starts
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return shift + np.arange(int(sizes.sum()))


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings ``symbols[bounds[k]:bounds[k + 1]]``, end to end.

    A string has to end with a symbol that is smaller than its others. The
    result holds positions in ``symbols``.
    """
    n, first, last = len(symbols), bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    of = np.repeat(np.arange(len(first)), last - first)
    keys = of * (int(symbols.max(initial=0)) + 1) + symbols
    sa = np.argsort(keys, kind="stable")
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    new = np.concatenate(([True], np.diff(keys[sa]) != 0))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    group = np.empty(n, np.int64)  # where the group of a suffix starts
    group[sa] = np.repeat(starts, ends - starts)
    end_of, start_of = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    end_of[starts], start_of[ends] = ends, starts
    prev = np.arange(-1, n - 1)
    prev[first] = -1
    marked = np.zeros(n, bool)

    low, end = first.copy(), last.copy()
    while len(end):
        start = start_of[end]
        members = sa[_ranges(start, end)]
        going = members
        while len(going):
            to = prev[going]
            going = going[(to >= 0) & (group[to] >= group[going])]
            prev[going] = prev[prev[going]]
        to = prev[members]
        to = to[to >= 0]
        if len(to):
            found, count = np.unique(to, return_counts=True)
            order = np.lexsort((count, group[found]))
            found, count = found[order], count[order]
            old = group[found]
            head = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            size = np.diff(np.append(head, len(old)))
            old_start, old_end = old[head], end_of[old[head]]
            top = old_end - size
            target = np.repeat(top - head, size) + np.arange(len(found))
            at = place[found]
            vacated = at[at < np.repeat(top, size)]
            marked[found] = True
            there = sa[target]
            moved = there[~marked[there]]
            marked[found] = False
            sa[vacated], place[moved] = moved, vacated
            sa[target], place[found] = found, target
            left = top > old_start
            end_of[old_start[left]], start_of[top[left]] = top[left], old_start[left]
            cut = np.concatenate(([True], (old[1:] != old[:-1]) | (count[1:] != count[:-1])))
            sub = target[cut]
            sub_size = np.diff(np.append(np.flatnonzero(cut), len(found)))
            end_of[sub], start_of[sub + sub_size] = sub + sub_size, sub
            group[found] = np.repeat(sub, sub_size)
        more = start > low
        low, end = low[more], start[more]

    out = np.full(n, -1, np.int64)
    front = np.arange(n)
    placed = np.zeros(n, bool)
    out[first], placed[last - 1] = last - 1, True
    i, low, high = first.copy(), first.copy(), last.copy()
    j = np.where(out[i] > low, out[i] - 1, -1)
    while len(i):
        can = j >= 0
        can[can] = ~placed[j[can]]
        put = j[can]
        g = group[put]
        out[front[g]] = put
        front[g] += 1
        placed[put] = True
        j[can] = prev[put]
        i = i + ~can
        live = i < high
        if not live.all():
            i, j, low, high, can = i[live], j[live], low[live], high[live], can[live]
        step = ~can
        s = out[i[step]]
        j[step] = np.where(s > low[step], s - 1, -1)
    return out
