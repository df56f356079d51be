"""Suffix arrays by linear grouping construction, for many short strings in step.

Phase 1 takes the groups of a string's suffixes in descending order.  For each suffix of the
group, its previous-smaller pointer is the nearest suffix to the left in a lower group; the
suffixes pointed at leave their group for new ones right above it, by how many pointers
reached them, so that in the end a group shares its Lyndon prefix.  Phase 2 goes up the
suffix array and follows the pointers to emit each group's order.  Nothing is renamed and
nothing recurses.  Strings are independent, so one numpy step serves the current group of
every string.
"""

from __future__ import annotations

import numpy as np


def _runs(change: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(change)
    return at, np.diff(np.append(at, n))


def suffix_arrays(text: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Sorted suffix starts of the strings ``text[base[k]:base[k + 1]]``, each ending with its only 0.

    All numbers are places in ``text``; string k's suffixes fill ``[base[k], base[k + 1])`` of the result.
    """
    n = len(text)
    lane = np.repeat(np.arange(len(base) - 1), np.diff(base))
    key = lane * (int(text.max(initial=0)) + 1) + text
    sa = np.argsort(key, kind="stable")
    srt = key[sa]
    first, length = _runs(np.append(True, srt[1:] != srt[:-1])[:n], n)
    grp, size, isa = np.empty(n, np.int64), np.zeros(n, np.int64), np.empty(n, np.int64)
    grp[sa], isa[sa], size[first] = np.repeat(first, length), np.arange(n), length
    prev, moved = np.full(n, -1, np.int64), np.zeros(n, bool)
    _group(base, sa, isa, grp, size, prev, moved)
    return _emit(base, sa, grp, prev)


def _group(base, sa, isa, grp, size, prev, moved) -> None:
    lanes, end = np.arange(len(base) - 1), base[1:].copy()
    while len(lanes := lanes[end[lanes] > base[lanes] + 1]):
        g = grp[sa[end[lanes] - 1]]
        count = end[lanes] - g
        end[lanes] = g
        total = int(count.sum())
        if total == len(g):
            slots, of, low = g, g, base[lanes]
        else:
            slots = np.repeat(g - (np.cumsum(count) - count), count) + np.arange(total)
            of, low = np.repeat(g, count), np.repeat(base[lanes], count)
        own = sa[slots]
        # Previous-smaller pointers: hop over suffixes of this group and of higher ones.
        p = own - 1
        p[p < low] = -1
        prev[own] = p
        todo = np.flatnonzero((p >= 0) & (grp[p] >= of))
        while len(todo):
            q = prev[p[todo]]
            p[todo] = q
            prev[own[todo]] = q
            todo = todo[(q >= 0) & (grp[q] >= of[todo])]
        pointed = np.sort(p[p >= 0])
        if not len(pointed):
            continue
        at, c = _runs(np.append(True, pointed[1:] != pointed[:-1]), len(pointed))
        u = pointed[at]
        og = grp[u]
        order = np.argsort(og * (int(c.max()) + 1) + c)
        u, c, og = u[order], c[order], og[order]
        # They take the last slots of their old group, by the number of pointers.
        new_group = np.append(True, og[1:] != og[:-1])
        gi, m = _runs(new_group, len(u))
        gs = og[gi]
        tail = gs + size[gs] - m
        target = np.repeat(tail - gi, m) + np.arange(len(u))
        old, there = isa[u], sa[target]
        moved[u] = True
        pushed = there[~moved[there]]
        moved[u] = False
        free = old[old < np.repeat(tail, m)]
        sa[free], isa[pushed] = pushed, free
        sa[target], isa[u] = u, target
        size[gs] -= m
        ri, rl = _runs(new_group | np.append(False, c[1:] != c[:-1]), len(u))
        start = target[ri]
        grp[u], size[start] = np.repeat(start, rl), rl


def _emit(base, sa, grp, prev) -> np.ndarray:
    out = np.empty_like(sa)
    fill, placed = np.zeros(len(sa), np.int64), np.zeros(len(sa), bool)
    low, high = base[:-1], base[1:]
    sentinel = sa[low]
    out[low], placed[sentinel] = sentinel, True
    i, j = low.copy(), sentinel - 1
    while len(i):
        live = j >= low
        live[live] = ~placed[j[live]]
        k = j[live]
        slot = grp[k]
        slot = slot + fill[slot]
        fill[grp[k]] += 1
        out[slot], placed[k] = k, True
        j[live] = prev[k]
        rest = ~live
        i = i + rest
        on = i < high
        if not on.all():
            i, j, low, high, rest = i[on], j[on], low[on], high[on], rest[on]
        j[rest] = out[i[rest]] - 1
    return out
