"""Suffix sorting by grouping (Baier, 2016), over integer symbols.

Suffixes lie in groups by their longest known Lyndon prefix. Groups are taken in
descending order. Each member's pointer to the nearest earlier suffix of a smaller
group is found by following the pointers of what lies between; the suffixes pointed
at have their prefix lengthened by the group's, and so move to new groups right
behind their old ones, those with more pointers further. When all groups are done,
one pass over the order, begun with the last suffix, puts each suffix at the first
free place of its group. Nothing is renamed and no call recurses.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(symbols) -> list[int]:
    """The order of all suffixes of a sequence of non-negative integers; a shorter suffix precedes what it begins."""
    text = [-1 if x is None else x for x in (symbols.tolist() if isinstance(symbols, np.ndarray) else symbols)]
    n = len(text) + 1  # with an end mark below every symbol
    if n == 1:
        return []
    first = np.argsort(np.array(text, np.int64), kind="stable")
    order = [n - 1, *first.tolist()]
    at = [0] * n
    for place, i in enumerate(order):
        at[i] = place
    group, end = [0] * n, [0] * (n + 1)
    start, last = 0, None
    for place, i in enumerate(order):
        symbol = text[i] if i < n - 1 else None
        if place == 0 or symbol != last:
            start, last = place, symbol
        group[i] = start
        end[start] = place + 1
    before = [-1] * n

    upper = n
    while upper > 0:
        lower = group[order[upper - 1]]
        if upper - lower == 1:
            i = order[lower]
            p = i - 1
            while p >= 0 and group[p] >= lower:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group[p]
                e = end[g] - 1
                if e > g:
                    q, place = order[e], at[p]
                    order[e], order[place], at[p], at[q] = p, q, e, place
                    end[g], end[e], group[p] = e, e + 1, e
        else:
            members = sorted(order[lower:upper])
            found = []
            for i in members:
                p = i - 1
                while p >= 0 and group[p] >= lower:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    found.append(p)
            counts = Counter(found)
            by_count: dict[int, list[int]] = {}
            for p, c in counts.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_count[c]:
                    g = group[p]
                    e = end[g] - 1
                    q, place = order[e], at[p]
                    order[e], order[place], at[p], at[q] = p, q, e, place
                    end[g] = e
                    moved.setdefault(g, []).append(p)
                for g, ps in moved.items():
                    e = end[g]
                    end[e] = e + len(ps)
                    for p in ps:
                        group[p] = e
        upper = lower

    free = group  # the next free place of the group that starts there, kept by its start
    place_of = list(range(n + 1))
    out, done = [-1] * n, [False] * n
    out[0], done[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = free[j]
            out[place_of[g]] = j
            place_of[g] += 1
            done[j] = True
            j = before[j]
    return out[1:]
