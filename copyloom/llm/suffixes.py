"""Suffix arrays by linear grouping (Baier, 2016): no recursion, no renaming.

Suffixes are grouped by their longest Lyndon prefix, first by their first symbol. Groups are taken in descending order. For
each suffix of a group the previous suffix in a smaller group, its previous-smaller pointer, is the nearest one to the left
that has not been taken yet; a list of those not taken yields it at once. The suffixes pointed at move up into new groups,
just above their own, one for each number of members of the taken group that point at them. When all groups are taken, the
suffixes of each group are put in order by walking the pointers from the suffixes that are already in place.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a sequence of integers in ascending order; the end counts as smaller than any symbol."""
    n = len(symbols) + 1
    values, first_group = np.unique(np.append(symbols, np.min(symbols, initial=0) - 1), return_inverse=True)
    group, count = first_group.tolist(), len(values)
    by_group = np.argsort(first_group, kind="stable")
    members = [x.tolist() for x in np.split(by_group, np.cumsum(np.bincount(first_group))[:-1])]
    size = [len(x) for x in members]
    lower, upper = list(range(-1, count - 1)), [*range(1, count), -1]  # the next group below and above
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]  # the next suffix not taken on both sides
    smaller = [-1] * n
    slot = [0] * count  # where the next suffix of a group goes
    current, free = count - 1, n

    def raised(h: int) -> int:
        """A new, empty group just above another."""
        new, above = len(members), upper[h]
        members.append([])
        size.append(0)
        slot.append(0)
        lower.append(h)
        upper.append(above)
        upper[h] = new
        if above >= 0:
            lower[above] = new
        return new

    while current >= 0:
        own = members[current]
        if len(own) != size[current]:
            own = [i for i in own if group[i] == current]
        free -= len(own)
        slot[current] = free
        if len(own) == 1:
            i = own[0]
            p, r = left[i], right[i]
            smaller[i] = p
            if r >= 0:
                left[r] = p
            if p >= 0:
                right[p] = r
                h = group[p]
                if size[h] > 1:  # alone in its group it is already apart
                    size[h] -= 1
                    group[p] = new = raised(h)
                    members[new].append(p)
                    size[new] = 1
        elif own:
            own.sort()
            pointed: dict[int, list[int]] = {}  # by number of members that point there
            k, m = 0, len(own)
            while k < m:
                p, start = left[own[k]], k
                smaller[own[k]] = p
                while k + 1 < m and left[own[k + 1]] == own[k]:
                    k += 1
                    smaller[own[k]] = p
                r = right[own[k]]
                if r >= 0:
                    left[r] = p
                if p >= 0:
                    right[p] = r
                    pointed.setdefault(k - start + 1, []).append(p)
                k += 1
            for times in sorted(pointed, reverse=True):
                by_old: dict[int, list[int]] = {}
                for p in pointed[times]:
                    by_old.setdefault(group[p], []).append(p)
                for h, moved in by_old.items():
                    if len(moved) == size[h]:
                        continue
                    new = raised(h)
                    size[h] -= len(moved)
                    members[new], size[new] = moved, len(moved)
                    for p in moved:
                        group[p] = new
        current = lower[current]

    order, placed = [0] * n, [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[slot[g]] = j
            slot[g] += 1
            placed[j] = True
            j = smaller[j]
    return np.array(order[1:], dtype=np.int64)
