"""Linear suffix sorting by Lyndon-prefix groups."""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: np.ndarray) -> tuple[list[int], list[int]]:
    """(group, smaller): where each suffix's group begins in the suffix array, and its previous-smaller pointer.

    ``text`` ends in a symbol that is less than all others. Suffixes of one group have the same
    Lyndon prefix, and groups are in the order of those prefixes. Groups are taken in descending
    order. What precedes a group's suffixes, up to the pointer of each, has a prefix that goes on
    with the group's own; it moves behind the rest of its group, the further back the more copies
    follow it.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = text[order][1:] != text[order][:-1]
    begins = np.flatnonzero(new)
    head = begins[np.cumsum(new) - 1]
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    groups = np.empty(n, dtype=np.int64)
    groups[order] = head
    widths = np.zeros(n, dtype=np.int64)
    widths[begins] = np.diff(np.append(begins, n))
    suffixes, at, group, size = order.tolist(), place.tolist(), groups.tolist(), widths.tolist()
    smaller = [-1] * n
    end = n - 1
    while end > 0:
        begin = group[suffixes[end]]
        if begin == end:
            s = suffixes[end]
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                w = size[g]
                if w > 1:
                    last = g + w - 1
                    other, here = suffixes[last], at[p]
                    suffixes[here], at[other] = other, here
                    suffixes[last], at[p] = p, last
                    size[g] = w - 1
                    group[p] = last
                    size[last] = 1
            end -= 1
            continue
        followed: dict[int, int] = {}
        for s in sorted(suffixes[begin : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                followed[p] = followed.get(p, 0) + 1
        by_copies: dict[int, list[int]] = {}
        for p, copies in followed.items():
            by_copies.setdefault(copies, []).append(p)
        for copies in sorted(by_copies, reverse=True):
            moved = by_copies[copies]
            for p in moved:
                g = group[p]
                last = g + size[g] - 1
                other, here = suffixes[last], at[p]
                suffixes[here], at[other] = other, here
                suffixes[last], at[p] = p, last
                size[g] -= 1
            starts = [group[p] + size[group[p]] for p in moved]
            for p, start in zip(moved, starts, strict=True):
                group[p] = start
                size[start] += 1
        end = begin - 1
    return group, smaller


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in ascending order; its last symbol is less than all others.

    The groups are filled from the least suffix on: whatever precedes a suffix in place, and the
    chain of previous-smaller pointers from there, comes next in its group. No suffix is compared
    and no symbol renamed.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    free, smaller = lyndon_groups(text)
    head = list(range(n))
    placed = [False] * n
    out = [0] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = free[s]
            out[head[g]] = s
            head[g] += 1
            placed[s] = True
            s = smaller[s]
    return np.array(out, dtype=np.int64)
