"""Suffix sorting by grouping, in linear time and without recursion.

Phase 1 puts suffixes into groups that share their longest Lyndon prefix. Groups are taken in descending order. Each
suffix of the group points to the last suffix before it in a lower group (its previous smaller); those pointed to are
moved out of their group into a new one just above it, the more pointers the higher, as their prefix has grown by that
many copies of the group's. Phase 2 reads the suffix array from the front: the suffix before the one read is the next
of its group, and so are the previous smaller ones above it.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. A text's end is lower than any symbol."""
    n = len(text)
    symbols, group = np.unique(np.append(text.astype(np.int64) + 1, 0), return_inverse=True)
    g: list[int] = group.tolist()
    size = n + 1
    order = np.argsort(group, kind="stable")
    members: list[list[int]] = [x.tolist() for x in np.split(order, np.cumsum(np.bincount(group))[:-1])]
    live = [len(x) for x in members]  # of members, that are still in the group
    above = list(range(1, len(members))) + [-1]  # the next higher group
    below = list(range(-1, len(members) - 1))
    done = bytearray(len(members))
    prev = [-1] * size
    at = len(members) - 1
    while at >= 0:
        done[at] = 1
        n_live, own = live[at], members[at]
        if n_live == 1:
            s = own[0]
            if len(own) > 1:
                s = next(x for x in own if g[x] == at)
            p = s - 1
            while p >= 0 and done[g[p]]:
                p = prev[p]
            prev[s] = p
            if p >= 0 and live[h := g[p]] > 1:
                new, up = len(members), above[h]
                members.append([p])
                live.append(1)
                live[h] -= 1
                done.append(0)
                above.append(up)
                below.append(h)
                above[h] = new
                if up >= 0:
                    below[up] = new
                g[p] = new
            at = below[at]
            continue
        count: dict[int, int] = {}
        if n_live:
            if n_live < len(own):
                own = [x for x in own if g[x] == at]
            own.sort()
            for s in own:
                p = s - 1
                while p >= 0 and done[g[p]]:
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
        if count:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in count.items():
                moved.setdefault((k, g[p]), []).append(p)
            # Of one group, those with the most pointers end up highest; all of a group alike stay as they are.
            for k, h in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                ps = moved[k, h]
                if len(ps) == live[h]:
                    continue
                new, up = len(members), above[h]
                members.append(ps)
                live.append(len(ps))
                live[h] -= len(ps)
                done.append(0)
                above.append(up)
                below.append(h)
                above[h] = new
                if up >= 0:
                    below[up] = new
                for p in ps:
                    g[p] = new
        at = below[at]
    # Where each group begins: lowest group first.
    counts = np.bincount(g, minlength=len(members)).tolist()
    start, at, total = [0] * len(members), 0, 0
    while at >= 0:
        start[at] = total
        total += counts[at]
        at = above[at]
    sa, placed = [0] * size, bytearray(size)
    sa[0] = n
    placed[n] = 1
    for i in range(size):
        s = sa[i] - 1
        while s >= 0 and not placed[s]:
            h = g[s]
            sa[start[h]] = s
            start[h] += 1
            placed[s] = 1
            s = prev[s]
    return np.array(sa[1:], np.int64)
