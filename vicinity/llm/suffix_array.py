"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups start as those of the first symbols and are processed in
descending order: every suffix of the group being processed sends its multiplicity to the suffix in front of it that
belongs to a smaller group (its previous-smaller pointer); those receive a longer prefix and move, by multiplicity, to a
new group at the end of their old one. Once all groups have been processed no name is ever computed again: a scan from
the smallest suffix on emits each suffix into the next free place of its group, following the same pointers.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """Start positions in the order of the suffixes; symbols are non-negative integers."""
    n = len(s)
    if n < 2:
        return list(range(n))
    # `place` lists suffixes so that groups are ranges; group[i] is where the range of i's group begins.
    order = sorted(range(n), key=s.__getitem__)
    place, where, group = order, [0] * n, [0] * n
    size: dict[int, int] = {}
    start, last = 0, -1
    for k, i in enumerate(place):
        if s[i] != last:
            start, last = k, s[i]
            size[start] = 0
        size[start] += 1
        where[i], group[i] = k, start
    previous = [-1] * n
    end = n
    while end > 0:
        begin = group[place[end - 1]]
        # previous-smaller pointers, jumping over what is known to be larger
        received: dict[int, int] = {}
        for i in sorted(place[begin:end]):  # by position, so pointers inside the group are there when they are needed
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                received[p] = received.get(p, 0) + 1
        if received:
            by: dict[int, list[int]] = {}
            for p, k in received.items():
                by.setdefault(k, []).append(p)
            for k in sorted(by, reverse=True):
                moved: dict[int, int] = {}
                for p in by[k]:
                    g = group[p]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    to = g + size[g] - m
                    at, other = where[p], place[to]
                    place[at], where[other] = other, at
                    place[to], where[p] = p, to
                for g, m in moved.items():
                    left = size[g] - m
                    if left:
                        size[g], size[g + left] = left, m
                        for x in range(g + left, g + left + m):
                            group[place[x]] = g + left
        end = begin
    out = [-1] * n
    free = {g: g for g in size}
    done = bytearray(n)

    def emit(i: int) -> None:
        """All suffixes whose prefix ends where i begins."""
        i -= 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = 1
            i = previous[i]

    emit(n)  # the empty suffix comes first
    for k in range(n):
        emit(out[k])
    return out
