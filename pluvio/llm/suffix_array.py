"""Linear suffix sorting by groups.

Suffixes are grouped by their longest Lyndon prefix found so far; at first that is their first symbol. Groups are taken
in descending order. For each suffix of the group its previous smaller suffix, the nearest one before it in a lower
group, is looked up along pointers; if k suffixes of the group follow it without a smaller one between, its own prefix
grows by k copies of the group's, and it moves to a new group right behind its old one. At the end, suffixes are emitted
in ascending order: each emitted suffix calls up those for which it is the next smaller one, and they take the next free places
of their groups. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a suffix that begins another comes before it."""
    n = len(text)
    if n == 0:
        return []
    # groups: members ascend in the text; some may have moved on, which ``group`` tells
    members: list[list[int]] = [[n]]  # the empty suffix is the lowest of all
    group = [0] * (n + 1)
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    for symbol in sorted(by_symbol):
        for i in by_symbol[symbol]:
            group[i] = len(members)
        members.append(by_symbol[symbol])
    lower = list(range(-1, len(members) - 1))  # the next lower group
    higher = [*range(1, len(members)), -1]  # the next higher one
    previous = [-1] * (n + 1)
    done = bytearray(n + 1)
    order: list[int] = []  # groups, highest first
    g = len(members) - 1
    while g > 0:
        own = [s for s in members[g] if group[s] == g]
        if own:
            members[g] = own
            order.append(g)
            for s in own:
                done[s] = 1
            # suffixes that share their previous smaller one follow each other here
            before: list[int] = []
            times: list[int] = []
            last = -1
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[s] = p
                if p < 0:
                    continue
                if p == last:
                    times[-1] += 1
                else:
                    before.append(p)
                    times.append(1)
                    last = p
            if before:
                most = max(times)
                if most == 1:
                    waves = [before]
                else:
                    by_times: dict[int, list[int]] = {}
                    for p, k in zip(before, times):
                        by_times.setdefault(k, []).append(p)
                    waves = [by_times[k] for k in sorted(by_times, reverse=True)]
                # the longest grown prefixes are the highest, so they move first
                for wave in waves:
                    made: dict[int, int] = {}
                    for p in wave:
                        old = group[p]
                        new = made.get(old)
                        if new is None:
                            new = made[old] = len(members)
                            members.append([])
                            # between its old group and what stands above that
                            above = higher[old]
                            lower.append(old)
                            higher.append(above)
                            higher[old] = new
                            if above >= 0:
                                lower[above] = new
                        members[new].append(p)
                        group[p] = new
        g = lower[g]
    place = [0] * len(members)  # next free place of each group
    free = 1
    for g in reversed(order):
        place[g] = free
        free += len(members[g])
    sorted_starts = [n] + [-1] * n
    placed = bytearray(n + 1)
    for i in range(n + 1):
        s = sorted_starts[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            sorted_starts[place[g]] = s
            place[g] += 1
            placed[s] = 1
            s = previous[s]
    return sorted_starts[1:]
