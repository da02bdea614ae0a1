"""Suffix arrays by grouping, in linear time, and longest common prefixes."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of all suffixes of a sequence of whole numbers, in order.

    First phase: suffixes are grouped by their first symbol, and groups are
    worked through from the highest down. When a group's turn comes, all its
    suffixes share the same Lyndon prefix. Each finds the nearest earlier suffix
    of a lower group, its previous smaller one; that one's own prefix now goes on
    with this group's, so it leaves its group for a new one right above, the
    higher the more often this group follows it. Second phase: from the smallest
    suffix up, each suffix settles the one that starts just before it, and that
    one's chain of previous smaller suffixes, as the next of their groups.
    Nothing is renamed and there is no recursion.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    slots = [n, *order]  # the empty suffix is the lowest
    place, group = [0] * (n + 1), [0] * (n + 1)
    size: dict[int, int] = {0: 1}
    start, last = 0, None
    for at, i in enumerate(slots[1:], 1):
        place[i] = at
        if text[i] != last:
            start, last = at, text[i]
            size[start] = 0
        group[i] = start
        size[start] += 1
    smaller = [-1] * (n + 1)

    end = n + 1
    while end > 1:
        low = group[slots[end - 1]]
        members = slots[low:end]
        for i in members:  # to the nearest earlier one that is not in a higher group
            j = i - 1
            while j >= 0 and group[j] > low:
                j = smaller[j]
            smaller[i] = j
        for i in members:  # and past those of this group
            way = []
            j = smaller[i]
            while j >= 0 and group[j] == low:
                way.append(j)
                j = smaller[j]
            smaller[i] = j
            for k in way:
                smaller[k] = j
        followed: dict[int, int] = {}
        for i in members:
            if (j := smaller[i]) >= 0:
                followed[j] = followed.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        for j, times in followed.items():
            by_times.setdefault(times, []).append(j)
        for times in sorted(by_times, reverse=True):
            movers = by_times[times]
            for j in movers:
                old = group[j]
                size[old] -= 1
                there, here = old + size[old], place[j]
                other = slots[there]
                slots[here], slots[there] = other, j
                place[other], place[j] = here, there
            for j in movers:
                group[j] += size[group[j]]
                size.setdefault(group[j], 0)
            for j in movers:
                size[group[j]] += 1
        end = low

    out, ahead, settled = [n] + [0] * n, {}, [False] * (n + 1)
    for at in range(n + 1):
        j = out[at] - 1
        while j >= 0 and not settled[j]:
            spot = ahead.get(group[j], group[j])
            out[spot], ahead[group[j]], settled[j] = j, spot + 1, True
            j = smaller[j]
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place in the suffix array, the symbols shared with the place before."""
    n, rank = len(text), [0] * len(text)
    for at, i in enumerate(order):
        rank[i] = at
    out, k = [0] * n, 0
    for i in range(n):
        if not rank[i]:
            k = 0
            continue
        j = order[rank[i] - 1]
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        out[rank[i]] = k
        k = max(0, k - 1)
    return out
