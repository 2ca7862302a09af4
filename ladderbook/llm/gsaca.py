"""Linear suffix sorting by grouping, over many short texts in step.

Each lane holds one text. Its suffixes are first grouped by their first symbol. Then the groups
are taken in descending order: a member's previous-smaller pointer leads to the nearest earlier
suffix in a lower group, and the suffixes pointed to are split off to the upper end of their own
group, ordered by how many members of the group in hand point to them. In the end a group holds
the suffixes with one Lyndon prefix. A last pass emits each group's order: from every suffix taken
in ascending order, the chain of previous-smaller pointers that starts just before it is put at
the fronts of the groups on the chain. No ranks are renamed and nothing recurses. All lanes take
a step at a time, so that numpy handles the steps of thousands of texts at once.
"""

from __future__ import annotations

import numpy as np

from .common import ragged


def suffix_order(symbols: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """The suffixes of each lane in ascending order.

    symbols: the lanes' texts one after another, each ending in a 0 that occurs nowhere else in it.
    lanes: where each lane starts, and the end of the last. Returns positions in symbols, lane by lane.
    """
    n = int(lanes[-1])
    if n == 0:
        return np.empty(0, np.int64)
    lane_of = np.repeat(np.arange(len(lanes) - 1, dtype=np.int64), np.diff(lanes))
    group, before = _grouped(symbols, lane_of, lanes, n)
    return _emitted(group, before, lanes, n)


def _grouped(symbols: np.ndarray, lane_of: np.ndarray, lanes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the first slot of its final group, and its previous-smaller pointer (n: none)."""
    key = lane_of * (int(symbols.max()) + 1) + symbols
    at = np.argsort(key, kind="stable")  # slot -> position
    slot = np.empty(n, np.int64)  # position -> slot
    slot[at] = np.arange(n)
    opens = np.flatnonzero(np.r_[True, np.diff(key[at]) != 0])
    sizes = np.diff(np.r_[opens, n])
    group = np.empty(n, np.int64)  # position -> first slot of its group
    group[at] = np.repeat(opens, sizes)
    ends = np.zeros(n + 1, np.int64)  # first slot of a group -> slot after its last
    ends[opens] = opens + sizes
    before = np.arange(-1, n, dtype=np.int64)
    before[lanes[:-1]] = n
    before[n] = n
    done = np.zeros(n + 1, bool)
    taken = np.zeros(n, bool)
    upper, lower = lanes[1:].copy(), lanes[:-1]
    while True:
        live = upper > lower
        if not live.all():
            upper, lower = upper[live], lower[live]
            if not len(upper):
                return group, before[:n]
        first = group[at[upper - 1]]
        members = at[ragged(first, upper - first)]
        upper = first
        done[members] = True
        to = before[members]
        again = np.flatnonzero(done[to])
        while len(again):
            to[again] = before[to[again]]
            before[members[again]] = to[again]
            again = again[done[to[again]]]
        to = to[to < n]
        if not len(to):
            continue
        to.sort()
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        moved, times = to[cut], np.diff(np.r_[cut, len(to)])
        home = group[moved]
        order = np.lexsort((times, home))
        moved, times, home = moved[order], times[order], home[order]
        new_home = np.r_[True, home[1:] != home[:-1]]
        runs = np.flatnonzero(new_home)
        count = np.diff(np.r_[runs, len(home)])
        end = ends[home[runs]]
        target = ragged(end - count, count)
        source = slot[moved]
        taken[source] = True
        pushed = target[~taken[target]]  # who stands there and stays in the old group goes where the moved ones leave
        taken[source] = False
        left = source[source < np.repeat(end - count, count)]
        staying = at[pushed]
        at[left] = staying
        slot[staying] = left
        at[target] = moved
        slot[moved] = target
        ends[home[runs]] = end - count
        new_group = np.flatnonzero(new_home | np.r_[True, times[1:] != times[:-1]])
        width = np.diff(np.r_[new_group, len(home)])
        start = target[new_group]
        group[moved] = np.repeat(start, width)
        ends[start] = start + width


def _emitted(group: np.ndarray, before: np.ndarray, lanes: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    front = np.arange(n, dtype=np.int64)
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    keep = np.diff(lanes) > 0
    first, at, last = lanes[:-1][keep], lanes[:-1][keep].copy(), lanes[1:][keep]
    out[at] = last - 1  # the sentinel is the least suffix
    placed[last - 1] = True
    front[at] += 1
    chain = np.where(last - 1 > first, last - 2, n)
    while len(at):
        go = np.flatnonzero(~placed[chain])
        if len(go):
            here = chain[go]
            g = group[here]
            out[front[g]] = here
            front[g] += 1
            placed[here] = True
            chain[go] = before[here]
        stop = np.flatnonzero(placed[chain])
        if len(stop):
            at[stop] += 1
            live = at < last
            if not live.all():
                first, at, last, chain = first[live], at[live], last[live], chain[live]
                stop = np.flatnonzero(placed[chain])
            here = out[at[stop]]
            chain[stop] = np.where(here > first[stop], here - 1, n)
    return out
