"""Optimal assignment with the option of no match, for one connected set of candidate pairs."""

from __future__ import annotations

from heapq import heappop, heappush


def best_assignment(pairs: list[tuple[int, int, float]], no_match: float) -> list[tuple[int, int]]:
    """Pairs chosen so that matched costs plus ``no_match`` for every unmatched side are least.

    Matching a pair saves twice ``no_match`` less its cost; what saves nothing
    is never chosen. Each x takes a y or stays alone, which saves nothing.
    Shortest augmenting paths over the candidate lists, with prices that keep
    reduced costs from falling below 0: memory is that of the candidates, and a
    search ends where the first x can stay alone or a free y is reached.
    """
    saves: dict = {}
    for x, y, c in pairs:
        if c < 2 * no_match:
            ways = saves.setdefault(x, {})
            ways[y] = min(ways.get(y, 0.0), c - 2 * no_match)
    mate: dict = {}  # y to its x
    taken: dict = {}  # x to its y; an x that stays alone is absent
    price_x: dict = {}
    price_y: dict = {}
    for start in sorted(saves):
        price_x[start] = 0.0
        reach: dict = {}
        came: dict = {}
        settled: list = []
        done: set = set()
        scanned: list = [(start, 0.0)]
        heap: list = []
        at, length = start, 0.0
        while True:
            for y, w in saves[at].items():
                far = length + w - price_x[at] - price_y.get(y, 0.0)
                if y not in done and far < reach.get(y, float("inf")):
                    reach[y], came[y] = far, at
                    heappush(heap, (far, 0, y))
            heappush(heap, (length - price_x[at], 1, at))  # to stay alone
            length, kind, found = heappop(heap)
            while kind == 0 and (length > reach[found] or found in done):
                length, kind, found = heappop(heap)
            if kind == 1 or found not in mate:
                break
            settled.append((found, length))
            done.add(found)
            at = mate[found]
            scanned.append((at, length))
        for x, before in scanned:
            price_x[x] += length - before
        for y, before in settled:
            price_y[y] = price_y.get(y, 0.0) - (length - before)
        # Turn the path round, from its end back to the start.
        if kind == 1:
            x, y = found, taken.pop(found, None)
        else:
            x, y = came[found], taken.get(came[found])
            mate[found] = x
            taken[x] = found
        while x != start:
            x2 = came[y]
            y2 = taken.get(x2)
            mate[y], taken[x2] = x2, y
            x, y = x2, y2
    return sorted((x, y) for x, y in taken.items())


def total_cost(pairs: list[tuple[int, int, float]], chosen: list[tuple[int, int]], no_match: float) -> float:
    cost = {(x, y): c for x, y, c in pairs}
    sides = len({p[0] for p in pairs}) + len({p[1] for p in pairs})
    return sum(cost[p] for p in chosen) + no_match * (sides - 2 * len(chosen))
