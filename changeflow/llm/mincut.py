"""Minimum cut of a small graph between two sides, by maximum flow."""

from __future__ import annotations

from collections import deque


def sides(preference: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the first side of a minimum cut; in a tie a node is on the first side.

    preference: what it costs to put a node on the second side (positive) or on the first (negative).
    edges: two nodes, and what it costs to part them. Whole numbers only.
    """
    if min(preference, default=0) >= 0:
        return [True] * len(preference)
    if max(preference) <= 0 and all(preference):
        return [False] * len(preference)
    source, sink = len(preference), len(preference) + 1
    heads: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, forth: int, back: int) -> None:
        heads[a].append(len(to)), to.append(b), room.append(forth)
        heads[b].append(len(to)), to.append(a), room.append(back)

    for node, value in enumerate(preference):
        if value > 0:
            join(source, node, value, 0)
        elif value < 0:
            join(node, sink, -value, 0)
    for a, b, cost in edges:
        join(a, b, cost, cost)
    while True:
        level = [-1] * (sink + 1)
        level[source], queue = 0, deque([source])
        while queue and level[sink] < 0:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        # Paths along rising levels; a node's edges that lead nowhere are not tried again at this level.
        tried, path = [0] * (sink + 1), []
        node = source
        while True:
            if node == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, node = [], source
                continue
            while tried[node] < len(heads[node]):
                e = heads[node][tried[node]]
                if room[e] and level[to[e]] == level[node] + 1:
                    break
                tried[node] += 1
            else:
                if node == source:
                    break
                level[node] = -1
                e = path.pop()
                node = to[e ^ 1]
                continue
            path.append(e)
            node = to[e]
    # What can still reach the sink is on its side.
    second, queue = {sink}, deque([sink])
    while queue:
        b = queue.popleft()
        for e in heads[b]:
            if room[e ^ 1] and to[e] not in second:
                second.add(to[e])
                queue.append(to[e])
    return [node not in second for node in range(len(preference))]
