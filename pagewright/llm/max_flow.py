"""Minimum cut of a small graph with two terminals, by shortest augmenting layers."""

from __future__ import annotations


class CutGraph:
    """Nodes 0 to n - 1; capacities are whole numbers."""

    def __init__(self, n: int):
        self.n = n
        self.edges: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.room: list[int] = []

    def _arc(self, a: int, b: int, forth: int, back: int) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [forth, back]

    def terminal(self, node: int, source: int, sink: int) -> None:
        """Cost of cutting the node from the source, and from the sink."""
        if source > sink:
            self._arc(self.n, node, source - sink, 0)
        elif sink > source:
            self._arc(node, self.n + 1, sink - source, 0)

    def smooth(self, a: int, b: int, cost: int) -> None:
        """Cost of putting two nodes on different sides."""
        if cost > 0:
            self._arc(a, b, cost, cost)

    def source_side(self) -> list[bool]:
        """Per node whether it stays with the source in a minimum cut."""
        source, sink = self.n, self.n + 1
        edges, to, room = self.edges, self.to, self.room
        while True:
            level = [-1] * (self.n + 2)
            level[source] = 0
            layer = [source]
            while layer and level[sink] < 0:
                after = []
                for a in layer:
                    for e in edges[a]:
                        if room[e] and level[to[e]] < 0:
                            level[to[e]] = level[a] + 1
                            after.append(to[e])
                layer = after
            if level[sink] < 0:
                return [x >= 0 for x in level[: self.n]]
            turn = [0] * (self.n + 2)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    flow = min(room[e] for e in path)
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    k = next(i for i, e in enumerate(path) if not room[e])
                    at = to[path[k] ^ 1]
                    del path[k:]
                    continue
                mine = edges[at]
                while turn[at] < len(mine):
                    e = mine[turn[at]]
                    if room[e] and level[to[e]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(mine):
                    path.append(mine[turn[at]])
                    at = to[path[-1]]
                elif at == source:
                    break
                else:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
