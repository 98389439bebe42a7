"""Connected components: of an edge table, and of the pairs within a task."""

from __future__ import annotations

from ..operators.graph import connected_components

__all__ = ["connected_components", "local_forest"]


def local_forest(pairs) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the nodes of ``pairs`` that aren't their component's smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]
