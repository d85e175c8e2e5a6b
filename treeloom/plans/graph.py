"""Order and connection of tables by their links. Small graphs of table names, on the driver."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Mapping


def topological_sort(parents: Mapping[str, Iterable[str]], tables: Iterable[str] | None = None) -> list[str]:
    """Tables with parents first, ties in order of name; a link of a table to itself does not count. ValueError on a cycle."""
    wanted = set(tables) if tables is not None else set(parents) | {p for ps in parents.values() for p in ps}
    above = {t: {p for p in parents.get(t, ()) if p in wanted and p != t} for t in wanted}
    below: dict[str, list[str]] = {t: [] for t in wanted}
    for t, ps in above.items():
        for p in ps:
            below[p].append(t)
    ready = [t for t, ps in above.items() if not ps]
    heapq.heapify(ready)
    order: list[str] = []
    while ready:
        order.append(t := heapq.heappop(ready))
        for child in below[t]:
            above[child].discard(t)
            if not above[child]:
                heapq.heappush(ready, child)
    if len(order) < len(wanted):
        raise ValueError(f"Circular dependency between tables: {', '.join(sorted(wanted - set(order)))}")
    return order


def weakly_connected_components(parents: Mapping[str, Iterable[str]], tables: Iterable[str]) -> list[set[str]]:
    """Groups of tables that links join, in order of their least name."""
    group = {t: t for t in tables}

    def find(t: str) -> str:
        while group[t] != t:
            group[t] = group[group[t]]
            t = group[t]
        return t

    for t, ps in parents.items():
        for p in ps:
            if t in group and p in group:
                a, b = find(t), find(p)
                group[max(a, b)] = min(a, b)
    out: dict[str, set[str]] = {}
    for t in sorted(group):
        out.setdefault(find(t), set()).add(t)
    return [out[k] for k in sorted(out)]


def partition_components(parents: Mapping[str, Iterable[str]], tables: Iterable[str], eager: Iterable[str] = ()) -> list[set[str]]:
    """Groups of linked tables when links to eager tables do not count; tables without any link form one group, last."""
    eager = set(eager)
    rest = [t for t in tables if t not in eager]
    kept = {t: {p for p in ps if p not in eager} for t, ps in parents.items() if t not in eager}
    groups = weakly_connected_components(kept, rest)
    lone = {t for g in groups if len(g) == 1 for t in g if not kept.get(t)}
    return [g for g in groups if not g <= lone] + ([lone] if lone else [])
