"""Process trees the slow way: matrices for the cuts, lists of traces for the rest.

What the tests hold the library's rows against. Every step really projects the
traces; nothing is derived from the relations of a node above.
"""

from __future__ import annotations

import numpy as np


def _groups(linked: np.ndarray) -> list[set[int]]:
    """Connected components of a symmetric relation."""
    reach = _reachable(linked | linked.T) | np.eye(len(linked), dtype=bool)
    return [set(np.flatnonzero(row)) for row in np.unique(reach, axis=0)]


def _reachable(step: np.ndarray) -> np.ndarray:
    """Transitive closure by repeated squaring."""
    reach = step.copy()
    while True:
        wider = reach | (reach.astype(np.float32) @ reach.astype(np.float32) > 0)
        if (wider == reach).all():
            return reach
        reach = wider


def _sequence(edge: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[set[int]]:
    """Ordered groups, each reaching only later ones.

    Groups that some case jumps over in one go are optional together, so they
    become one group; if that leaves a single group, all stay apart.
    """
    reach = _reachable(edge)
    groups = _groups(~(reach ^ reach.T))
    heads = [min(g) for g in groups]
    later = reach[np.ix_(heads, heads)] & ~np.eye(len(heads), dtype=bool)
    groups = [groups[i] for i in np.argsort(-later.sum(axis=1), kind="stable")]
    if len(groups) < 2:
        return groups
    place = {a: i for i, g in enumerate(groups) for a in g}
    jumps = {(place[a], place[b]) for a, b in zip(*np.nonzero(edge))}
    jumps |= {(-1, place[a]) for a in np.flatnonzero(start)}
    jumps |= {(place[a], len(groups)) for a in np.flatnonzero(end)}
    together = list(range(len(groups)))
    for low, high in sorted(jumps):
        for i in range(low + 2, high):
            together[i] = -1  # joins the group before it
    merged: list[set[int]] = []
    for group, mark in zip(groups, together):
        if mark == -1 and merged:
            merged[-1] |= group
        else:
            merged.append(set(group))
    return merged if len(merged) > 1 else groups


def _parallel(edge: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[set[int]]:
    """Groups that follow each other both ways, each able to start and to end."""
    groups = _groups(~(edge & edge.T))
    whole = [g for g in groups if start[list(g)].any() and end[list(g)].any()]
    if len(whole) < 2:
        return []
    for group in groups:
        if group not in whole:
            whole[0] = whole[0] | group
    return sorted(whole, key=min)


def _loop(edge: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[set[int]]:
    """The body first, then the parts that lead from its ends back to its starts."""
    body = set(np.flatnonzero(start | end))
    rest = sorted(set(range(len(edge))) - body)
    if not rest:
        return []
    inner = edge[np.ix_(rest, rest)]
    redo = []
    for part in _groups(inner):
        part = {rest[i] for i in part}
        ok = True
        for x in part:
            before = {a for a in body if edge[a, x]}
            after = {a for a in body if edge[x, a]}
            ends, starts = set(np.flatnonzero(end)), set(np.flatnonzero(start))
            ok &= before in (set(), ends) and after in (set(), starts)
        enters = edge[np.ix_(sorted(body), sorted(part))].any()
        leaves = edge[np.ix_(sorted(part), sorted(body))].any()
        if ok and enters and leaves:
            redo.append(part)
        else:
            body |= part
    return [body, *sorted(redo, key=min)] if redo else []


def _skipped(groups: list[set[int]], edge: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bool]:
    """Which groups of a sequence some trace passes over.

    A trace passes through the groups in order, so one that leaves a group out
    shows it by a step, a start or an end beyond it.
    """
    place = {a: i for i, g in enumerate(groups) for a in g}
    jumps = {(place[a], place[b]) for a, b in zip(*np.nonzero(edge))}
    jumps |= {(-1, place[a]) for a in np.flatnonzero(start)}
    jumps |= {(place[a], len(groups)) for a in np.flatnonzero(end)}
    return [any(low < i < high for low, high in jumps) for i in range(len(groups))]


def _cut(edge: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[str, list[set[int]]] | None:
    for op, groups in (
        ("xor", sorted(_groups(edge), key=min)),
        ("sequence", _sequence(edge, start, end)),
        ("parallel", _parallel(edge, start, end)),
        ("loop", _loop(edge, start, end)),
    ):
        if len(groups) > 1:
            return op, groups
    return None


def _relations(traces):
    names = sorted({a for t in traces for a in t})
    at = {a: i for i, a in enumerate(names)}
    edge = np.zeros((len(names), len(names)), dtype=bool)
    start, end = np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=bool)
    for t in traces:
        start[at[t[0]]] = end[at[t[-1]]] = True
        for a, b in zip(t, t[1:]):
            edge[at[a], at[b]] = True
    return names, edge, start, end


def cut_of(traces):
    """The operator and the groups of activities that the traces show, or None."""
    names, edge, start, end = _relations(traces)
    found = _cut(edge, start, end) if len(names) > 1 else None
    if found is None:
        return None
    op, groups = found
    optional = _skipped(groups, edge, start, end) if op == "sequence" else [False] * len(groups)
    return op, [[names[i] for i in sorted(g)] for g in groups], optional


def _pieces(trace, places, begins):
    """A trace cut where the part changes, or where ``begins`` says so."""
    out = [[trace[0]]]
    for a, b in zip(trace, trace[1:]):
        if (places[a] != places[b]) if begins is None else begins(a, b):
            out.append([])
        out[-1].append(b)
    return out


def mine(traces):
    """The tree of some traces, as nested tuples (operator, children), names, or None for a silent step."""
    whole = {tuple(t) for t in traces}
    some = {t for t in whole if t}
    if len(some) < len(whole):
        return ("xor", [None, mine(some)]) if some else None
    names, edge, start, end = _relations(some)
    if len(names) == 1 and not edge.any():
        return names[0]
    found = cut_of(some)
    if found:
        op, groups, _ = found
        places = {a: i for i, g in enumerate(groups) for a in g}
        parts = [[] for _ in groups]
        for t in some:
            if op == "xor":
                parts[places[t[0]]].append(t)
            elif op == "loop":
                for piece in _pieces(t, places, None):
                    parts[places[piece[0]]].append(piece)
            else:
                for i, g in enumerate(groups):
                    parts[i].append([a for a in t if a in g])
        return (op, [mine(p) for p in parts])
    if len(names) > 1:
        free = [a for a in names if all(t.count(a) == 1 for t in some)][:1]
        for a in [] if free else names:
            rest = [[b for b in t if b != a] for t in some]
            if cut_of([t for t in rest if t]):
                free = [a]
                break
        if free:
            alone = [[a for a in t if a in free] for t in some]
            rest = [[a for a in t if a not in free] for t in some]
            return ("parallel", [mine(alone), mine(rest)])
    first = {a for a, s in zip(names, start) if s}
    last = {a for a, e in zip(names, end) if e}
    for begins in (lambda a, b: a in last and b in first, lambda a, b: b in first):
        body = [piece for t in some for piece in _pieces(t, None, begins)]
        if len(body) > len(some):
            return ("loop", [mine(body), None])
    return ("loop", [None, *names])


def folded(tree):
    """Operators directly under the same operator joined with it, except loops."""
    if not isinstance(tree, tuple):
        return tree
    op, children = tree
    out = []
    for child in map(folded, children):
        if isinstance(child, tuple) and child[0] == op != "loop":
            out += child[1]
        else:
            out.append(child)
    return (op, out)


def as_text(tree):
    if not isinstance(tree, tuple):
        return "tau" if tree is None else tree
    return f"{tree[0]}({', '.join(map(as_text, tree[1]))})"
