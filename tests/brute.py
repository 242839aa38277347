"""An event-by-event matcher that shares nothing with the join plans."""

from itertools import permutations

EVENTS = "graph_id bigint, seq int, u int, v int, t int, op string"


def instances(events, edges, window, strict=False, induced=True, identity=False):
    """The set of matches (nodes, times) of one graph's events (u, v, t, op)."""
    adds = sorted({(min(u, v), max(u, v), t) for u, v, t, op in events if op == "a" and u != v})
    static = {(u, v) for u, v, _ in adds}
    times = {}
    for u, v, t in adds:
        times.setdefault((u, v), []).append(t)
    nodes = sorted({x for e in static for x in e})
    k = max(max(e) for e in edges) + 1
    pairs = {(min(e), max(e)) for e in edges}
    found = set()
    for m in permutations(nodes, k):
        at = lambda a, b: (min(m[a], m[b]), max(m[a], m[b]))
        if any(at(a, b) not in static for a, b in pairs):
            continue
        if induced and any(at(a, b) in static for a in range(k) for b in range(a + 1, k) if (a, b) not in pairs):
            continue
        if identity and set(m) != set(range(k)):
            continue

        def walk(i, ts):
            if i == len(edges):
                found.add(frozenset((*at(*e), t) for e, t in zip(edges, ts, strict=True)))
                return
            for t in times[at(*edges[i])]:
                if t > (ts[-1] if ts else -1) and (window <= 0 or not ts or (t - ts[0] < window if strict else t - ts[0] <= window)):
                    walk(i + 1, [*ts, t])

        walk(0, [])
    return found
