"""Many motifs in one chain of joins: ordered edges share prefixes, partial matches are summed as soon as nodes are done with.

Motifs are inserted into a trie of ordered edges, their nodes renamed by first appearance, so a prefix that several motifs have
is matched once. A partial match is a row (graph, state, bound nodes, first time, last time, count), its state a place in the
trie. A level of the trie is one join for all states: a row asks for each child of its state for events at a bound node, with
the other end given for an edge that closes, or a new node. Matches of finished motifs ride along until the end.

Absent edges of the induced mode are anti-joins by pair of places, for the states that need them, as early as all motifs below
a state agree. Nodes that no later edge, check or new node needs become null, and equal rows are then one, with their counts
added (``kind`` count), or of those with one last time only the one that began last (``kind`` first): whatever completes an
earlier beginning inside the window completes that one too. So rows follow the number of distinct open ends, not of instances.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from chronomotif.plans import catalog


def canonical(edges: list[tuple[int, int]]) -> tuple[tuple[int, int], ...] | None:
    """Edges with nodes renamed by first appearance, each (bound, new) or (later, earlier); None if a prefix isn't connected.

    Of the two names that the first edge's nodes can have, those that are greater in edge order are taken.
    """
    found = []
    for first in (edges[0], edges[0][::-1]):
        name = {first[0]: 0, first[1]: 1}
        out = [(0, 1)]
        for a, b in edges[1:]:
            if a not in name and b not in name:
                return None
            if b not in name or a not in name:
                bound, new = (a, b) if a in name else (b, a)
                name[new] = len(name)
                out.append((name[bound], name[new]))
            else:
                out.append((max(name[a], name[b]), min(name[a], name[b])))
        found.append(tuple(out))
    return max(found)


@dataclass
class State:
    """A place in the trie: ``edges`` so far on ``nodes`` nodes, motifs that end here, and below."""

    id: int
    edges: tuple[tuple[int, int], ...]
    nodes: int
    children: list[State] = field(default_factory=list)
    ends: list[Leaf] = field(default_factory=list)
    checked: frozenset[tuple[int, int]] = frozenset()
    checks: frozenset[tuple[int, int]] = frozenset()

    def leaves(self) -> list[Leaf]:
        return self.ends + [leaf for child in self.children for leaf in child.leaves()]

    def window(self) -> int:
        """The widest below; 0 is none."""
        windows = [leaf.window for leaf in self.leaves()]
        return 0 if min(windows) <= 0 else max(windows)

    def needed(self) -> set[int]:
        """Bound nodes that a later edge, check or new node refers to."""
        out: set[int] = set()
        for leaf in self.leaves():
            later = leaf.edges[len(self.edges) :]
            if any(max(e) >= self.nodes for e in later):
                return set(range(self.nodes))
            out |= {n for e in later for n in e} | {n for pair in leaf.absent - self.checked for n in pair}
        return out


@dataclass
class Leaf:
    """A motif's end."""

    id: int
    name: str
    edges: tuple[tuple[int, int], ...]
    window: int
    absent: frozenset[tuple[int, int]]


def levels(motifs: dict[str, tuple[list[tuple[int, int]], int]], mode: str) -> list[list[State]]:
    """The trie of (edges, window) by motif, states by number of edges. Every motif must be ``canonical``."""
    root, made = State(0, ((0, 1),), 2), 0
    for name, (edges, window) in motifs.items():
        own = canonical(edges)
        at = root
        for k in range(2, len(own) + 1):
            found = next((c for c in at.children if c.edges == own[:k]), None)
            if found is None:
                made += 1
                found = State(made, own[:k], max(max(e) for e in own[:k]) + 1)
                at.children.append(found)
            at = found
        made += 1
        at.ends.append(Leaf(made, name, own, window, frozenset(catalog.non_edges(list(own)) if mode == "induced" else [])))
    out = [[root]]
    while out[-1]:
        for state in out[-1]:
            for child in state.children:
                shared = frozenset.intersection(*(leaf.absent for leaf in child.leaves()))
                child.checks = frozenset(p for p in shared if max(p) < child.nodes) - state.checked
                child.checked = state.checked | child.checks
        out.append([child for state in out[-1] for child in state.children])
    return out[:-1]


def _ids(states: list) -> str:
    return ", ".join(str(s.id) for s in states)


def _cases(values: dict[str, list], name: str) -> str:
    """An SQL condition: of each text, the states it holds for."""
    return "(" + " OR ".join(f"({name} IN ({_ids(states)}) AND {text})" if text else f"{name} IN ({_ids(states)})" for text, states in values.items()) + ")"


def _grouped(pairs: list[tuple[str, object]]) -> dict[str, list]:
    out: dict[str, list] = {}
    for text, state in pairs:
        out.setdefault(text, []).append(state)
    return out


def query(motifs: dict[str, tuple[list[tuple[int, int]], int]], window_op: str = "le", mode: str = "induced", kind: str = "count", binned: bool = False, node_type: str = "int") -> str:
    """SQL over {directed} and {static}: (graph_id, motif_name, c or last) of the motifs that a graph has.

    ``kind``: count (sum of instances) or first (least time at which one is complete). ``binned``: tables of ``units.binned``.
    """
    trie = levels(motifs, mode)
    unit = ["graph_id", "bin"] if binned else ["graph_id"]
    keys = lambda x: ", ".join(f"{x}.{c}" for c in unit)
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in unit)
    spans = lambda last, first, w: f"{last} - {first} {'<=' if window_op == 'le' else '<'} {w}" if w > 0 else ""
    null = f"CAST(NULL AS {node_type})"
    total = ", 1L AS c" if kind == "count" else ""
    carried = ", p.c" if kind == "count" else ""
    # No column is a constant: the optimizer would take it out below the generators, which hold places of columns.
    text = f"SELECT {', '.join(unit)}, s AS n0, d AS n1, t AS first, t AS last{total} FROM {{directed}} WHERE t > -1{' AND own' if binned else ''}"
    live = [0, 1]
    for k, states in enumerate(trie):
        after = trie[k + 1] if k + 1 < len(trie) else []
        asks = []
        for state in states:
            rows = [f"named_struct('state', {c.id}, 'f', n{c.edges[-1][0]}, 'g', {null if c.nodes > state.nodes else f'n{c.edges[-1][1]}'})" for c in state.children]
            rows += [f"named_struct('state', {leaf.id}, 'f', {null}, 'g', {null})" for leaf in state.ends]
            asks.append(f"WHEN {state.id} THEN array({', '.join(rows)})" if k else f"array({', '.join(rows)})")
        done = [leaf for level in trie[:k] for state in level for leaf in state.ends]  # ended before
        asks += [f"WHEN {leaf.id} THEN array(named_struct('state', {leaf.id}, 'f', {null}, 'g', {null}))" for leaf in done]
        ends = [leaf for state in states for leaf in state.ends]
        fits = _cases(_grouped([*[(spans("p.last", "p.first", leaf.window), leaf) for leaf in ends], *[("", s) for s in (*after, *done)]]), "q.state") if ends else "true"
        own = "".join(f"p.n{j}, " for j in live)
        rows = f"CASE p.state {' '.join(asks)} END" if k else asks[0]
        text = f"SELECT {keys('p')}, q.state, q.f, q.g, {own}p.first, p.last{carried} FROM ({text}) p LATERAL VIEW inline({rows}) q AS state, f, g WHERE {fits}"
        if after:
            new = {j: [s for s in after if s.edges[-1][1] == j and j not in {n for e in s.edges[:-1] for n in e}] for j in range(max(s.nodes for s in after))}
            columns = {j: f"CASE WHEN p.state IN ({_ids(new[j])}) THEN e.d {f'ELSE p.n{j} ' if j in live else ''}END" if new[j] else f"p.n{j}" for j in new if new[j] or j in live}
            limits = _grouped([(spans("e.t", "p.first", s.window()), s) for s in after])
            keyed = f"(SELECT {', '.join(unit)}, s, d, t, k FROM {{directed}} LATERAL VIEW explode(array(d, {null})) x AS k)"
            others = " AND ".join(["true", *(f"(p.n{j} IS NULL OR e.d <> p.n{j})" for j in live)])
            join = f"LEFT JOIN {keyed} e ON {same('e', 'p')} AND e.s = p.f AND e.k <=> p.g AND e.t > p.last AND {_cases(limits, 'p.state')} AND (p.g IS NOT NULL OR {others})"
            text = f"SELECT {keys('p')}, p.state, {''.join(f'{c} AS n{j}, ' for j, c in columns.items())}p.first, coalesce(e.t, p.last) AS last{carried} FROM ({text}) p {join} WHERE p.f IS NULL OR e.t IS NOT NULL"
            live = list(columns)
        checks = _grouped([(pair, s) for s in after for pair in sorted(s.checks)] + [(pair, leaf) for state in states for leaf in state.ends for pair in sorted(leaf.absent - state.checked)])
        for (a, b), some in checks.items():
            pair = lambda f, a=a, b=b, some=some: f"CASE WHEN p.state IN ({_ids(some)}) THEN {f}(p.n{a}, p.n{b}) END"
            text = f"SELECT p.* FROM ({text}) p LEFT ANTI JOIN {{static}} x ON {same('x', 'p')} AND x.lo = {pair('least')} AND x.hi = {pair('greatest')}"
        fewer = [s for s in after if len(s.needed()) < s.nodes]
        if after and (fewer or ends):  # equal open ends are one row
            riding = len(ends) + len(done)
            needing = {j: some for j in live if (some := [s for s in after if j in s.needed()])}
            kept = {j: f"p.n{j}" if len(some) == len(after) and not riding else f"CASE WHEN p.state IN ({_ids(some)}) THEN p.n{j} END" for j, some in needing.items()}
            time = lambda c: f"CASE WHEN p.state IN ({_ids(after)}) THEN p.{c} END" if riding else f"p.{c}"
            inner = f"SELECT {keys('p')}, p.state, {''.join(f'{c} AS n{j}, ' for j, c in kept.items())}p.first, p.last, {time('first')} AS kf, {time('last')} AS kl{carried} FROM ({text}) p"
            live = list(kept)
            own = "".join(f"p.n{j}, " for j in live)
            times = "min(p.first) AS first, min(p.last) AS last, sum(p.c) AS c" if kind == "count" else "max(p.first) AS first, min(p.last) AS last"
            text = f"SELECT {keys('p')}, p.state, {own}{times} FROM ({inner}) p GROUP BY {keys('p')}, p.state, {own}p.kl{', p.kf' if kind == 'count' else ''}"
    names = " ".join(f"WHEN {leaf.id} THEN '{leaf.name}'" for level in trie for state in level for leaf in state.ends)
    value = "sum(c) AS n_instances" if kind == "count" else "min(last) AS first_time"
    return f"SELECT graph_id, CASE state {names} END AS motif_name, {value} FROM ({text}) GROUP BY graph_id, state"
