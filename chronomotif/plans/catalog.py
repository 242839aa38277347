"""The motif catalogs: ordered edges and windows. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EDGES: dict[str, list[tuple[int, int]]] = {
    "3-star": [(0, 1), (0, 2), (0, 3)],
    "triangle": [(0, 1), (1, 2), (2, 0)],
    "4-path": [(0, 1), (1, 2), (2, 3)],
    "4-cycle": [(0, 1), (1, 2), (2, 3), (3, 0)],
    "4-chordalcycle": [(0, 1), (1, 2), (2, 3), (3, 1), (3, 0)],
    "4-tailedtriangle": [(0, 1), (1, 2), (2, 3), (3, 1)],
    "4-clique": [(0, 1), (1, 2), (1, 3), (2, 3), (3, 0), (0, 2)],
    "bitriangle": [(0, 1), (1, 3), (3, 5), (5, 4), (4, 2), (2, 0)],
    "butterfly": [(0, 1), (1, 3), (3, 2), (2, 0)],
}
TWO_STAR = [(0, 1), (0, 2)]
WINDOWS: dict[str, dict[str, int]] = {
    "default": {"3-star": 3, "triangle": 3, "4-path": 3, "4-cycle": 6, "4-chordalcycle": 14, "4-tailedtriangle": 6, "4-clique": 15, "bitriangle": 15, "butterfly": 6},
    "contain": {"3-star": 3, "triangle": 4, "4-path": 3, "4-cycle": 6, "4-chordalcycle": 14, "4-tailedtriangle": 7, "4-clique": 27, "bitriangle": 14, "butterfly": 6},
}
NAMES = list(EDGES)


def n_nodes(edges: list[tuple[int, int]]) -> int:
    return max(max(e) for e in edges) + 1


def non_edges(edges: list[tuple[int, int]], nodes: int | None = None) -> list[tuple[int, int]]:
    """Unordered node pairs without an edge."""
    have = {(min(e), max(e)) for e in edges}
    n = nodes or n_nodes(edges)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if (a, b) not in have]


def parse_motif(events: list) -> list[tuple[int, int]]:
    """Ordered edges of a definition such as [('u0', 'u1', 't0', 'a'), ...]."""
    digits = lambda x: int(str(x).strip().lstrip("ut"))
    rows = sorted((digits(e[2]), digits(e[0]), digits(e[1])) for e in events if len(e) == 4 and e[3] == "a")
    names: dict[int, int] = {n: i for i, n in enumerate(sorted({x for _, u, v in rows for x in (u, v)}))}
    return [(names[u], names[v]) for _, u, v in rows]


def catalog_table(spark: SparkSession) -> DataFrame:
    """(catalog, motif_name, pos, mu, mv, n_nodes, n_edges, window)."""
    rows = [(c, m, i, u, v, n_nodes(EDGES[m]), len(EDGES[m]), w[m]) for c, w in WINDOWS.items() for m in NAMES for i, (u, v) in enumerate(EDGES[m])]
    return spark.createDataFrame(rows, "catalog string, motif_name string, pos int, mu int, mv int, n_nodes int, n_edges int, window int")
