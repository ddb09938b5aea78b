"""Connected components of nodes that meet in cells, for operators that link documents.

Nodes that share a cell may be linked. Each is paired with the cell's smallest node only, so a cell of m nodes gives
m - 1 pairs; links become components by alternating large-star and small-star. Cells in which nodes besides
the smallest lie in different components still hold untried pairs: while such a cell has more than SMALL nodes and
rounds make PROGRESS, the same is repeated without the smallest nodes, which have been tried with all. What is then
left is compared in blocks. Both ways test every pair of different components that shares a cell, so the
components don't depend on which of them is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import durable

#: Cells are paired by their smallest nodes, one after the other, until untried nodes of mixed ones are so few.
SMALL = 2048
#: ... or until a round leaves more than this share of the untried pairs.
PROGRESS = 0.7


def shared_cells(every: DataFrame) -> DataFrame:
    """(cell, node) of cells that more than one row has."""
    shared = every.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1").select("cell")
    return every.join(shared, "cell")


def _starred(edges: DataFrame) -> bool:
    """Whether each node of edges (u, v), u > v, has smaller neighbours or greater ones, and of smaller ones just one."""
    both = edges.union(edges.select("v", "u"))
    ends = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return not ends.where("low < u and low <> high").agg(F.count("*")).first()[0]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, after a large star and a small star."""
    # large star: greater neighbours move to the smallest of the neighbourhood
    low = edges.union(edges.select("v", "u")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    greater = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    moved = greater.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # small star: smaller neighbours and the node itself, for which the smallest one's row stands, move to the smallest
    moved = moved.join(moved.groupBy("u").agg(F.min("v").alias("m")), "u")
    # without repeated pairs, which would gather at nodes that many share
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for all nodes with a link."""
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _starred(edges):
        edges = durable(_contracted(edges))
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", "v"))
    return durable(ends.distinct())


def _untried(cells: DataFrame, comps: DataFrame) -> DataFrame:
    """(cell, node, comp, m) where pairs of different components are untried: without each cell's smallest node, whose pairs have all been tried."""
    labelled = cells.join(comps, "node", "left").select("cell", "node", F.coalesce("comp", "node").alias("comp"))
    low = labelled.groupBy("cell").agg(F.min("node").alias("low"))
    rest = durable(labelled.join(low, "cell").where("node <> low").drop("low"))
    mixed = rest.groupBy("cell").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).where("c0 <> c1")
    return durable(rest.join(mixed.select("cell", "m"), "cell"))


def _stars(cells: DataFrame) -> DataFrame:
    """(a, b): each cell's smallest node with those of other components."""
    low = cells.groupBy("cell").agg(F.min(F.struct("node", "comp")).alias("low"))
    pairs = cells.join(low, "cell").where((F.col("node") != F.col("low.node")) & (F.col("comp") != F.col("low.comp")))
    return pairs.select(F.col("low.node").alias("a"), F.col("node").alias("b")).distinct()


def linked_in_cells(cells: DataFrame, confirm: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, comp of all nodes with a link. cells: (cell, node). confirm() gives the links among pairs (a, b), across() links (a, b) that
    connect all that is linked among nodes of different components in cells (cell, node, comp, m)."""
    cells, comps, before = durable(cells.select("cell", "node", F.col("node").alias("comp"))), None, None

    def merged(links: DataFrame) -> DataFrame:
        """Components after more links."""
        return components(links if comps is None else links.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    while True:
        comps = merged(confirm(_stars(cells)))
        cells = _untried(cells.select("cell", "node"), comps)
        # pairs that are still untried, at most
        largest, left = cells.select("cell", "m").distinct().agg(F.max("m"), F.sum(F.col("m").cast("double") * F.col("m"))).first()
        if largest is None:
            return comps
        if largest <= SMALL or before is not None and left > before * PROGRESS:
            return merged(across(cells))
        before = left


def blocked(cells: DataFrame, weight: str, most_nodes: int, most_bytes: int) -> DataFrame:
    """cells (cell, node, m, ...) with i, j, mine: each pair of nodes of a cell meets in one group (cell, i, j), whose two sides
    have about most_nodes nodes and most_bytes bytes; `weight` is a column with a node's bytes."""
    total = cells.groupBy("cell").agg(F.sum(weight).alias("_bytes"))
    cells = cells.join(total, "cell").withColumn("_blocks", F.greatest(F.ceil(F.col("m") / most_nodes), F.ceil(F.col("_bytes") / most_bytes)).cast("int"))
    cells = cells.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    cells = cells.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return cells.withColumns({"i": F.least("mine", "_other"), "j": F.greatest("mine", "_other")}).drop("_bytes", "_blocks", "_other")


class Forest:
    """Union-find over the nodes of a block."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, n: int) -> int:
        root = self.root
        while (up := root.get(n, n)) != n:
            root[n] = up = root.get(up, up)
            n = up
        return n

    def join(self, a: int, b: int) -> None:
        self.root[self.top(a)] = self.top(b)
