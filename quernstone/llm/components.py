"""Connected components over a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging


def components(staged: Staging, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of links (a, b); label is the least node of its component.

    Each round, every node moves to the first in a random order among itself and its neighbours;
    links are renamed so, and those within a node are gone. A round keeps about a third of the
    nodes of a path, and two rounds end a star, so rounds grow with the logarithm of the graph.
    The rounds' moves are then followed back, and the least node of each component names it.

    A hub's links are only counted in partial aggregations and met by joins whose skewed keys
    Spark splits; no round gathers a component in one task. Every round's tables are written.
    """
    edges = staged.put(f"{name}-edges-0", links.select("a", "b").where("a <> b").distinct())
    moves: list[DataFrame] = []
    while True:
        k = len(moves)
        order = lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("turn"), x.alias("node"))  # noqa: B023, E731
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("first"))
        up = F.least(F.col("first"), order(F.col("a")))
        moved = staged.put(f"{name}-moves-{k}", first.select(F.col("a").alias("node"), up["node"].alias("up")))
        moves.append(moved)
        of = [moved.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab"]
        renamed = edges.join(of[0], "a").join(of[1], "b").where("a_up <> b_up")
        left = renamed.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct()
        edges = staged.put(f"{name}-edges-{k + 1}", left)
        staged.drop(f"{name}-edges-{k}")
        if edges.isEmpty():
            break
    found = moves[-1].select("node", F.col("up").alias("root"))
    for earlier in reversed(moves[:-1]):
        beyond = found.select(F.col("node").alias("up"), "root")
        found = earlier.join(beyond, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    found = staged.put(f"{name}-roots", found)
    least = found.groupBy("root").agg(F.min("node").alias("label"))
    out = staged.put(name, found.join(least, "root").select("node", "label"))
    staged.drop(f"{name}-roots", f"{name}-edges-{len(moves)}", *[f"{name}-moves-{k}" for k in range(len(moves))])
    return out

