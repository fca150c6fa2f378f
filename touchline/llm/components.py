"""Connected components of a graph that no single machine has to hold.

Each round every node points to the neighbour (or itself) with the least hash
of that round, the edges are written between the nodes pointed to, and what is
left of the graph shrinks by a constant share on average, whatever its shape.
Every round's pointers and edges are stored tables; the pointers are composed
backwards at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.stage import stage


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of the component of each of n nodes, for edges u-v in one task."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, root[u], root[v])
        np.minimum.at(new, root[v], root[u])
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the least node reached.

    Edges may repeat and may be loops; nodes with loops alone are left out.
    Edges with a null end are ignored.  No edges give an empty table.
    """
    tidy = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stage(
        edges.filter(F.col("a") != F.col("b")).select(*tidy(F.col("a"), F.col("b"))).distinct(), "edges",
    )
    pointers = []
    while True:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(pointers))).alias("h"), c.alias("x"))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")),
        )
        points = both.groupBy("node").agg(F.min(rank(F.col("other"))).alias("near")).select(
            "node", F.least("near", rank(F.col("node")))["x"].alias("parent"),
        )
        points = stage(points, "pointers")
        pointers.append(points)
        to_a = points.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = points.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = stage(
            left.join(to_a, "a").join(to_b, "b").filter(F.col("pa") != F.col("pb"))
            .select(*tidy(F.col("pa"), F.col("pb"))).distinct(),
            "edges",
        )
        if left.isEmpty():
            break
    roots = pointers[-1].select("node", F.col("parent").alias("root"))
    for points in reversed(pointers[:-1]):
        later = roots.select(F.col("node").alias("parent"), "root")
        roots = points.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    if len(pointers) > 2:
        roots = stage(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")


def settle(classes: DataFrame, hits: DataFrame) -> DataFrame:
    """(cls, class_id, component, component_id, n_links) from classes (cls, rep, copies) and hits (cls, links, root).

    ``links`` are the rows of other classes linked to one of this class, as
    counted by parts; ``root`` is a class of the same component, and
    ``component`` the least of its classes.
    """
    links = hits.groupBy("cls").agg(F.sum("links").alias("links"))
    found = components(hits.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    found = found.join(classes.select("cls", "rep"), "cls")
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = found.join(least, "component").join(links, "cls").select("cls", "component", "component_id", "links")
    return stage(
        classes.join(linked, "cls", "left").select(
            "cls", F.col("rep").alias("class_id"), F.coalesce("component", "cls").alias("component"),
            F.coalesce("component_id", "rep").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "facts",
    )
