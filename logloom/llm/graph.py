"""Connected components of an undirected graph, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.session import stored


def components(links: DataFrame) -> DataFrame:
    """`links`: (a, b), any orderable type. Returns (node, root), one row per node of a link.

    Each round every node points to its smallest neighbour or itself; pointers are followed to
    their ends, the ends become the nodes of the next, at most half as large graph, and rounds go
    on until no link is left. Nulls are ignored. Only counts reach the driver.
    """
    links = stored(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = None
    if links.isEmpty():
        return nodes.withColumn("root", F.col("node"))
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
            .select("node", F.least("node", "b").alias("up")),
            "pointers",
        )
        while True:
            ends = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = stored(
                up.join(ends, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")),
                "pointers",
            )
            up = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        if roots is None:
            roots = up.select("node", F.col("up").alias("root"))
        else:
            ends = up.select(F.col("node").alias("root"), F.col("up").alias("next"))
            roots = stored(roots.join(ends, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        to = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        other = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        links = stored(
            links.join(to, "a").join(other, "b").filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
        if links.isEmpty():
            return nodes.join(roots, "node")
