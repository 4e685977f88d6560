"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.storage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of every node to its least neighbour, the node itself included."""
    if large:
        ends = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    tied = ends.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node that an edge touches; the component is its least node.

    Rows with a null end and self-loops tie nothing, but the node of a self-loop is returned.
    Edges may repeat. The number of rounds grows with the logarithm of the longest chain; the
    rounds' tables are written to the shared folder, and only two sums a round reach the driver.
    """
    pairs = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    pairs = pairs.select(F.col(left).alias("u"), F.col(right).alias("v"))
    given = materialize(pairs.distinct(), "edges")
    links = given.filter("u <> v")
    before = None
    for _ in range(max_rounds):
        links = materialize(_star(links, large=True), "large")
        links = materialize(_star(links, large=False), "small")
        state = links.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    nodes = given.select(F.col("u").alias("node")).unionAll(given.select(F.col("v").alias("node"))).distinct()
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
