"""Connected components by alternating stars; no component or adjacency list is ever held by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import counted, discard, hint, rows_of


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Lead neighbours of every node to the smallest of them: the larger neighbours, or else the smaller ones and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        found = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return found.where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (the smallest node it is connected with) for every node of ``edges``, two columns of
    longs. Rounds of two grouped minima and joins; the edges of each round are written, so lineage stays short, and those of the round before are removed. The number
    of rounds grows with the logarithm of the nodes; RuntimeError after ``most_rounds``. Null ends, loops and repeated
    edges are ignored; an empty table gives an empty result. Rows and hashes of a round are counted while it is written.
    """
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    state = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now = counted(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges", state)
    for _ in range(most_rounds):
        if not rows_of(now):
            break
        last, now = now, counted(_star(_star(now, True), False), "stars", state)
        discard(last)
        if now._seen == last._seen:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``parts`` (``node``, ``component``) after more ``links`` (``a``, ``b``), both written; ``parts`` is removed if there are any.

    Only the graph of the components that a link joins goes through :func:`connected_components`.
    """
    if not rows_of(links):
        return parts
    ends = links
    for end in ("a", "b"):
        ends = ends.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
    joined = counted(connected_components(ends.select(*(F.coalesce(f"{end}_part", end).alias(end) for end in ("a", "b")))), "merged")
    new = joined.join(parts.select("node"), "node", "left_anti")
    to = hint(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), 24, joined)
    out = counted(parts.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")).union(new), "components")
    discard(parts, joined)
    return out
