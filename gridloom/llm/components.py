"""Connected components of a link table by alternating star operations, on DataFrames.

Each round points every node at the smallest node in reach: first larger neighbours to the smallest one (large star), then
smaller neighbours likewise (small star). The smallest neighbour of a node is a pre-aggregated minimum, and goes back to the
links by a join that Spark can split, so that a node with very many links is no single task's work. Every round's links are
a written table. The rounds needed grow with the logarithm of a component's width, not with its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (a > b): large joins the larger neighbours, small the smaller ones, to the least."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: of every node in a link (a, b), the smallest node it reaches. Nodes without links aren't in the result.

    Links may repeat and stand in either direction. A link with a null end is left out, as it names no node.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.keep(ends.filter(F.col("a") != F.col("b")).distinct(), "links0")
    turn, last = 0, None
    while True:
        # a link table that a round leaves as it is consists of stars
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if mark == last or mark[0] == 0:
            break
        last, turn = mark, turn + 1
        now = scratch.keep(_star(_star(now, large=True), large=False), f"links{turn}")
        scratch.drop(f"links{turn - 1}")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
