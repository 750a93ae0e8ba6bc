"""Connected components by distributed union-find: large-star and small-star rounds over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import written


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater to the lesser end, loops left out."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to its least one, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _down(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a long, b long); the root is the least node of its component.

    Each round is written to the shared folder, so lineage does not grow. Rounds end when the
    edges, by number and sums, no longer change: then every edge leads to a root.
    """
    now = written(_down(edges), "edges")
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if sums == seen:
            break
        seen = sums
        now = written(_small_star(_large_star(now)), "edges", now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def across(placed: DataFrame, group: str, hubs: int = 8) -> DataFrame:
    """Pairs (a, b) that are likely links between components, and ``c``, in how many groups they came up: in each group (placed: group, node, root) the members outside
    its largest component, each with a few members of that one. However large a group is, it makes a
    few pairs a member, and the members to choose from are minima, not lists."""
    chosen = [F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in range(hubs)]
    parts = placed.groupBy(group, "root").agg(F.count("*").alias("n"), *chosen)
    whole = F.struct(F.col("root").alias("root"), F.array(*[f"h{k}" for k in range(hubs)]).alias("hubs"))
    main = parts.groupBy(group).agg(F.count("*").alias("k"), F.max_by(whole, F.struct("n", "root")).alias("main")).where("k > 1")
    rest = placed.join(main.select(group, "main"), group).where("root <> main.root")
    pairs = rest.select(F.explode(F.array_distinct("main.hubs")).alias("a"), F.col("node").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
