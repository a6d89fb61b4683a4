"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge; root is the smallest node it reaches.

    ``edges`` holds bigint columns ``u`` and ``v``; loops and repeats are ignored. Each round hangs
    neighbours below the smallest one they see (every edge keeps its component), and its edges are
    written to the shared folder, so the plan stays short. Rounds grow with the logarithm of the
    longest chain. It ends when a round changes nothing; an even number of equal rows and an equal
    sum of their hashes mean that.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")

    def mark(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        return row["n"], row["s"]

    before = mark(now)
    for k in range(1, max_rounds + 1):
        if not before[0]:
            break
        now = staged(_small_star(_large_star(now)), f"{name}-{k}")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
