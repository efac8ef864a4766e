"""Connected components on DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _joined(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    return join_counted(edges, least, ["u"], "n", total, ["v"]).drop("n")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: longs); the label is the least node of the component.

    Each round joins edges to the least neighbour of their node, both aggregated before they are shuffled, and
    is written to the shared folder. The edges of a hub are spread over all tasks. Rounds grow with the logarithm of
    the longest path; if they don't suffice there is an error. A node without edges isn't listed; loops and repeated
    edges do no harm; edges without nodes give no rows.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, total = mark, 2 * mark[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined(both, _least(both), total).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = materialize(large, "edges")  # it is read three times, and so would be all before it
        least = _least(large)
        small = _joined(large, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
