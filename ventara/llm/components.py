"""Connected components of a link table, by repeated contraction. Nothing is gathered on the driver but a row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventara.llm.base import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of links (a, b); the component is its smallest node. Loops and nulls are left out.

    Each round maps every node to the smallest node of its closed neighbourhood, in rising order of the id in odd rounds (which
    collapses stars round their smallest node at once) and of a fresh hash in even rounds (which shortens chains by a constant
    factor), and goes on with the links between the images. Each round is written to the scratch folder, as is the result.
    """
    ends = links.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    ends = scratch.keep(ends)
    images: DataFrame | None = None
    turn = 0
    while not ends.isEmpty():
        turn += 1
        order = (lambda c: F.struct(F.col(c).alias("v"))) if turn % 2 else (lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), F.col(c)).alias("h"), F.col(c).alias("v")))
        both = ends.select(F.col("a").alias("node"), F.least(order("a"), order("b")).alias("low")).union(ends.select(F.col("b").alias("node"), F.least(order("a"), order("b")).alias("low")))
        step = scratch.keep(both.groupBy("node").agg(F.min("low.v" if turn % 2 else "low").alias("low")).select("node", (F.col("low") if turn % 2 else F.col("low.v")).alias("to")))
        if images is None:
            images = step.select("node", F.col("to").alias("root"))
        else:
            images = scratch.keep(images.join(step.withColumnRenamed("node", "root"), "root", "left").select(images["node"], F.coalesce("to", images["root"]).alias("root")))
        moved = ends.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        ends = scratch.keep(moved.where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
    if images is None:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lowest = images.groupBy("root").agg(F.min("node").alias("component"))
    return scratch.keep(images.join(lowest, "root").select("node", "component"))
