"""Connected components of a graph of any size, by rounds of contraction.

In a round each node joins the neighbour (or itself) that comes first in an order drawn anew
by a seeded hash; what is joined becomes one node. A constant share of the nodes goes in each
round. Every round is written to the shared folder, and nothing is gathered on the driver.
Sums per node are combined before they are shuffled, and what is left are joins on a node,
which adaptive execution splits where one node has many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import forget, saved


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b``; nodes of a component share a root.

    Links of a node to itself and repeated links do no harm; nulls are not nodes.
    """
    links = saved(
        edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "component-links"
    )
    steps = []
    while not links.isEmpty():
        seed = len(steps)
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        drawn = lambda name, seed=seed: F.struct(
            F.xxhash64(F.lit(seed), F.col(name)).alias("order"), F.col(name).alias("to")
        )
        step = ends.groupBy("node").agg(F.min(drawn("other")).alias("first"))
        step = saved(
            step.select("node", F.least("first", drawn("node"))["to"].alias("to")),
            "component-step",
        )
        steps.append(step)
        to = lambda name, step=step: step.select(
            F.col("node").alias(name), F.col("to").alias(f"to_{name}")
        )
        before = links
        links = saved(
            links.join(to("a"), "a")
            .join(to("b"), "b")
            .where(F.col("to_a") != F.col("to_b"))
            .select(
                F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
            )
            .distinct(),
            "component-links",
        )
        forget(before)
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), "to")
        before = result
        result = saved(
            result.join(onward, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "component-roots",
        )
        forget(before, step)
    return result
