"""Groups from links: the smallest key of each connected component, by rounds of joins.

Each round lets every node look at the smallest label among itself and its neighbours, and then at the label
of that label; the number of rounds grows with the logarithm of the longest chain. Nothing is collected, a
node with a third of all links is aggregated before it is shuffled, and each round is written out, so the
plan never grows and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.runtime import stored


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, group) of every node that has a link; group is the smallest node of its component.

    Rows with a null end, loops and repeated links change nothing; no links give no rows.
    """
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = stored(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stored(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("g")).select(F.col("x").alias("node"), "g"), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("node").alias("y"), F.col("g").alias("gy")), "y").groupBy("x").agg(F.min("gy").alias("m")).select(F.col("x").alias("node"), "m")
        # the label of a node also moves to what its neighbours' labels see
        low = labels.join(near, "node").select("node", "g", F.least("g", "m").alias("m"))
        pull = low.groupBy(F.col("g").alias("node")).agg(F.min("m").alias("p"))
        step = stored(low.join(pull, "node", "left").select("node", "g", F.least("m", F.coalesce("p", "m")).alias("m")), "step")
        jump = step.select(F.col("node").alias("m"), F.col("m").alias("j"))
        new = stored(step.join(jump, "m", "left").select("node", F.col("g").alias("old"), F.least("m", F.coalesce("j", "m")).alias("g")), "labels")
        labels = new.select("node", "g")
        if new.where("old <> g").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("g").alias("group"))
