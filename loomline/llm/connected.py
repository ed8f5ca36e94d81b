"""Connected components by joins: labels spread along links and jump to the label's own label, until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) of every node of ``links`` (a long, b long).

    Links go both ways; repeats and links of a node with itself do no harm; rows with a null are left out. Messages are
    combined before the shuffle, so a node with very many links costs no task more than the others. Each round is
    written to the shared folder; nothing but a count comes to the driver.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    both = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    # Two links for each, as messages go both ways.
    out = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(out.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        sent = out.join(labels, out["a"] == labels["node"]).select(F.col("b").alias("node"), "root")
        near = labels.union(sent).groupBy("node").agg(F.min("root").alias("root"))
        # The label's own label: smaller or the same, and in the same component.
        over = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = near.join(over, "root", "left").select("node", F.least("root", "top").alias("root"))
        fresh = written(jumped, "labels")
        changed = fresh.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        remove(labels)
        labels = fresh
        if not changed:
            break
    else:
        raise RuntimeError("labels still change")
    return labels
