"""Connected components of a link table, by hooking and contraction.

Every round each node of the contracted graph hooks to its smallest neighbour
and the trees are flattened by pointer jumping; links then join roots only. A
round at least halves the nodes that still have links, so the number of rounds
is logarithmic, and links inside a component vanish with it. Links and labels
stay distributed; the loop only learns whether any link is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise


def connect(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b): the smallest node it reaches.

    Self links and repeated links are harmless; null ends are dropped; no links
    give no rows.
    """
    links = links.where("a is not null and b is not null")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.where("a <> b").distinct(), "cc-edges", "none")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels", "none")
    roots = labels
    while True:
        # flatten: follow the parent until it is its own parent
        while True:
            up = roots.select(F.col("node").alias("p"), F.col("label").alias("pp"))
            jumped = materialise(roots.join(up, F.col("label") == F.col("p"), "left").select("node", F.coalesce("pp", "label").alias("label"), (F.coalesce("pp", "label") != F.col("label")).alias("moved")), "cc-jump", "none")
            roots = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if roots is not labels:
            r = roots.select(F.col("node").alias("r"), F.col("label").alias("rl"))
            labels = labels.join(r, F.col("label") == F.col("r"), "left").select("node", F.coalesce("rl", "label").alias("label"))
            labels = materialise(labels, "cc-labels", "none")
        ends = roots.select(F.col("node").alias("n1"), F.col("label").alias("a2"))
        other = roots.select(F.col("node").alias("n2"), F.col("label").alias("b2"))
        edges = materialise(
            edges.join(ends, F.col("a") == F.col("n1")).join(other, F.col("b") == F.col("n2")).where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(),
            "cc-edges",
            "none",
        )
        if edges.isEmpty():
            return labels
        roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
