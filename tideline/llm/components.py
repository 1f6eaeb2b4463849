"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, heavy_join


MOST_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the node's component. edges: a, b of one orderable type.

    Hash-to-min with pointer jumping: in each round a node takes the least root among its neighbours' and then its
    root's root. Minima are combined map-side and a hub's or a large component's label is broadcast, so neither is one
    task's alone; the number of rounds grows with the logarithm of the longest path. Each round is written to the
    shared folder and only counts reach the driver. An error is raised if MOST_ROUNDS do not do.
    """
    scratch = Scratch(edges.sparkSession, "components")
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    roots = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots-0")
    for k in range(1, MOST_ROUNDS + 1):
        near = heavy_join(both, roots.withColumnRenamed("node", "b"), ["b"], scratch).groupBy("a").agg(F.min("root").alias("m"))
        taken = scratch.table(roots.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root")), f"taken-{k}")
        # Hooking: the old root, too, learns of the better one, so that whole trees move and not only their rims.
        hooks = taken.where("root <> was").groupBy("was").agg(F.min("root").alias("h")).withColumnRenamed("was", "node")
        hooked = scratch.table(taken.join(hooks, "node", "left").select("node", "was", F.least("root", F.coalesce("h", "root")).alias("root")), f"hooked-{k}")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = scratch.table(heavy_join(hooked, up, ["root"], scratch, "left").select("node", "was", F.coalesce("above", "root").alias("root")), f"moved-{k}")
        roots = moved.select("node", "root")
        scratch.drop("roots-0" if k == 1 else f"moved-{k - 1}", f"taken-{k}", f"hooked-{k}")
        if moved.where("root <> was").isEmpty():
            scratch.drop("edges")
            return roots
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
