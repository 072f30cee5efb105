"""Connected components of a large graph by rounds of contraction.

In a round every node hooks onto the neighbour (or itself) of the least salted hash, chains of
hooks are shortened by joining the hooks to themselves, and the edges are renamed to the hooks'
ends; edges within one node go. Hash order makes long chains unlikely whatever the ids are, and a
hook that was not followed to its end only leaves work for the next round. Each round is written
to the shared scratch folder, so lineage stays short, and what a round no longer needs is removed.
Nothing but row counts reaches the driver. Edges with a null node join nothing and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import drop, stash


def _ends(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    left = hooks.select(F.col("node").alias("a"), F.col("root").alias("x"))
    right = hooks.select(F.col("node").alias("b"), F.col("root").alias("y"))
    moved = edges.join(left, "a").join(right, "b").where("x <> y")
    return moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, jumps: int = 3) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, both long). ``root`` is one node of
    the component, the same for all of its nodes. Loops and repeated edges are allowed; no edges
    give no rows."""
    rest = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    salt = 0
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(key("b")).alias("best"))
        hooks = best.select("node", F.least(F.struct(F.xxhash64(F.lit(salt), "node").alias("h"), F.col("node").alias("n")), "best")["n"].alias("root"))
        spent = [rest]
        for _ in range(jumps):
            hooks = stash(hooks, "hooks")
            spent.append(hooks)
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hooks = hooks.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        hooks = stash(hooks, "hooks")
        rest = stash(_ends(rest, hooks), "edges")
        if found is None:
            found = hooks
        else:
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            spent += [found, hooks]
            found = stash(found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        drop(*spent)
        salt += 1
    return found if found is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
