"""Chains of parents to their end by pointer doubling: as many rounds as the longest chain has binary digits, however long it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.shared import written


def _jump(rows: DataFrame, *carried: F.Column) -> DataFrame:
    """``rows`` (id, up, ...) with up replaced by up's up; ``carried``: further columns, from the row (r) and the row that up names (p).

    Merged: ids compress so well that the table looks small enough to be sent to all tasks, through the driver, in each round.
    """
    r, p = rows.alias("r"), rows.hint("merge").alias("p")
    return r.join(p, F.col("r.up") == F.col("p.id"), "left").select(F.col("r.id").alias("id"), F.col("p.up").alias("up"), *carried)


def _loops(nodes: DataFrame, n: int) -> DataFrame:
    """(id, loop) of the nodes that stand on a loop of parents; loop: the smallest id on it."""
    rows = written(nodes.select("id", "up"), "up")
    for _ in range(max(1, n).bit_length()):
        if not rows.filter("up IS NOT NULL").limit(1).count():
            return rows.select("id", F.col("id").alias("loop")).limit(0)
        rows = written(_jump(rows), "up")
    # After n steps or more a pointer that is left points into a loop, and every node of a loop is pointed at.
    on = rows.filter("up IS NOT NULL").select(F.col("up").alias("id")).distinct()
    if not on.limit(1).count():
        return rows.select("id", F.col("id").alias("loop")).limit(0)
    least = written(nodes.join(on.hint("merge"), "id", "left_semi").select("id", "up", F.col("id").alias("loop")), "loop")
    for _ in range(max(1, n).bit_length()):
        least = written(_jump(least, F.least("r.loop", "p.loop").alias("loop")), "loop")
    return least.select("id", "loop")


def ancestor_paths(nodes: DataFrame) -> DataFrame:
    """id and path, the labels from the end of its chain of parents down to itself, of each node (id, parent_id, label); ids are distinct and not null.

    A chain ends at a node without a parent, with one that isn't there, or where it would come to a node that it has. Nothing is cut, whatever the length.
    """
    known = nodes.select("id", "parent_id", "label")
    rows = written(known.join(known.select(F.col("id").alias("up")).hint("merge"), F.col("parent_id") == F.col("up"), "left").select("id", "up", "label"), "nodes")
    loops = written(_loops(rows, rows.count()), "loops")
    # Loops are cut at their smallest node; a chain from outside ends above its first node of a loop.
    on = loops.withColumnRenamed("id", "i").hint("merge")
    cut = rows.join(on, F.col("id") == F.col("i"), "left").select("id", F.when(F.coalesce(F.col("loop") == F.col("id"), F.lit(False)), None).otherwise(F.col("up")).alias("up"), "label", "loop")
    into = cut.join(on.select(F.col("i"), F.lit(True).alias("into")).hint("merge"), F.col("up") == F.col("i"), "left")
    enters = F.coalesce(F.col("into"), F.lit(False)) & F.col("loop").isNull()
    paths = written(into.select("id", F.when(enters, None).otherwise(F.col("up")).alias("up"), F.array("label").alias("path"), F.when(enters, F.col("up")).alias("entry"), F.when(F.col("loop").isNotNull(), F.col("loop")).alias("loop")), "paths")
    while paths.filter("up IS NOT NULL").limit(1).count():
        path = F.when(F.col("p.id").isNotNull(), F.concat("p.path", "r.path")).otherwise(F.col("r.path")).alias("path")
        paths = written(_jump(paths, path, F.coalesce("r.entry", "p.entry").alias("entry"), F.col("r.loop").alias("loop")), "paths")
    # On a loop cut open, the node with the longest path sees it all; another node's chain is that list turned.
    whole = paths.filter("loop IS NOT NULL").groupBy("loop").agg(F.max_by("path", F.size("path")).alias("whole"))
    turned = paths.filter("loop IS NOT NULL").join(whole.hint("merge"), "loop").select("id", F.concat(F.slice("whole", F.size("path") + 1, F.size("whole")), F.slice("whole", F.lit(1), F.size("path"))).alias("above"))
    turned = written(turned, "loop-paths")
    out = paths.filter("loop IS NULL").join(turned.withColumnRenamed("id", "entry").hint("merge"), "entry", "left").select("id", F.when(F.col("above").isNotNull(), F.concat("above", "path")).otherwise(F.col("path")).alias("path"))
    return out.unionByName(turned.withColumnRenamed("above", "path"))
