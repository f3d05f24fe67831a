"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.shared import written


def components(links: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex that each vertex of ``links`` (a, b) reaches, by rounds of the smallest label among neighbours, then of that label's own."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        lower = written(labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("new")), "labels")
        if not lower.filter("new < old").limit(1).count():
            return labels
        jump = lower.select(F.col("v").alias("new"), F.col("new").alias("next"))
        labels = written(lower.join(jump, "new", "left").select("v", F.least("new", "next").alias("component")), "labels")
