"""Connected components of a link table, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import work


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is the component's smallest node.

    Every round lets each node, and the root it points at, take the smallest label beyond any of its
    links, then replaces labels by the labels of their labels, so distances halve. Minima are
    combined before the shuffle, so a node with very many links needs no task of its own. Ends when
    a round changes nothing.
    """
    both = work.store(
        links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(),
        "links",
    )
    labels = work.store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("root").alias("far"))
        own = labels.select(F.col("node").alias("a"), F.col("root").alias("near"))
        reach = both.join(seen, "b").groupBy("a").agg(F.min("far").alias("far"))
        offers = reach.join(own, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("node"), F.least("near", "far").alias("root")), F.struct(F.col("near").alias("node"), F.least("near", "far").alias("root")))).alias("o")
        ).select("o.*")
        hooked = work.store(offers.groupBy("node").agg(F.min("root").alias("root")), "hooked")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = work.store(hooked.join(jump, "root").select("node", F.col("next").alias("root")), "labels")
        changed = new.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        labels = new
        if not changed:
            return labels
