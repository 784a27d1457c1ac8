"""Connected components of a table of links, by spreading the smallest label and following labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernpath.llm.common import release, stash


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b), two long columns: label is the smallest node reachable. Nulls are left out."""
    links = links.where("a is not null and b is not null and a <> b")
    both = stash(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        # the smallest label next to a node, and then the label of that label
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.select("node", "label").join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = stash(step, "step")
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        # a label is itself a node, so that it has a label
        new = step.join(jump, step["label"] == jump["at"]).select("node", "old", F.least("label", "further").alias("label"))
        new = stash(new, "labels")
        release(step, labels)
        if new.where("label <> old").isEmpty():
            release(both)
            return new.select("node", "label")
        labels = new
