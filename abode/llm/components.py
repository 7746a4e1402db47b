"""Connected components of a link table, by min-label hooking with pointer
jumping; every round is two small shuffles and a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm.common import written


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) with the components that ``links`` (a, b) join made
    one; a component's label is its smallest.  Nothing is collected."""
    while True:
        la, lb = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        cross = links.select("a", "b").join(la, "a").join(lb, "b").where("ca <> cb").select("ca", "cb")
        cross = written(cross.union(cross.select("cb", "ca")).distinct().toDF("c", "o"), "cross")
        if cross.isEmpty():
            return labels
        up = written(cross.groupBy("c").agg(F.least("c", F.min("o")).alias("p")), "parents")
        for _ in range(3):  # parents of parents; labels only ever get smaller
            nxt = up.toDF("p", "pp")
            up = up.join(nxt, "p", "left").select("c", F.coalesce("pp", "p").alias("p"))
        labels = written(labels.join(up, labels["comp"] == up["c"], "left")
                         .select("node", F.coalesce("p", "comp").alias("comp")), "labels")
