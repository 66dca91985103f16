"""Connected components of large graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.tables import dropped, stored


def components(members: DataFrame) -> DataFrame:
    """``(node, label)`` of ``members`` (node, hub): nodes that share hubs, directly or not, get one label.

    The label is the smallest node of the component.  Each round a hub takes the smallest label of
    its nodes and a node the smallest of its hubs, until none changes; a hub of any size is one
    partial aggregate.  Nodes are longs without nulls; nothing but a count reaches the driver.
    """
    labels = members.groupBy("node").agg(F.min("node").alias("label"))
    before = None
    while True:
        lowest = members.join(labels, "node").groupBy("hub").agg(F.min("label").alias("label"))
        offered = members.join(lowest, "hub").groupBy("node").agg(F.min("label").alias("offer"))
        after = stored(
            labels.join(offered, "node").select(
                "node", F.least("label", "offer").alias("label"), (F.col("offer") < F.col("label")).alias("moved")
            ),
            "labels",
        )
        labels = after.select("node", "label")
        if before is not None:
            dropped(before)
        before = after
        if not after.where("moved").count():
            return labels
