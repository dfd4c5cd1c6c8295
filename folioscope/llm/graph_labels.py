"""Connected components by iterated minimum labels with pointer jumping; rounds are cut by reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed

MAX_ROUNDS = 60


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): ``label`` is the smallest id connected with ``id``.

    ``nodes`` has ``id`` (BIGINT, distinct), ``edges`` has ``a`` and ``b``, in any direction and with repeats.
    Ends that are no nodes are ignored. Each round takes the smallest label among neighbours and then the label of
    that label, so long chains shorten geometrically; raises after MAX_ROUNDS rounds rather than give partial labels.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.where("a <> b").distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("label")))
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", "label", F.least("label", F.coalesce("near", "label")).alias("next")
        )
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("jump"))
        step = checkpointed(step.join(jump, "next", "left").select("id", "label", F.least("next", F.coalesce("jump", "next")).alias("next")))
        if step.where(F.col("next") < F.col("label")).limit(1).count() == 0:
            return labels
        labels = step.select("id", F.col("next").alias("label"))
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")
