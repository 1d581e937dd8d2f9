"""Connected components of a graph whose edges are rows.

Labels fall to the least neighbour and then jump to their label's label, so rounds grow with the logarithm of a
component's width. A round is two joins on the vertex; its lineage is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; a folder of its own only where that is unset, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="skein-"))
    return df.checkpoint()


def written(df: DataFrame, by: str) -> DataFrame:
    """Cuts the lineage of a table of which parts are read: Parquet in the shared folder with a directory for each value of ``by``."""
    checkpointed(df.sparkSession.range(0))  # sets the folder where it is unset
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/skein-by-{by}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has, for work that costs more than its input's few files suggest."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: the least node reachable. A self loop makes a node known."""
    both = checkpointed(edges.where("a is not null and b is not null").select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        to = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        new = checkpointed(new.join(to, "new").select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"no convergence in {rounds} rounds")
