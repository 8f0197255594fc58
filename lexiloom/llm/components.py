"""Connected components of an edge list, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id of the edges; root is the smallest id that can be reached.

    Every round gives each id the least label among its neighbours and then the label of that label, so that the
    distance covered doubles.  A round is a written table; only the sum of all labels comes to the driver.
    Null ends are ignored.
    """
    pair = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    both = saved(pair.union(pair.select("v", "u")).distinct(), "edges")
    labels = saved(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.least("root", "near").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("root").alias("far"))
        labels = saved(step.join(jump, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("root")), "labels")
