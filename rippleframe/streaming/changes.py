"""Change events as a stream: each micro-batch is one delta over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.operators import changes as C
from rippleframe.operators.graph import reverse_closure
from rippleframe.operators.loops import cut
from rippleframe.plans.impact import impact


def impact_of_batch(events: DataFrame, edges: DataFrame, files: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Impact rows of the change events of one batch."""
    changes = C.exclude_changes(C.relevant_changes(events), list(exclude))
    seeds = C.analysis_paths(changes).join(files.select("path"), "path", "left_semi").select(F.col("path").alias("node"))
    return impact(edges, files, seeds, reverse_closure(edges, seeds))


def stream_impact(events: DataFrame, edges: DataFrame, files: DataFrame, out: str, checkpoint: str, exclude: list[str] = ()):
    """Start a query that appends each batch's impact to `out`, one folder a batch: a batch that is
    run again after a failure replaces its own rows. Edges and files are computed once, at the start."""
    edges, files = cut(edges), cut(files)

    def write(batch: DataFrame, number: int) -> None:
        rows = impact_of_batch(batch, edges, files, exclude)
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
