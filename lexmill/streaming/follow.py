"""Following a stream of document versions into an index.

Each micro-batch becomes one delta segment: rows with a text are added or replace their path, rows with a null text
hide it. The index's own rule, the last record of a path counts, makes a batch that is replayed after a failure
harmless: it adds the same records once more, and nothing visible changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import maintenance as mt
from lexmill.operators import storage as st


def apply_batch(writer: mt.IndexWriter, batch: DataFrame) -> mt.IndexResult | None:
    """One micro-batch of (path, text, mtime_ns); of rows that share a path the one of the latest mtime_ns counts."""
    latest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime_ns"), F.desc("text")))
    rows = batch.withColumn("__n", latest).where("__n = 1").drop("__n")
    gone = F.col("text").isNull()
    rows = rows.select(
        "path", F.when(gone, F.lit(0)).otherwise(F.octet_length("text")).cast("long").alias("file_size"), F.when(gone, F.lit(0)).otherwise(F.col("mtime_ns")).cast("long").alias("mtime_ns"),
        F.when(~gone, F.xxhash64("text")).alias("content_hash"), "text", F.lit(None).cast("string").alias("error"), gone.alias("tombstone"),
    )
    with st.Transaction(writer.folder, create=False) as t:
        writer._ready(t)
        candidate, _, n = writer._delta(t, rows)
        if not n:
            return None
        new, compacted, notes = writer._publish(t, candidate)
        return mt.IndexResult("compacted" if compacted else "published", new.generation, len(new.active), diagnostics=notes)


def follow(writer: mt.IndexWriter, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Starts a query that applies all that is available and ends; run it again for more."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_batch(writer, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
