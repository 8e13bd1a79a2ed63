"""Sub-sessions of a stream of events: closed by an idle gap, emitted once, ready for the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.merged_graph import merge_batch
from pathloom.operators.sessions import SUB_KEY


def closed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session_id, start, end, n_events, events): sessions whose gap has passed behind the watermark.

    Events exactly a gap apart stay together, as in the batch split. Events later than the watermark
    are dropped by Spark.
    """
    marked = events.withWatermark("timestamp", late)
    window = F.session_window("timestamp", gap)
    grouped = marked.groupBy("session_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_list(F.struct("timestamp", "sequence", "event_id"))).alias("events"))
    return grouped.select("session_id", "w.start", "w.end", "n_events", "events")


def mine_stream(events: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "30 minutes", late: str = "10 minutes") -> StreamingQuery:
    """Hands each micro-batch of closed sessions to a batch function; the checkpoint makes restarts exact."""
    return closed_sessions(events, gap, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).start()


def merge_stream(events: DataFrame, folder: str, checkpoint: str, late: str = "10 minutes", keep: str = "1 day", keys: list[str] = SUB_KEY) -> StreamingQuery:
    """Merges each micro-batch into the graph in ``folder``; a repeated batch is skipped. Other settings are those of ``merge_batch``."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: merge_batch(folder, df, n, late, keep, keys) and None).trigger(availableNow=True).start()
