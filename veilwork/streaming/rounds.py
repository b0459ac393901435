"""Rounds as a stream: candidate files that arrive are voted on in micro-batches.

Each micro-batch is one round, written by its number with ``append_round``; a batch that is retried
after a failure replaces its own round, so the sink is exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregates as a
from ..operators import joins as j
from ..sources.readers import append_round


def vote_stream(arriving: DataFrame, private: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that writes (cand_id, votes, mean_dist, round) for each micro-batch of candidates."""

    def one_round(cand: DataFrame, no: int) -> None:
        cand = cand.select("id", "label", "embedding")
        if not cand.isEmpty():
            append_round(a.vote_histogram(j.nearest(private, cand), cand), path, no)

    writer = arriving.writeStream.foreachBatch(one_round).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
