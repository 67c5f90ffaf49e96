"""Cross-deduplication of a stream against a fitted index.

Each micro-batch is judged against the fitted records alone, as a batch job
would; the greedy rule within one dataset depends on global order and is not
offered on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.index import SemanticIndex


def deduplicate_stream(stream: DataFrame, index: SemanticIndex, path: str, checkpoint: str, order_by: str, threshold: float = 0.9, **trigger) -> StreamingQuery:
    """Write the kept records of every micro-batch to ``path`` (one folder a batch, so a retry overwrites its own)."""

    def judge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            kept = index.deduplicate(batch, threshold, order_by=order_by).selected
            kept.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
