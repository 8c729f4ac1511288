"""Search of arriving queries against a static data base, batch by batch; no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqweave.plans.search import SearchConfig, search


def stream_search(queries: DataFrame, targets: DataFrame, path: str, checkpoint: str, cfg: SearchConfig | None = None) -> StreamingQuery:
    """Write HSPs of each micro-batch of a query stream as Parquet. A batch that runs again replaces its own rows."""

    def each(batch: DataFrame, number: int) -> None:
        search(batch, targets, cfg).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
