"""Structured Streaming: documents and versions appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import AnalyzerConfig
from ..operators.index import TextIndex


def index_stream(documents: DataFrame, path: str, checkpoint: str, config: AnalyzerConfig = AnalyzerConfig()) -> StreamingQuery:
    """Each micro-batch's postings are appended to a saved index; TextIndex.load reads them
    all, positions of a document that came in parts being united. A batch that is run again
    after a failure writes its own folder anew, so nothing is indexed twice."""

    def append(batch: DataFrame, number: int) -> None:
        made = TextIndex.build(batch, config)
        made.postings().sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        made.universe.write.mode("overwrite").parquet(f"{path}/documents/batch={number}")

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_stream(versions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Versions of a key/value log appended exactly once."""
    return versions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
