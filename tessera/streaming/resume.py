"""Answers that arrive as a stream, each id being written once."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends the rows whose key the table at `path` hasn't yet, as far as the source goes now.

    A batch that is run again after a failure finds what it had written and leaves it out. Of rows with the same key in one batch any
    one is taken; a null key is never written.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = batch.where(batch[key].isNotNull()).dropDuplicates([key])
        try:
            there = batch.sparkSession.read.parquet(path).select(key)
            new = new.join(there, key, "left_anti")
        except AnalysisException:  # nothing has been written yet
            pass
        new.select(*batch.columns).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
