"""Appending a stream of files to a table without repeats.

The engine has no event-time operators; what it needs of streaming is to take new files as they come and to go on after a
loss. A checkpoint names the files taken; a batch written twice is dropped by its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strataform.sources.sinks import pending


def append_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Take all files of a folder not taken before, append the rows whose keys target doesn't have, and stop."""
    def write(batch: DataFrame, _: int) -> None:
        pending(batch.dropDuplicates(keys), target, keys).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
