"""New response files to warehouse tables as they arrive.

A file stream reads each cached response once; every micro-batch is parsed as the batch readers parse it and upserted
by key, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..warehouse import Warehouse


def response_stream(spark: SparkSession, folder: str, endpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """(game_id, payload) of the endpoint's responses below ``folder``, as a stream."""
    lines = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).text(folder)
    get = F.get_json_object
    return lines.filter(get("value", "$.endpoint") == endpoint).select(get("value", "$.params.game_id").alias("game_id"), get("value", "$.payload").alias("payload"))


def upsert_stream(rows: DataFrame, warehouse: Warehouse, table: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, until_done: bool = True) -> StreamingQuery:
    """Parse and upsert each micro-batch; ``until_done`` stops when all that is there has been read."""

    def store(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(["game_id"])
        if not batch.isEmpty():
            warehouse.upsert(table, parse(batch))

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_done else writer.trigger(processingTime="1 minute")).start()
