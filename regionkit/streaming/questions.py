"""A folder of question files as a stream: each question is answered once, however often it is delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import todo
from ..session import exists
from ..sources import schemas
from ..sources.readers import done_keys


def answer_stream(spark: SparkSession, folder: str, log: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], schema: str = schemas.QUESTION_B) -> StreamingQuery:
    """Start a query that answers new questions of folder and appends the records to the log, then stops when all is read.

    Each micro-batch is an anti join with the log, so a restart after a failure repeats nothing that was written.
    """

    def step(batch: DataFrame, _: int) -> None:
        if exists(spark, log):
            batch = todo(batch, done_keys(spark, log, ["id"]), ["id"])
        answer(batch.dropDuplicates(["id"])).write.mode("append").json(log)

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
