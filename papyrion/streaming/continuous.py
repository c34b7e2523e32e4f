"""Running a dialect SELECT continuously.

A streaming frame is registered like any table; filters, projections, joins with static tables and
grouping then lower to the same plan, which Spark keeps up to date. Grouping over time windows and
late data use Spark's own `window` and `withWatermark` on the frame before it is registered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from papyrion.dialect.lexer import DialectError
from papyrion.engine import Engine
from papyrion.stable import checkpoint_folder


def files(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "parquet", at_once: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder, `at_once` new files per batch at most."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).load(folder)


def start(engine: Engine, query: str, sink: str, target: str, mode: str = "append", name: str | None = None, progress: str | None = None) -> StreamingQuery:
    """Starts a SELECT over at least one streaming table.

    `sink` is a file format (with `target` a folder) or `memory` (with `target` a table's name). `progress`
    is the folder of the stream's checkpoints; by default one below the session's shared folder, named
    after the query, so that a restart goes on where it stopped.
    """
    frame = engine.sql(query)
    if not frame.isStreaming:
        raise DialectError("no table of the query is a stream")
    name = name or target.strip("/").replace("/", "_").replace(":", "_")
    writer = frame.writeStream.format(sink).outputMode(mode).option("checkpointLocation", progress or f"{checkpoint_folder(engine.spark)}/streams/{name}")
    if sink == "memory":
        return writer.queryName(target).start()
    return writer.queryName(name).start(target)
