"""Images that arrive in a folder, analysed as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.plans.engine import AnalysisConfig, analyze
from quarry.sources.dex import GLOB
from quarry.tables import DexTables

_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def watch(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, config: AnalysisConfig = AnalysisConfig(), per_batch: int = 1000) -> StreamingQuery:  # noqa: B008
    """Starts a query that gives sink(findings, batch number) the findings of new files, each file once."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", per_batch).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        tables = DexTables.from_column(batch)
        try:
            sink(analyze(tables, config).findings, number)
        finally:
            tables.release()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
