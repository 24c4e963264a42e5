"""Incremental scans: metrics of source files that arrive after a first run.  An addition; the
batch stages need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.functions import text as tx
from quarrymill.schemas import INPUTS


def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Source lines of the CSV files of a folder as a stream, each file once."""
    return spark.readStream.schema(INPUTS["in_source"].schema).csv(folder, header=True, escape='"', multiLine=True)


def code_lines(lines: DataFrame) -> DataFrame:
    """Code lines of each unit so far."""
    return lines.where(tx.is_code_line("TEXT")).groupBy("OWNER", "NAME", "TYPE").agg(F.count(F.lit(1)).alias("LOC"))


def keep_up(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the counts of what is there and stops; a later call goes on from the checkpoint."""
    write = lambda df, n: df.write.mode("overwrite").parquet(out)
    return code_lines(lines).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
