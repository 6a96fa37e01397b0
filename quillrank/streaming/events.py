"""Streams: windowed counts of events with late data, and record checks on arriving files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.functions.tables import shared_folder
from quillrank.operators import consistency


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of its files: those of the folder ``path``, or the one file of that name.

    A stream has to be of a folder, so a single file is picked by name from the one it is in. The filter sees only
    names of files, never that of a table that is a folder of parts.
    """
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).isDirectory(at):
        return stream.parquet(path)
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", name).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; rows later than ``late`` behind the newest are dropped.

    Works on a stream and on a table alike.
    """
    timed = events.withColumn("_t", F.col("ts").cast(T.TimestampType()))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    counted = timed.groupBy(F.window("_t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def checked_records(records: DataFrame) -> DataFrame:
    """Findings of each arriving record: stateless, the same on a stream and on a table."""
    return records.select("record_id", consistency.findings().alias("findings")).withColumn("is_implausible", consistency.is_implausible(F.col("findings")))


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is into a table in the shared folder and read it.

    ``complete``: each batch replaces the result; ``append``: each batch has a folder of its own, which a batch
    that is run again after a failure replaces, so rows come once.
    """
    spark, kept = df.sparkSession, f"{shared_folder(df.sparkSession)}/streams/{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{kept}/rows/batch={0 if mode == 'complete' else number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{kept}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{kept}/rows/batch=*")
