"""Corrections as a stream: a fold into the pattern state, and windowed counts.

The state is Spark's own: one stateful operator leaves out logs sent before by their ids, another keeps the value and the
count of every pattern. A micro-batch reads and writes only the keys it touches and gives their new
versions, under its number, so that a batch that is run again after a failure gives the same; the latest version of each key is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from daram.plans.mutations import corrections
from daram.session import new_folder

KEYS = ["insu_cd", "field_name"]


def fold(rows: DataFrame) -> DataFrame:
    """Corrections to the value of the greatest log id per pattern, and the number of corrections; streaming or not."""
    return corrections(rows).groupBy(*KEYS).agg(F.max_by("value", "log_id").alias("pattern_value"), F.max("log_id").alias("last_log_id"), F.count(F.lit(1)).alias("n"))


def scored(state: DataFrame) -> DataFrame:
    return state.select(*KEYS, "pattern_value", F.least(80 + (F.col("n") - 1) * 10, F.lit(100)).cast("int").alias("confidence_score"), (F.col("n") - 1).alias("apply_count"))


def stream_of(spark: SparkSession, source: str, files_per_batch: int = 4) -> DataFrame:
    """The parquet files of a folder, or one file, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # a stream reads folders: the one file of its folder
        reader, source = reader.option("pathGlobFilter", path.getName()), str(path.getParent())
    return reader.parquet(source)


def latest_versions(versions: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a streaming aggregation over all there is and gives the last version of every key; null keys are keys."""
    spark, kept = versions.sparkSession, versions.schema

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/versions/epoch={epoch}")

    versions.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], kept)
    every = spark.read.schema(StructType([*kept, StructField("epoch", LongType())])).parquet(f"{folder}/versions")
    rest = [c for c in kept.names if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("v")).select(*keys, *(F.col("v")[c].alias(c) for c in rest))


def learn(spark: SparkSession, source: str, folder: str, files_per_batch: int = 4) -> DataFrame:
    """The pattern state after all files there are; logs that were sent before are left out by their ids."""
    return latest_versions(fold(stream_of(spark, source, files_per_batch).dropDuplicates(["log_id"])), KEYS, folder)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """Corrections per window of event time and code; later rows than the watermark allows are left out."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", width), "insu_cd").agg(F.count(F.lit(1)).alias("n"))


def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """The whole correction log as a stream; equal to the fold of a batch."""
    return scored(learn(spark, f"{d}/correction_log.parquet", new_folder(spark)))


def running_counters(spark: SparkSession, d: str) -> DataFrame:
    """Attempts and successes per method, counted up as records come in."""
    rows = stream_of(spark, f"{d}/parse_result.parquet")
    counted = rows.groupBy("method").agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(F.col("success"), 1)).alias("successes"), F.count(F.when(~F.coalesce("success", F.lit(False)), 1)).alias("failures"))
    return latest_versions(counted, ["method"], new_folder(spark))
