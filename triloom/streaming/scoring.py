"""Scoring of targets as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triloom.operators.match import hits_scan

SCHEMA = "repo string, fn_id string, a string, rel string, b string"
#: Folders that a target's triples are kept in, so that a later part of it finds them without a look at all.
BUCKETS = 64


def watch(spark: SparkSession, incoming: str, sig_parts: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score the triples of new files in ``incoming`` against fixed signatures; hits go to ``out``, a folder for each batch.

    A target may arrive in parts: its triples are kept, and each batch scores the targets it touches with all that was kept
    of them. So the last batch that touched a target has its hits, see :func:`current`. A batch that runs again after a failure
    replaces its own folders and reads only earlier ones, so hits are written exactly once.
    """
    stream = spark.readStream.schema(SCHEMA).parquet(incoming)

    def score(batch: DataFrame, number: int) -> None:
        own = batch.where("fn_id is not null").withColumn("bucket", F.pmod(F.xxhash64("fn_id"), F.lit(BUCKETS)).cast("int"))
        own.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/_triples/batch={number}")
        kept = spark.read.option("basePath", f"{out}/_triples").schema(f"{SCHEMA}, bucket int, batch int").parquet(f"{out}/_triples").where(F.col("batch") <= number)
        touched = kept.where(F.col("batch") == number).select("bucket", "fn_id").distinct()
        touched.select("fn_id").write.mode("overwrite").parquet(f"{out}/_targets/batch={number}")
        hits_scan(sig_parts, kept.join(touched, ["bucket", "fn_id"], "left_semi").select(*batch.columns)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The hits of all targets so far: of each target those of the last batch that touched it."""
    last = spark.read.parquet(f"{out}/_targets").groupBy(F.col("fn_id").alias("target_id")).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(out).join(last, ["target_id", "batch"]).drop("batch")
