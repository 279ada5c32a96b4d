"""Files that land one after the other, taken in once each, and each key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def landing_stream(spark: SparkSession, folder: str, schema: T.StructType | str, keys: list[str], time: str, delay: str = "1 hour", format: str = "json", per_batch: int | None = None, **options) -> DataFrame:
    """Rows of files that land in a folder, each key once within the watermark: later ones of a key that come
    no more than ``delay`` after it, by ``time``, go at once and need no look at the table."""
    reader = spark.readStream.schema(schema).format(format).options(**options)
    rows = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def keep_once(stream: DataFrame, target: str, checkpoint: str, keys: list[str], then: Callable[[DataFrame, int], None] | None = None) -> None:
    """Take in all that has landed, and stop; the next call goes on where this one ended.

    Which files were read is in ``checkpoint``.  A batch goes to a folder of its own in ``target``, which is
    written anew if the batch is repeated after a stop, and leaves out keys that other batches have,
    however long ago, so each key is there once.  ``then`` gets each batch as it was kept.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        rows = batch.dropDuplicates(keys)
        if there:
            schema = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
            before = spark.read.schema(schema).parquet(target).filter(F.col("batch") != number)
            rows = rows.join(before.select(*keys), keys, "left_anti").select(batch.columns)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if then:
            then(spark.read.schema(batch.schema).parquet(f"{target}/batch={number}"), number)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def kept(spark: SparkSession, target: str, schema: T.StructType | str) -> DataFrame:
    """What has been taken in so far."""
    return spark.read.schema(schema).parquet(target)
