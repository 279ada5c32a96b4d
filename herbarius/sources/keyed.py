"""Tables that are updated by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .landed import checkpointed

#: The column, and so the folders, that a table's rows are dealt to.
BUCKET = "bucket"


class KeyedTable:
    """Parquet in folders by a hash of the key, one row for each key.

    An update rewrites the folders of the keys that it brings and no other; it may be
    repeated, as it leaves the same rows.  The number of folders is the table's own: all
    who write it have to give the same.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path).drop(BUCKET)

    def _write(self, rows: DataFrame) -> None:
        # Spark splits what is large of a folder, so a hot one is no single task's work.
        rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def upsert(self, changes: DataFrame, newest: str | None = None, delete: str | None = None) -> None:
        """Put rows in place of those of the same key, and new ones beside them.

        Of several changes of one key the one with the greatest ``newest`` counts (without it, keys
        must differ, or one of them is taken by the greatest row); rows whose ``delete`` is true take
        their key out.  Columns that the table lacks are null in its old rows, columns that
        the changes lack keep the old row's value.  Rows with a null in the key are left out.
        """
        order = [F.col(newest)] if newest else []
        rest = [c for c in changes.columns if c not in self.keys]
        one = changes.dropna(subset=self.keys).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *(F.col(c) for c in rest))).alias("__new"))
        one = checkpointed(self._dealt(one))
        gone = F.coalesce(F.col(f"__new.{delete}"), F.lit(False)) if delete else F.lit(False)
        keep = [c for c in rest if c != delete]
        if not self.exists():
            self._write(one.filter(~gone).select(*self.keys, *(F.col(f"__new.{c}").alias(c) for c in keep), BUCKET))
            return
        touched = [r[0] for r in one.select(BUCKET).distinct().collect()]  # at most ``buckets``
        old = self.spark.read.option("mergeSchema", True).parquet(self.path).filter(F.col(BUCKET).isin(touched))
        has = [c for c in old.columns if c not in (*self.keys, BUCKET)]
        both = old.withColumn("__was", F.lit(True)).join(one.withColumn("__is", F.lit(True)), [*self.keys, BUCKET], "full")
        value = lambda c: F.when(F.col("__is"), F.col(f"__new.{c}")).otherwise(F.col(c) if c in has else F.lit(None)) if c in keep else F.col(c)
        rows = both.filter(~F.coalesce(gone, F.lit(False))).select(*self.keys, *(value(c).alias(c) for c in [*has, *(c for c in keep if c not in has)]), BUCKET)
        # Spark doesn't overwrite what it reads, so the new folders stand in the shared folder first.
        rows = checkpointed(rows)
        self._write(rows)
        emptied = set(touched) - {r[0] for r in rows.select(BUCKET).distinct().collect()}
        for bucket in emptied:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
