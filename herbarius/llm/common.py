"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python works through an Arrow batch in slices of about so many bytes of text.
SLICE_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark alone, so that any path that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master
    is local (tests, a single machine) is a temporary folder made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage", batch_rows: int = 1000, settings: dict[str, str] | None = None, group_rows: int | None = None, key: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage, and what was written outlives any executor.  The shuffle files of
    the run go as soon as it ends; ``batch_rows`` bounds the Arrow batches, less for plans whose
    rows are large; ``settings`` hold for the run too.  All are documented settings of Spark and are put back afterwards.
    ``group_rows`` bounds the rows of a row group, for rows that are lists of megabytes: a writer's size is first looked at after
    100 rows, and who reads the table has a group's rows in memory at once, up to 4096.
    With a ``key`` rows are in buckets of it, as many as the session has shuffle partitions, so that a join on it moves the other side only.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    wanted = {CLEANUP: "true", BATCH_ROWS: str(batch_rows)} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.options(**({"parquet.block.row.count.limit": group_rows} if group_rows else {}))
        if key:
            # Spark knows the buckets of tables only.
            _tables[path] = f"{name}_{uuid.uuid4().hex}"
            buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
            writer.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(_tables[path])
        else:
            writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.table(_tables[path]) if key else spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _there.append(path)
    return out


#: Where tables of this process stand that :func:`stored` wrote and nobody deleted.
_there: list[str] = []
#: Names of those in buckets.
_tables: dict[str, str] = {}


def _delete(spark: SparkSession, name: str) -> None:
    if name in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(name)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if name in _there:
        _there.remove(name)


def discard(df: DataFrame) -> None:
    """Delete what :func:`stored` wrote, when no later plan reads it."""
    _delete(df.sparkSession, df._stored_at)


def stored_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``make`` returns, and delete all other tables that were stored on the way."""
    before = set(_there)
    out = stored(make(), name)
    for path in [x for x in _there if x not in before and x != out._stored_at]:
        _delete(out.sparkSession, path)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores appended until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about SLICE_BYTES of text, one row at least."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.names.index(text))
    lengths = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def by_text(work: Callable[[list, list], dict], ids: str, text: str, schema: pa.Schema):
    """A function for mapInArrow: ``work(ids, texts)`` gives the columns of ``schema``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = work(part.column(ids).to_pylist(), part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in schema for x in (got[f.name],)], schema=schema)

    return run


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: ``node, component`` (the smallest node) of each node with a link, stored.

    Alternates large-star and small-star steps, so that a chain shrinks in a logarithmic
    number of rounds; each round's links are written to the shared folder.  The least
    neighbours are written before they are joined, so that Spark can split a hub's links.
    Self links and repeated links do no harm; nodes must be non-null.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        before = e
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small_m = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(small_m, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.filter("u <> v").distinct(), "links")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (before, e)]
        for x in (before, least, large, small_m):
            discard(x)
        if sums[0] == sums[1]:
            break
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = stored(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own), "components")
    discard(e)
    return out
