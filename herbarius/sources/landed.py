"""Landed files: occurrence tables, API responses, ranges; and tables by layer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_json
from ..functions.geo import EDGE, clipped_edges, edges_of, wkt_rings

#: Layers of tables, from what was landed to what is scored.
LAYERS = ("raw", "clean", "preprocessed", "features", "observers", "labeled", "score", "encoded", "transformed")
#: Rows of API responses as they are landed.
RESPONSES = "batch_idx int, chunk_idx int, item_key int, json string"


def occurrences(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A delimited occurrence file with a header; ``columns`` is pushed into the scan, and the
    coordinates come as doubles in a struct ``geom`` (x longitude, y latitude) if they are there."""
    df = spark.read.csv(path, sep=sep, header=True, quote="\0" if sep == "\t" else '"')
    df = df.select(*columns) if columns else df
    if {"decimalLongitude", "decimalLatitude"} <= set(df.columns):
        df = df.withColumn("geom", F.struct(F.col("decimalLongitude").try_cast("double").alias("x"), F.col("decimalLatitude").try_cast("double").alias("y")))
    return df


def single_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The one CSV file of a folder; an error if there are none or several."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").limit(2).collect()
    if len(files) != 1:
        raise ValueError(f"{folder} must hold one CSV file")
    return spark.read.csv(files[0]["path"], header=True)


def responses(spark: SparkSession, path: str) -> DataFrame:
    """API responses landed as JSON lines of item_key and json."""
    return spark.read.schema(RESPONSES).json(path)


def pending(items: DataFrame, key: str, landed: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Keys still to be fetched: different, in order, without those that have landed."""
    keys = items.select(key).filter(F.col(key).isNotNull()).distinct()
    if landed is not None:
        keys = keys.join(landed.select(F.col("item_key").alias(key)), key, "left_anti")
    keys = keys.orderBy(key)
    return keys.limit(limit) if limit else keys


def field_list(fields: dict) -> str:
    """A nested field selection as text: {"a": True, "b": {"c": True}} is ``(a:!t,b:(c:!t))``."""
    return "(" + ",".join(f"{k}:{field_list(v) if isinstance(v, dict) else '!t'}" for k, v in fields.items()) + ")"


def ranges(texts: DataFrame, key: str, wkt: str = "wkt", area: str | None = None) -> DataFrame:
    """Polygon texts as edges and bounding boxes: ``key, edges, minx, miny, maxx, maxy``.

    With an ``area``, a polygon's text of any shape, ranges are clipped to it and those outside are left
    out.  Saved as they are, the boxes let a later scan skip row groups outside a box (:func:`in_box`).
    """
    border = edges_of(wkt_rings(area)) if area else None

    def parse(batches):
        for pdf in batches:
            edges = [edges_of(wkt_rings(t)) for t in pdf[wkt]]
            if border:
                edges = [clipped_edges(e, border) for e in edges]
            pdf["edges"] = [[dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in some] for some in edges]
            yield pdf.loc[[bool(some) for some in edges], [key, "edges"]]

    kind = texts.schema[key].dataType.simpleString()
    edges = texts.select(key, wkt).mapInPandas(parse, f"`{key}` {kind}, edges {EDGE}")
    corner = lambda f, axis: f(F.transform("edges", lambda e: e[axis]))
    return edges.select(key, "edges", corner(F.array_min, "x1").alias("minx"), corner(F.array_min, "y1").alias("miny"), corner(F.array_max, "x1").alias("maxx"), corner(F.array_max, "y1").alias("maxy"))


def in_box(ranges: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Ranges whose box meets another; plain comparisons, which reach the scan."""
    return ranges.filter((F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy))


def export_features(df: DataFrame, path: str, x: str, y: str, columns: list[str]) -> None:
    """Points as lines of GeoJSON features with some columns as properties."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*columns).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.text(path)


def export_sample(df: DataFrame, path: str, rows: int = 100) -> None:
    """The first rows, by the first column, as one CSV file with a header."""
    df.orderBy(df.columns[0]).limit(rows).coalesce(1).write.csv(path, header=True)


def land(df: DataFrame, item_key: str, path: str) -> None:
    """Rows as landed responses: their key, and all of them as JSON text."""
    df.select(F.lit(0).alias("batch_idx"), F.lit(0).alias("chunk_idx"), F.col(item_key).cast("int").alias("item_key"), as_json(df.columns).alias("json")).write.json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local session without one gets a
    temporary folder."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as a table whose size Spark knows."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def loaded(spark: SparkSession, name: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Columns of a table; with a limit the first rows by the first of them, which is no global sort."""
    df = spark.table(name)
    df = df.select(*columns) if columns else df
    return df.orderBy(df.columns[0]).limit(limit) if limit else df


def save(df: DataFrame, name: str, append: bool = False, key: str | None = None, buckets: int = 64) -> None:
    """Write a table ``layer.name``, replacing it or appending to it.

    With a ``key`` its rows are dealt to ``buckets`` by the key and sorted; tables of one key and
    number of buckets are joined and counted by it without another exchange.
    """
    layer = name.partition(".")[0]
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
    writer = df.write.mode("append" if append else "overwrite")
    if key:
        # A bucket's rows come from one task each, or there would be as many files as tasks in each bucket.
        writer = df.repartition(buckets, key).write.mode("append" if append else "overwrite").bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)


def observation(spark: SparkSession, path: str) -> DataFrame:
    """Observations of an API answer: one row per result, the location as numbers."""
    schema = T.StructType.fromDDL("results array<struct<uuid:string,quality_grade:string,uri:string,location:string,num_identification_agreements:int,taxon:struct<id:int,rank:string>,user:struct<id:int>,observed_on_details:struct<date:string,day:int,hour:int,month:int,week:int,year:int>,identifications:array<struct<id:int>>,photos:array<struct<id:int>>>>")
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
    place = F.split("location", ",")
    return rows.withColumns({"lat": F.get(place, F.lit(0)).try_cast("double"), "lon": F.get(place, F.lit(1)).try_cast("double"), "n_photos": F.size("photos"), "n_identifications": F.size("identifications")})
