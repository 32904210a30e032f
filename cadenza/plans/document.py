"""The whole result of a song as one nested row."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that documents are dealt into by a hash of their song.
BUCKETS = 64


def song_document(songs: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Songs with one array per child table, in order; empty where a song has no such rows.

    The rows of all children are one table in which each fills its own child's column: one grouping by song and one join, however
    many children there are.
    """
    parts = []
    for name, (rows, order) in children.items():
        columns = [order, *(c for c in rows.columns if c not in ("song_id", order))]
        parts.append(rows.select("song_id", F.struct(*columns).alias(name)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    found = every.groupBy("song_id").agg(*(F.sort_array(F.collect_list(name)).alias(name) for name in children))
    none = {name: F.coalesce(name, F.array().cast(found.schema[name].dataType)) for name in children}
    return songs.join(found, "song_id", "left").withColumns(none)


def write_documents(documents: DataFrame, path: str, schema: StructType | None = None, buckets: int = BUCKETS) -> None:
    """Documents as parquet at a path, dealt into buckets by song, in the given schema (by default their own).

    Only the songs at hand are replaced: of the buckets that they fall into, the other songs are read, kept and written again; other
    buckets aren't touched. A column that the stored documents lack is null there, one that the new ones lack is null in them.
    Songs must not repeat in one call, and one call at a time may write to a path.
    """
    spark = documents.sparkSession
    typed = documents if schema is None else documents.select(*(F.col(f.name).cast(f.dataType) if f.name in documents.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    placed = typed.withColumn("bucket", F.pmod(F.xxhash64("song_id"), F.lit(buckets)).cast("int"))
    stored = read_documents(spark, path)
    if stored is not None:
        # what stays is written aside first: a folder can't be read and replaced in one step
        touched = placed.select("bucket").distinct()
        others = stored.join(F.broadcast(touched), "bucket", "left_semi").join(placed.select("song_id"), "song_id", "left_anti")
        aside = f"{path}.aside"
        placed.unionByName(others, allowMissingColumns=True).write.mode("overwrite").parquet(aside)
        placed = spark.read.parquet(aside)
    placed.repartition("bucket").sortWithinPartitions("song_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored documents with their bucket, in the schema of all that was ever written; None if there are none."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
