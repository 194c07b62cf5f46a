"""The vector table: records, upserts, batches and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.staging import written

TEXT_CHARS, CHAPTER_CHARS, BATCH_ROWS = 8_000, 200, 50
PASSAGE, QUERY = "passage: ", "query: "


def vector_records(chunks: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """``id, [values,] metadata`` of chunks; vectors meet their chunk by id.

    The metadata has shortened texts and chapters; an empty chapter is missing.
    """
    metadata = F.struct(
        F.substring("text", 1, TEXT_CHARS).alias("text"), "source_file", "work_title", "chunk_index", "total_chunks",
        F.substring(F.nullif(F.col("chapter"), F.lit("")), 1, CHAPTER_CHARS).alias("chapter"), "start_char", "end_char",
    )
    records = chunks.select("id", metadata.alias("metadata"))
    return records if embeddings is None else embeddings.select("id", "values").join(records, "id")


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Each key once, in its latest version; incoming rows win over equal versions. Idempotent."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``rows`` with their place in the order, from 1 on, without ordering all rows in one task.

    Rows are range-partitioned by the order; the partitions' sizes (one number each) give the place of each partition's
    first row.
    """
    placed = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    first, entries = 0, []
    for part in sorted(sizes):
        entries += [F.lit(part), F.lit(first).cast("long")]
        first += sizes[part]
    offset = F.create_map(*entries)[F.col("_part")] if entries else F.lit(0).cast("long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(name, offset + within).drop("_part")


def numbered_batches(rows: DataFrame, key: str = "id", size: int = BATCH_ROWS) -> DataFrame:
    """``rows`` with ``batch``, 1 for the first ``size`` rows by key and so on."""
    place = numbered(rows, F.asc(key), name="_place")
    return place.withColumn("batch", (F.floor((F.col("_place") - 1) / size) + 1).cast("int")).drop("_place")


def batch_sizes(batches: DataFrame) -> DataFrame:
    return batches.groupBy("batch").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def index_statistics(vectors: DataFrame, values: str = "values", key: str = "id") -> DataFrame:
    """How many vectors of each length the table has, each key once a length; null vectors as length -1."""
    size = F.when(F.col(values).isNotNull(), F.size(values)).otherwise(-1)
    once = vectors.select(key, size.alias("dimension")).distinct()
    return once.groupBy("dimension").agg(F.count("*").alias("vectors"))
