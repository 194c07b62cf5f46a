"""Chunks as JSON and Parquet, and the vector table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = (
    "id string, text string, source_file string, work_title string, chapter string, chunk_index int, total_chunks int, token_count int, "
    "char_count int, start_char int, end_char int, prev_chunk_id string, next_chunk_id string, concepts array<string>"
)
VECTOR = (
    "id string, values array<float>, metadata struct<text:string, source_file:string, work_title:string, chunk_index:int, total_chunks:int, "
    "chapter:string, start_char:int, end_char:int>"
)


def read_chunks(spark: SparkSession, path: str, embedding_text: bool = False) -> DataFrame:
    """Chunks from JSON by the fixed schema; nothing is inferred. An array a file or an object a line."""
    schema = CHUNK + (", text_for_embedding string" if embedding_text else "")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_chunks(chunks: DataFrame, path: str, embedding_text: bool = False) -> None:
    """Files by source file, or with the text that is embedded."""
    if embedding_text:
        chunks.withColumn("text_for_embedding", F.concat(F.lit("passage: "), "text")).write.mode("overwrite").json(path)
    else:
        chunks.write.mode("overwrite").partitionBy("source_file").json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector table; one that does not exist yet is empty."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    return spark.read.schema(VECTOR + ", version timestamp").parquet(path) if there else spark.createDataFrame([], VECTOR + ", version timestamp")


def ensure_index(spark: SparkSession, path: str, dim: int, metric: str = "cosine") -> None:
    """Makes a vector table's folder where there is none, with its vectors' length and metric; one that has others is an error."""
    wanted = {"dim": dim, "metric": metric}
    fs = spark._jvm.org.apache.hadoop.fs
    note = fs.Path(f"{path.rstrip('/')}/_index.json")
    files = note.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(note):
        # a hidden file, which readers of the table pass over
        stream = files.open(note)
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if found != wanted:
            raise ValueError(f"the table at {path} has {found}, not {wanted}")
        return
    out = files.create(note, False)
    out.write(bytearray(json.dumps(wanted).encode()))
    out.close()


def of_length(vectors: DataFrame, dim: int, values: str = "values") -> DataFrame:
    """The same rows; one whose vector has another length ends the job with an error, where it is read."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector of another length than {dim}: "), F.coalesce(F.col("id").cast("string"), F.lit("no id"))))
    return vectors.withColumn(values, F.when(F.size(values) == dim, F.col(values)).otherwise(wrong.cast(vectors.schema[values].dataType)))
