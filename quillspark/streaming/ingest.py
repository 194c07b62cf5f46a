"""Texts that arrive in a folder, cleaned, cut and kept in a table as they come."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.ingest import texts_to_chunks

#: A text's chunks lie in the bucket of its name; a micro-batch writes only the buckets of its texts anew.
BUCKETS = 256


def text_stream(spark: SparkSession, folder: str, files_a_batch: int = 1_000) -> DataFrame:
    """``source_file, text, arrived`` of Parquet files in a folder."""
    schema = "source_file string, text string, arrived timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


class ChunkTable:
    """Chunks by buckets, each in its newest version; which that is a small file says for every micro-batch.

    A batch that is run again writes the same versions again, so the table comes out the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._files = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._jvm.Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def versions(self, below: int | None = None) -> dict[int, int]:
        """The version of each bucket after the newest batch (older than ``below``)."""
        done = sorted(int(n) for n in self._names("_state") if n.isdigit() and (below is None or int(n) < below))
        if not done:
            return {}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/_state/{done[-1]:020d}").first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, versions: dict[int, int]) -> DataFrame | None:
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.parquet(*folders) if folders else None

    def write(self, rows: DataFrame, buckets: list[int], number: int) -> None:
        """``rows`` of ``buckets`` as their version ``number``; what neither this nor the last batch names goes."""
        before = self.versions(number)
        folder = f"{self.path}/data/version={number}"
        self._files.delete(self._jvm.Path(folder), True)
        rows.write.partitionBy("bucket").parquet(folder)
        made = {int(n.split("=")[1]) for n in self._names(f"data/version={number}") if n.startswith("bucket=")}
        after = {b: v for b, v in before.items() if b not in buckets} | {b: number for b in made}
        out = self._files.create(self._jvm.Path(f"{self.path}/_state/_{number}"), True)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        target = self._jvm.Path(f"{self.path}/_state/{number:020d}")
        self._files.delete(target, False)
        self._files.rename(self._jvm.Path(f"{self.path}/_state/_{number}"), target)
        held = set(before.items()) | set(after.items())
        for name in self._names("data"):
            for part in self._names(f"data/{name}"):
                if part.startswith("bucket=") and (int(part.split("=")[1]), int(name.split("=")[1])) not in held:
                    self._files.delete(self._jvm.Path(f"{self.path}/data/{name}/{part}"), True)


def chunk_stream(texts: DataFrame, table: str, checkpoint: str, lexicon: list[tuple[int, str, str]] | None = None) -> StreamingQuery:
    """Keeps the chunks of each text as it last arrived.

    Cleaning and cutting need one document only, so they hold no state.  A text that comes again replaces all its chunks,
    unless a later one is held already.  A batch reads and writes the buckets of its texts, not the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = ChunkTable(spark, table)
        bucket = F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int")
        # of the deliveries of one text in a batch the last counts
        last = batch.groupBy("source_file").agg(F.max_by(F.struct("text"), "arrived").alias("t"), F.max("arrived").alias("version"))
        last = last.select("source_file", F.col("t.text").alias("text"), "version", bucket.alias("bucket"))
        buckets = [r[0] for r in last.select("bucket").distinct().collect()]
        versions = held.versions(number)
        before = held.read({b: v for b, v in versions.items() if b in buckets})
        news = last
        if before is not None:
            known = before.groupBy("source_file").agg(F.max("version").alias("held"))
            news = last.join(known, "source_file", "left").where(F.col("held").isNull() | (F.col("version") >= F.col("held"))).drop("held")
        chunks = texts_to_chunks(news.select("source_file", "text"), lexicon)
        rows = chunks.join(news.select("source_file", "version"), "source_file").withColumn("bucket", bucket)
        if before is not None:
            kept = before.join(news.select("source_file"), "source_file", "left_anti").withColumn("bucket", bucket)
            rows = kept.unionByName(rows)
        held.write(rows, buckets, number)

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The table after the newest batch (older than ``below``), or None."""
    held = ChunkTable(spark, table)
    return held.read(held.versions(below))
