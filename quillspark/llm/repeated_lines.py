"""Lines repeated over the texts of one source, by line counts kept per source.

The state is a table with, for each source and line, the number of different
texts that have the line (``LineCounts``, under a path, from run to run).  A new
partition of texts is counted by itself and merged into the state as a delta;
the lines whose count comes to the threshold by that merge are the newly crossed
ones, and only texts that contain one of them are rebuilt (``rebuilt_texts``).

A line is compared lower-cased and trimmed, a run of spaces, tabs, carriage
returns and no-break spaces as one space and a run of digits as one 0.  Lines
of fewer than ``min_letters`` letters are never counted.

Results: null and empty texts have no lines; a null source is a source of its
own; an id counts once in its source however often it is delivered, also when
it comes again in a later partition.  Lines are known by 96 bits of hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.staging import shared_folder

MIN_TEXTS, MIN_LETTERS = 8, 25
KEY = ["source_key", "line_key", "line_check"]
LINES = "id string, line_no int, source_key long, line_key long, line_check int"
COUNTS = "source_key long, line_key long, line_check int, texts long"
PLACES = "id string, line_no int"


def comparable(line: Column) -> Column:
    spaced = F.regexp_replace(F.lower(line), r"[ \t\r\x{a0}]+", " ")
    return F.trim(F.regexp_replace(spaced, "[0-9]+", "0"))


def line_rows(
    chunks: DataFrame, id_col: str = "id", text: str = "text", source: str = "source_file", min_letters: int = MIN_LETTERS
) -> DataFrame:
    """``id, line_no`` and the keys of every line that can count."""
    lines = chunks.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"),
        F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit("\0"))).alias("source_key"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"),
    )
    long_enough = F.length(F.regexp_replace("line", r"[^\p{L}]+", "")) >= min_letters
    plain = comparable(F.col("line"))
    return (
        lines.where((F.length("line") >= min_letters) & long_enough)
        .withColumn("plain", plain)
        .select(
            "id", "line_no", "source_key", F.xxhash64("plain").alias("line_key"),
            F.hash(F.reverse("plain")).alias("line_check"),
        )
    )


def count_lines(lines: DataFrame) -> DataFrame:
    """The count table of one partition: distinct texts by source and line."""
    once = lines.select(*KEY, F.xxhash64("id").alias("text_key")).distinct()
    return once.groupBy(*KEY).agg(F.count("*").alias("texts"))


def merge_counts(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after a partition; both sides are already aggregated, so only counts are shuffled."""
    return state.unionByName(delta).groupBy(*KEY).agg(F.sum("texts").alias("texts"))


def crossed(state: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    return state.where(F.col("texts") >= min_texts).select(*KEY)


def newly_crossed(before: DataFrame, after: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Lines that reach the threshold by a merge."""
    return crossed(after, min_texts).join(crossed(before, min_texts), KEY, "left_anti")


def unseen(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """The lines of a partition without the texts that an earlier partition has delivered."""
    return lines.join(seen.select("id", "source_key").distinct(), ["id", "source_key"], "left_anti")


def occurrences(lines: DataFrame, crossed_lines: DataFrame) -> DataFrame:
    """``id, line_no``: every place of a crossed line, once."""
    return lines.join(crossed_lines, KEY, "left_semi").select("id", "line_no").distinct()


def without_lines(chunks: DataFrame, places: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """``id, text``: the texts that have such lines, rebuilt without them, once each."""
    gone = places.groupBy("id").agg(F.collect_set("line_no").alias("_gone"))
    rows = chunks.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).join(gone, "id")
    kept = F.expr("filter(split(text, '\\n', -1), (x, i) -> not array_contains(_gone, i))")
    return rows.select("id", F.array_join(kept, "\n").alias("text")).dropDuplicates(["id"])


def rebuilt_texts(
    chunks: DataFrame, table: LineCounts, added: DataFrame, id_col: str = "id", text: str = "text"
) -> DataFrame:
    """``id, text`` of the texts that a merge concerns (``added``, what it gave), without all their crossed lines; of all
    others what was made of them before still holds."""
    concerned = added.select("id").distinct()
    return without_lines(chunks, table.places().join(concerned, "id", "left_semi"), id_col, text)


def cleaned_texts(chunks: DataFrame, places: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """``id, text``: every text, once each, without such lines; texts without them (null and empty ones too) as they stand."""
    gone = places.groupBy("id").agg(F.collect_set("line_no").alias("_gone"))
    rows = chunks.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).join(gone, "id", "left")
    kept = F.expr("filter(split(text, '\\n', -1), (x, i) -> not array_contains(_gone, i))")
    whole = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select("id", whole.alias("text")).dropDuplicates(["id"])


class LineCounts:
    """The count table of a corpus under a path, kept from run to run.

    ``lines``: the keys of every line of every text that came, in which texts of before are looked up; ``counts``: by source
    and line, the number of texts; ``places``: the places of crossed lines that have been told. ``lines`` and ``places`` are
    added to; ``counts`` is written anew by each merge, since a merge changes a count wherever a line comes again, and the
    newest complete version counts. A merge that was cut off is done again under the same number.
    """

    def __init__(
        self, spark: SparkSession, path: str, min_texts: int = MIN_TEXTS, min_letters: int = MIN_LETTERS, id_col: str = "id",
        text: str = "text", source: str = "source_file",
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.min_texts, self.min_letters = min_texts, min_letters
        self.columns = (id_col, text, source)
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._files = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def merges(self) -> int:
        """How many partitions have been merged."""
        folder = self._jvm.Path(f"{self.path}/counts")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        done = [int(n) for n in names if n.isdigit() and self._files.exists(self._jvm.Path(f"{self.path}/counts/{n}/_SUCCESS"))]
        return max(done, default=0)

    def _read(self, name: str, upto: int) -> DataFrame:
        """What has been added to a table by the first ``upto`` merges."""
        return self.spark.read.schema(LINES if name == "lines" else PLACES).parquet(*[f"{self.path}/{name}/{k}" for k in range(1, upto + 1)])

    def counts(self) -> DataFrame | None:
        number = self.merges()
        return self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts/{number}") if number else None

    def places(self) -> DataFrame:
        """``id, line_no`` of every crossed line so far."""
        number = self.merges()
        if not number:
            return self.spark.createDataFrame([], PLACES)
        return self._read("places", number).select("id", "line_no").distinct()

    def merge(self, part: DataFrame) -> DataFrame:
        """Merges a partition; gives ``id, line_no`` of what it adds: places of newly crossed lines in texts of before, and of
        all crossed lines in its own texts. Those are the texts to rebuild.

        A partition costs its own lines, a merge of counts, and a join of the newly crossed lines with the lines kept.
        """
        number = self.merges()
        before = self.counts()
        last, now = f"{self.path}/counts/{number}", number + 1
        fresh = line_rows(part, *self.columns, self.min_letters)
        if number:
            kept = self._read("lines", number)
            fresh = unseen(fresh, kept)
        fresh.write.mode("overwrite").parquet(f"{self.path}/lines/{now}")
        fresh = self.spark.read.schema(LINES).parquet(f"{self.path}/lines/{now}")
        delta = count_lines(fresh)
        after = merge_counts(before, delta) if number else delta
        # the version is complete when its places are told as well: it is written beside and moved at last
        beside = f"{self.path}/counts/_{now}"
        after.write.mode("overwrite").parquet(beside)
        state = self.spark.read.schema(COUNTS).parquet(beside)
        found = occurrences(fresh, crossed(state, self.min_texts))
        if number:
            found = found.unionByName(occurrences(kept, newly_crossed(before, state, self.min_texts)))
        found.write.mode("overwrite").parquet(f"{self.path}/places/{now}")
        self._files.delete(self._jvm.Path(f"{self.path}/counts/{now}"), True)
        self._files.rename(self._jvm.Path(beside), self._jvm.Path(f"{self.path}/counts/{now}"))
        if number:
            self._files.delete(self._jvm.Path(last), True)
        return self.spark.read.schema(PLACES).parquet(f"{self.path}/places/{now}")


def repeated_lines(
    first: DataFrame, later: list[DataFrame], min_texts: int = MIN_TEXTS, min_letters: int = MIN_LETTERS,
    id_col: str = "id", text: str = "text", source: str = "source_file", path: str | None = None,
) -> DataFrame:
    """``id, line_no`` after a first load and later partitions, each merged as a delta; the table is kept under ``path``, or in
    the shared folder for this run."""
    spark = first.sparkSession
    table = LineCounts(spark, path or f"{shared_folder(spark)}/line-counts-{uuid.uuid4().hex[:12]}", min_texts, min_letters, id_col, text, source)
    for part in (first, *later):
        table.merge(part)
    return table.places()
