"""Quality score of a text, 100 less deductions, by native expressions; no shuffle but for the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import lines, strip

GOOD_SCORE = 70


def _count(rows: Column, test) -> Column:
    return F.size(F.filter(rows, test))


def quality_scores(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, chars, lines, paragraphs, avg_para_len, issues, score``; null texts count as empty ones."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select(
        "key",
        "t",
        F.filter(lines(F.col("t")), lambda x: strip(x) != "").alias("visible"),
        F.filter(F.split("t", "\n\n", -1), lambda p: strip(p) != "").alias("paras"),
    )
    visible = F.col("visible")
    rows = rows.select(
        "key",
        F.length("t").alias("chars"),
        F.size(visible).alias("n_lines"),
        F.size("paras").alias("n_paras"),
        (F.aggregate(F.transform("paras", F.length), F.lit(0), lambda a, x: a + x) / F.nullif(F.size("paras"), F.lit(0))).alias("avg_para"),
        _count(visible, lambda x: x.rlike(P.QUALITY_TOC)).alias("toc"),
        _count(visible, lambda x: strip(x).rlike(r"\A[0-9]{1,4}\z")).alias("numbers"),
        F.substring(F.lower("t"), 1, 2000).rlike("|".join(P.FRONT_WORDS)).alias("front"),
        (_count(visible, lambda x: (F.length(x) > 60) & x.rlike("[.!?]")) / F.nullif(F.size(visible), F.lit(0))).alias("prose"),
    )
    empty = F.col("n_lines") == 0
    average = F.bround("avg_para", 0).cast("long").cast("string")
    found = [
        ((F.col("n_lines") == 1) & (F.col("chars") > 1000), 50, F.lit("SINGLE LINE (no paragraphs)")),
        (F.col("avg_para") > 5000, 20, F.concat(F.lit("Paragraphs too long (avg "), average, F.lit(" chars)"))),
        (F.col("avg_para") < 50, 10, F.concat(F.lit("Paragraphs too short (avg "), average, F.lit(" chars)"))),
        (F.col("toc") > 5, 10, F.concat(F.lit("TOC remnants ("), F.col("toc").cast("string"), F.lit(" lines)"))),
        (F.col("numbers") > 20, 5, F.concat(F.lit("Page numbers ("), F.col("numbers").cast("string"), F.lit(")"))),
        (F.col("front"), 5, F.lit("Front matter remnants")),
        (
            F.col("prose") < 0.3, 15,
            F.concat(F.lit("Low prose ratio ("), F.bround(F.col("prose") * 100, 0).cast("int").cast("string"), F.lit("%)")),
        ),
    ]
    issues = F.filter(F.array(*[F.when(test, name) for test, _, name in found]), lambda x: x.isNotNull())
    lost = sum((F.when(test, cost).otherwise(0) for test, cost, _ in found), F.lit(0))
    return rows.select(
        F.col("key").alias(key),
        F.when(empty, 0).otherwise(F.col("chars")).alias("chars"),
        F.col("n_lines").alias("lines"),
        F.when(empty, 0).otherwise(F.col("n_paras")).alias("paragraphs"),
        F.when(empty, 0).otherwise(F.floor("avg_para").cast("int")).alias("avg_para_len"),
        F.when(empty, F.array(F.lit("EMPTY FILE"))).otherwise(issues).alias("issues"),
        F.when(empty, 0).otherwise(F.greatest(F.lit(100) - lost, F.lit(0))).alias("score"),
    )


def quality_summary(scores: DataFrame) -> DataFrame:
    """One row over all: files, characters, good files and the mean score."""
    return scores.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.count_if(F.col("score") >= GOOD_SCORE).alias("good"),
        F.round(F.avg("score"), 6).alias("avg_score"),
    )


def issue_counts(scores: DataFrame) -> DataFrame:
    """How many texts have each kind of issue (its numbers left out)."""
    kinds = F.transform("issues", lambda x: F.regexp_replace(x, r" \(.*", ""))
    return scores.select(F.explode(kinds).alias("issue")).groupBy("issue").agg(F.count("*").alias("texts"))
