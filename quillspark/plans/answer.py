"""From questions to prompts and answers, many in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.retrieval import hit_fields, prompts, relevant, top_similar, with_question
from quillspark.plugins import Embedder, answers, embed_texts
from quillspark.staging import written


def ask(
    questions: DataFrame, vectors: DataFrame, embed: Embedder, dim: int, generate: Callable[[str, list[dict]], str] | None = None
) -> DataFrame:
    """``query_id, hits, context, citations, system, messages`` (and ``message, error`` with a generator).

    ``questions``: query_id, query and history (an array of role and content, or null). Blank questions are left out.
    Each question is embedded once, into a table.  One that could not be embedded has its error in ``embedding_error``,
    neither hits nor a system prompt, and is not given to the generator.
    """
    asked = questions.where(F.trim("query") != "")
    embedded = written(embed_texts(asked, embed, "query_id", "query", "query: "), "questions")
    hits = relevant(top_similar(embedded.where(F.col("error").isNull()), vectors, dim))
    fields = vectors.select("id", "metadata.work_title", "metadata.chapter", "metadata.text")
    made = prompts(hit_fields(hits.join(fields, "id")), asked)
    made = made.join(embedded.select("query_id", F.col("error").alias("embedding_error")), "query_id", "left")
    made = made.withColumn("system", F.when(F.col("embedding_error").isNull(), F.col("system")))
    turns = asked.select("query_id", with_question(F.col("history"), F.col("query")).alias("messages"))
    made = made.join(turns, "query_id")
    if generate is None:
        return made
    return made.join(answers(made.where(F.col("embedding_error").isNull()), generate), "query_id", "left")
