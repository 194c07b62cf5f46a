"""Most similar rows of a query set, relevance, citations and prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions.text import display_chapter

TOP_K, RELEVANT, CITED = 6, 0.7, 3
#: Queries held by a task at a time: 20,000 of 1,024 numbers are 160 MB; more are searched in further passes.
BLOCK_NUMBERS = 20_000_000
#: Of them, so many are compared with a batch of rows at a time.
PART_QUERIES = 256
RULES = (
    "You are a knowledgeable guide to the library. Answer in two to four sentences, directly.\n"
    "Cite [1], [2] only where the words of a source are quoted."
)
NO_SOURCES = "No relevant sources were found; answer from general knowledge."


def _finite(v: Column, dim: int) -> Column:
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def top_similar(
    queries: DataFrame, rows: DataFrame, dim: int, k: int = TOP_K, query_id: str = "query_id", query_values: str = "values",
    row_id: str = "id", row_values: str = "values", least: float | None = None,
) -> DataFrame:
    """``query_id, id, score, rank``: the k rows of greatest cosine for each query, exactly; ties to the smaller id.

    All rows are read once for each block of queries.  A task keeps the k best rows of its partition for every query
    and only those are shuffled.  ``least`` drops scores that do not exceed it, before ranking (the same as after).
    Null, wrong-sized, not finite and zero vectors take no part.
    """
    query_kind = queries.schema[query_id].dataType.simpleString()
    row_kind = rows.schema[row_id].dataType.simpleString()
    query_type, row_type = to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(rows.schema[row_id].dataType)
    asked = queries.where(_finite(F.col(query_values), dim)).select(F.col(query_id).alias("q"), F.col(query_values).cast("array<double>").alias("v"))
    searched = rows.where(_finite(F.col(row_values), dim)).select(F.col(row_id).alias("r"), F.col(row_values).cast("array<double>").alias("v"))
    block = max(1, BLOCK_NUMBERS // dim)
    blocks = max(1, -(-asked.count() // block))
    context = rows.sparkSession.sparkContext
    found: DataFrame | None = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asked
        held = part.toArrow()
        names = held.column("q")
        x = np.asarray(held.column("v").combine_chunks().flatten()).reshape(-1, dim) if held.num_rows else np.zeros((0, dim))
        x = x / np.linalg.norm(x, axis=1)[:, None]
        shared = context.broadcast((names.to_pylist(), x))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, queries_x = shared.value
            # a part of the queries at a time: its scores of a batch are some 20 MB
            firsts = range(0, len(ids), PART_QUERIES)
            best = [(np.zeros((min(PART_QUERIES, len(ids) - f), 0)), np.empty((min(PART_QUERIES, len(ids) - f), 0), dtype=object)) for f in firsts]
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                y = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
                y = y / np.linalg.norm(y, axis=1)[:, None]
                names = np.array(batch.column(0).to_pylist(), dtype=object)
                order = np.argsort(names, kind="stable")
                y, names = y[order], names[order]
                for p, f in enumerate(firsts):
                    best[p] = _best(*best[p], queries_x[f : f + PART_QUERIES] @ y.T, names, k)
            for f, (scores, found) in zip(firsts, best):
                q, c = np.nonzero(scores > (-2 if least is None else least))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[f + i] for i in q], query_type), pa.array(found[q, c].tolist(), row_type), pa.array(scores[q, c])],
                    names=["query_id", "id", "score"],
                )

        hits = searched.mapInArrow(search, f"query_id {query_kind}, id {row_kind}, score double")
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(scores: np.ndarray, names: np.ndarray, more: np.ndarray, more_names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of those held and of a batch, with all that reach the k-th score: ties are decided by the id afterwards."""
    if more.shape[1] > k:
        # of a batch only what reaches its own k-th score can be among the best
        limit = -np.partition(-more, k - 1, axis=1)[:, k - 1]
        width = int((more >= limit[:, None]).sum(1).max())
        top = np.argsort(-more, axis=1, kind="stable")[:, :width]
        more, new_names = np.take_along_axis(more, top, 1), more_names[top]
    else:
        new_names = np.broadcast_to(more_names, more.shape)
    scores, names = np.concatenate([scores, more], 1), np.concatenate([names, new_names], 1)
    if scores.shape[1] > k:
        limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        width = int((scores >= limit[:, None]).sum(1).max())
        top = np.argsort(-scores, axis=1, kind="stable")[:, :width]
        scores, names = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
    return scores, names


def relevant(hits: DataFrame, least: float = RELEVANT, keep: int = CITED) -> DataFrame:
    """Hits over the least score, the first few of each query."""
    return hits.where((F.col("score") > least) & (F.col("rank") <= keep))


def hit_fields(hits: DataFrame) -> DataFrame:
    """Missing and empty titles as ``Unknown``, chapters as null, texts as empty, scores as 0."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return hits.withColumns(
        {
            "work_title": F.coalesce(blank("work_title"), F.lit("Unknown")),
            "chapter": blank("chapter"),
            "text": F.coalesce(F.col("text"), F.lit("")),
            "score": F.coalesce(F.col("score"), F.lit(0.0)),
        }
    )


def _citation(h: Column) -> Column:
    return F.concat(
        F.lit("["), h.rank.cast("string"), F.lit("] "), h.work_title, F.when(h.chapter.isNotNull(), F.concat(F.lit(", "), h.chapter)).otherwise("")
    )


def prompts(hits: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``query_id, hits, context, citations, system``: one row for each query, those without hits too.

    A query has at most the cited number of hits, so what is collected for it is bounded.
    """
    fields = F.struct("rank", "work_title", "chapter", "text")
    grouped = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(fields)).alias("h"))
    df = queries.select(query_id).distinct().join(grouped, query_id, "left")
    h = F.coalesce(F.col("h"), F.array().cast(grouped.schema["h"].dataType))
    context = F.array_join(F.transform(h, lambda x: F.concat(_citation(x), F.lit("\n"), x.text)), "\n\n---\n\n")
    return df.select(
        query_id,
        F.size(h).alias("hits"),
        context.alias("context"),
        F.array_join(F.transform(h, _citation), "\n").alias("citations"),
        F.concat(
            F.lit(RULES + "\n\n"), F.when(F.size(h) > 0, F.concat(F.lit("Sources:\n"), context)).otherwise(F.lit(NO_SOURCES))
        ).alias("system"),
    )


def hit_line(rank: Column, work_title: Column, chapter: Column) -> Column:
    """A hit as a numbered line of a list: title and, where there is one, the chapter's short form."""
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] "), work_title,
        F.when(chapter.isNotNull(), F.concat(F.lit(" — "), display_chapter(chapter))).otherwise(""),
    )


def with_question(history: Column, question: Column) -> Column:
    """The conversation with the question as the user's last turn."""
    turn = F.struct(F.lit("user").alias("role"), question.alias("content"))
    return F.array_append(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), turn)
