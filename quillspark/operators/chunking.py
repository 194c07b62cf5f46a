"""Packing of paragraphs into chunks of about a target of tokens.

Texts are cut, counted, joined, numbered, linked and named by native expressions
inside the row, so packing needs no shuffle.  Only the fold over the counts of a
document's paragraphs (sentences, for paragraphs over the maximum) is a function
over Arrow batches: its sums start anew wherever a chunk ends, which neither a
window nor a join can say.  It gets lengths and counts, no texts, and gives the
places of the paragraphs and each chunk's run of units in one pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import patterns as P
from quillspark.functions.text import chapter_label, count_tokens, is_index_like, sentences, strip, where_found, work_metadata
from quillspark.operators.chapters import with_markers
from quillspark.operators.tagging import concept_tags

TARGET_TOKENS, MAX_TOKENS, MIN_TOKENS = 400, 600, 80
WHOLE, FIRST, LATER = 0, 1, 2
#: Between paragraphs and what parts them; Unicode keeps this code point out of texts.
_CUT = "\ufdd0"


def pieces(text: Column) -> Column:
    """A text's paragraphs and what parts them by turns, as structs: raw length, white space before, the stripped text.

    The raw lengths add up to the text's, so that each paragraph's place is known without a search.
    """
    plain = where_found(text, _CUT, lambda x: F.translate(x, _CUT, "?"))
    marked = F.regexp_replace(plain, rf"(\n{P.S}*\n)", f"{_CUT}$1{_CUT}")
    bare = lambda x: strip(x)
    return F.transform(
        F.split(marked, _CUT, -1),
        lambda x: F.struct(
            F.length(x).alias("size"),
            (F.length(x) - F.length(F.call_function("ltrim", F.lit(P.SPACE_CHARS), x))).alias("lead"),
            bare(x).alias("text"),
        ),
    )


def _units(token_count: Callable[[Column], Column]) -> Column:
    """Paragraphs, or the sentences of those over the maximum, as structs for the fold."""

    def of(p: Column) -> Column:
        parts = sentences(p.text)
        whole = F.array(
            F.struct(F.lit(WHOLE).alias("kind"), F.array_join(parts, " ").alias("text"), p.tokens.alias("tokens"), p.piece.alias("piece"))
        )
        split = F.transform(
            parts,
            lambda x, i: F.struct(
                F.when(i == 0, FIRST).otherwise(LATER).alias("kind"), x.alias("text"), token_count(x).alias("tokens"), p.piece.alias("piece")
            ),
        )
        return F.when(p.tokens > MAX_TOKENS, split).otherwise(whole)

    return F.flatten(F.transform("paras", of))


FOLDED = T.ArrayType(
    T.StructType(
        [T.StructField(c, T.IntegerType()) for c in ("first", "units", "start", "end")] + [T.StructField("chapter", T.StringType())]
    )
)


def fold_units(kinds, tokens, starts, ends, befores, chapters, length: int) -> tuple[list, list, list, list]:
    """The chunk of each unit, and start, end and chapter of each chunk.

    The open chunk is all the state: it is closed by a change of chapter, by a unit that would pass the target, and by the
    first sentence of a paragraph over the maximum.
    """
    groups, found = [], ([], [], [])
    open_, total, chapter, start = False, 0, None, 0

    def close(end: int) -> None:
        for values, value in zip(found, (start, end, chapter)):
            values.append(value)

    for kind, n, at, end, before, label in zip(kinds, tokens, starts, ends, befores, chapters):
        if kind != LATER and label != chapter:
            if open_:
                close(before)
            chapter, start, open_, total = label, at, False, 0
        elif open_ and (kind == FIRST or total + n > TARGET_TOKENS):
            close(end if kind == LATER else at)
            start, open_, total = at, False, 0
        groups.append(len(found[0]))
        open_, total = True, total + n
    if open_:
        close(length)
    return groups, *found


def fold_document(kinds, tokens, piece, sizes, leads, inner, marks, labels) -> list[dict]:
    """Each chunk's run of units, place and chapter, from the counts of a document's units and the lengths of its pieces."""
    piece, sizes, leads, inner = (np.asarray(x, np.int64) for x in (piece, sizes, leads, inner))
    starts = np.cumsum(sizes) - sizes + leads
    ends = starts + inner
    # the end of the paragraph before, of those with text
    before = np.where(inner > 0, ends, 0)
    before = np.concatenate([[0], np.maximum.accumulate(before)[:-1]]) if len(before) else before
    # the last marker at or before a place holds
    places = sorted(zip(marks, range(len(marks))))
    held = [bisect_right(places, (at, len(marks))) for at in starts[piece].tolist()]
    chapters = [labels[places[k - 1][1]] if k else None for k in held]
    groups, begin, end, chapter = fold_units(
        kinds, tokens, starts[piece].tolist(), ends[piece].tolist(), before[piece].tolist(), chapters, int(sizes.sum())
    )
    first = np.searchsorted(groups, range(len(begin))).tolist()
    return [
        {"first": f, "units": e - f, "start": s, "end": t, "chapter": c}
        for f, e, s, t, c in zip(first, [*first[1:], len(groups)], begin, end, chapter)
    ]


@F.pandas_udf(FOLDED)
def _fold(
    kinds: pd.Series, tokens: pd.Series, piece: pd.Series, sizes: pd.Series, leads: pd.Series, inner: pd.Series, marks: pd.Series,
    labels: pd.Series,
) -> pd.Series:
    return pd.Series([fold_document(*x) for x in zip(kinds, tokens, piece, sizes, leads, inner, marks, labels)], dtype=object)


def pack_chunks(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source_file: str = "source_file",
    lexicon: list[tuple[int, str, str]] | None = None,
    token_count: Callable[[Column], Column] = count_tokens,
    memoir_chapters: tuple[str, ...] = (),
    titles: list[tuple[int, str, str]] | None = None,
    publishers: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each chunk, with ``key`` (unless it is the source file itself) and the columns of the chunk table.

    Boundaries: a chapter's change, or a paragraph that would pass the target.  A paragraph over the maximum is packed by
    sentences; a single longer sentence stays whole.  Index-like paragraphs are left out; so are chunks under the
    minimum, but for a document's first.  Null and blank texts have no chunks.  ``titles`` (ordinal, key, title) names
    works whose file's name has a key; ``publishers`` end other names (see ``work_metadata``).
    """
    df = documents.select(
        F.col(key).alias("key"), F.coalesce(F.col(source_file).cast("string"), F.lit("")).alias("source_file"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    df = with_markers(df, "text", "source_file", memoir_chapters).withColumn("pieces", pieces(F.col("text"))).drop("text")
    numbered = F.transform(
        "pieces",
        lambda p, i: F.struct(i.alias("piece"), p.text.alias("text"), token_count(p.text).alias("tokens"), is_index_like(p.text).alias("index_like")),
    )
    df = df.withColumn("paras", F.filter(numbered, lambda p: (p.text != "") & ~p.index_like))
    df = df.withColumn("units", _units(token_count))
    labels = F.transform("markers", lambda m: chapter_label(m.type, m.number, m.title))
    inner = F.transform("pieces", lambda p: F.length(p.text))
    fold = _fold(
        F.col("units.kind"), F.col("units.tokens"), F.col("units.piece"), F.col("pieces.size"), F.col("pieces.lead"), inner,
        F.col("markers.char_index"), labels,
    )
    # the title is a document's, made before its chunks are rows
    title = work_metadata(F.col("source_file"), titles, publishers).title
    df = df.select("key", "source_file", title.alias("title"), "units", fold.alias("chunks"))

    def chunk(c: Column) -> Column:
        joined = F.array_join(
            F.transform(
                F.slice("units", c.first + 1, c.units), lambda u: F.concat(F.when(u.kind == LATER, " ").otherwise("\n\n"), u.text)
            ),
            "",
        )
        return F.struct(
            F.regexp_replace(joined, r"\A(?:\n\n| )", "").alias("text"), c.start.alias("start"), c.end.alias("end"), c.chapter.alias("chapter")
        )

    df = df.withColumn("all", F.transform("chunks", chunk))
    counted = F.transform("all", lambda c, i: F.struct(c.alias("c"), token_count(c.text).alias("tokens"), i.alias("i")))
    df = df.withColumn("kept", F.filter(counted, lambda x: (x.i == 0) | (x.tokens >= MIN_TOKENS)))
    name = lambda x, i: F.substring(F.md5(F.concat_ws(":", "source_file", x.c.start, x.c.end, i)), 1, 16)
    df = df.withColumn("ids", F.transform("kept", name))
    # the outer form: from the plain one the optimizer infers filters that it pushes below all this, expression by expression
    out = df.select("key", "source_file", "title", "kept", "ids", F.posexplode_outer("kept").alias("n", "x")).where(F.col("n").isNotNull())
    content = F.col("x.c.text")
    return out.select(
        *([F.col("key").alias(key)] if key != "source_file" else []),
        F.get("ids", F.col("n")).alias("id"),
        content.alias("text"),
        "source_file",
        F.col("title").alias("work_title"),
        F.col("x.c.chapter").alias("chapter"),
        F.col("n").alias("chunk_index"),
        F.size("kept").alias("total_chunks"),
        F.col("x.tokens").alias("token_count"),
        F.length(content).alias("char_count"),
        F.col("x.c.start").alias("start_char"),
        F.col("x.c.end").alias("end_char"),
        F.when(F.col("n") > 0, F.get("ids", F.col("n") - 1)).alias("prev_chunk_id"),
        F.get("ids", F.col("n") + 1).alias("next_chunk_id"),
        concept_tags(content, lexicon or []).alias("concepts"),
    )


def first_deliveries(chunks: DataFrame, key: str = "id", order: str = "ingested_at") -> DataFrame:
    """Each id once, as it was first delivered."""
    w = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last())
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def neighbour_links(chunks: DataFrame) -> DataFrame:
    """``id, source_file, chunk_index, prev_chunk_id, next_chunk_id, total_chunks`` from the positions in the file.

    Neighbours meet by a join on file and position, so a file with a third of all rows is spread like any other;
    the counts are aggregated before they are joined.
    """
    rows = chunks.select("id", "source_file", "chunk_index").distinct()
    at = lambda name, shift: rows.select(
        F.col("id").alias(name), F.col("source_file").alias("f"), (F.col("chunk_index") + shift).alias("i")
    )
    linked = rows
    for other in (at("prev_chunk_id", 1), at("next_chunk_id", -1)):
        on = linked["source_file"].eqNullSafe(other["f"]) & (linked["chunk_index"] == other["i"])
        linked = linked.join(other, on, "left").drop("f", "i")
    totals = rows.groupBy("source_file").agg(F.count("*").cast("int").alias("total_chunks")).withColumnRenamed("source_file", "f")
    return linked.join(totals, linked["source_file"].eqNullSafe(totals["f"]), "left").drop("f")


def _figures() -> list[Column]:
    return [
        F.count("*").alias("chunks"),
        F.round(F.avg("token_count"), 6).alias("avg_tokens"),
        F.count_if(F.size("concepts") > 0).alias("with_concepts"),
        F.count_if(F.coalesce(F.col("chapter"), F.lit("")) != "").alias("with_chapter"),
    ]


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """By file: chunks (each id once), mean tokens, chunks with a concept and with a chapter."""
    once = first_deliveries(chunks.select("id", "source_file", "token_count", "concepts", "chapter", "ingested_at"))
    return once.groupBy("source_file").agg(*_figures())


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """The same over all files, with their number, in one row."""
    once = first_deliveries(chunks.select("id", "source_file", "token_count", "concepts", "chapter", "ingested_at"))
    return once.agg(*_figures(), F.countDistinct("source_file").alias("files"))
