"""From texts to a vector table, one plan after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.patterns import Author
from quillspark.operators.chunking import pack_chunks
from quillspark.operators.cleaning import clean_documents
from quillspark.operators.indexing import upsert, vector_records
from quillspark.plugins import Embedder, embed_texts
from quillspark.sources.tables import of_length
from quillspark.staging import written


def texts_to_chunks(texts: DataFrame, lexicon: list[tuple[int, str, str]] | None = None, author: Author | None = None) -> DataFrame:
    """``source_file, text`` to chunks: a narrow map of whole documents, without a shuffle."""
    return pack_chunks(clean_documents(texts, author=author), key="source_file", lexicon=lexicon)


def chunks_to_vectors(chunks: DataFrame, embed: Embedder) -> tuple[DataFrame, DataFrame]:
    """Vector records, and the rows that could not be embedded with their errors."""
    embedded = written(embed_texts(chunks, embed), "embedded")
    good = embedded.where(F.col("error").isNull())
    return vector_records(chunks, good), embedded.where(F.col("error").isNotNull()).select("id", "error")


def upsert_vectors(current: DataFrame, records: DataFrame, dim: int | None = None) -> DataFrame:
    """``dim`` is the length that all vectors must have."""
    records = records if dim is None else of_length(records, dim)
    return upsert(current, records.withColumn("version", F.current_timestamp()))
