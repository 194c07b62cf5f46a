"""Registered queries of the operators on training texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import count_tokens, encode_column
from quillspark.llm.common import ship, table, written
from quillspark.llm.near_duplicates import expanded, groups, similar_pairs
from quillspark.llm.neighbours import nearest, neighbour_pairs
from quillspark.llm.packing import pack
from quillspark.llm.quality import common_words, not_prose, text_statistics
from quillspark.llm.repeated_lines import cleaned_texts, repeated_lines, without_lines
from quillspark.llm.scan_noise import find_noise, repair
from quillspark.llm.spam import spam_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Lines of a source in at least 8 texts, said at once instead of by deltas. The operators without SQL are approximate or
#: learned from the corpus, and are tested against brute force, an exact round trip or cases.
_LINES = r"""WITH c AS (SELECT DISTINCT id, source_file, text FROM chunks WHERE text IS NOT NULL),
l AS (SELECT id, source_file, i - 1 AS line_no, ls[i] AS x FROM (SELECT id, source_file, ls, unnest(range(1, len(ls) + 1)) AS i
    FROM (SELECT id, source_file, string_split(text, chr(10)) AS ls FROM c))),
k AS (SELECT id, source_file, line_no, trim(regexp_replace(regexp_replace(lower(x), '[ \t\r\x{a0}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS k
    FROM l WHERE length(regexp_replace(x, '[^\p{L}]+', '', 'g')) >= 25),
n AS (SELECT source_file, k FROM k GROUP BY ALL HAVING count(DISTINCT id) >= 8),
f AS (SELECT DISTINCT k.id, k.line_no::INT AS line_no FROM k JOIN n ON k.k = n.k AND k.source_file IS NOT DISTINCT FROM n.source_file)
"""
ORACLE: dict[str, str] = {
    "p4_found": _LINES + "SELECT id, line_no FROM f",
    "p4_cleaned": _LINES
    + """SELECT c.id, array_to_string(list_transform(list_filter(range(1, len(string_split(c.text, chr(10))) + 1),
    lambda i: NOT list_contains(g.gone, (i - 1)::INT)), lambda i: string_split(c.text, chr(10))[i]), chr(10)) AS text
    FROM (SELECT id, any_value(text) AS text FROM c GROUP BY id) c JOIN (SELECT id, list(line_no) AS gone FROM f GROUP BY id) g ON c.id = g.id""",
    "p4_texts": _LINES
    + """SELECT c.id, CASE WHEN g.gone IS NULL THEN c.text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(c.text, chr(10))) + 1),
    lambda i: NOT list_contains(g.gone, (i - 1)::INT)), lambda i: string_split(c.text, chr(10))[i]), chr(10)) END AS text
    FROM (SELECT id, any_value(text) AS text FROM chunks GROUP BY id) c LEFT JOIN (SELECT id, list(line_no) AS gone FROM f GROUP BY id) g ON c.id = g.id""",
    # texts that share a sequence of three words meet by it
    "p3_found": r"""WITH w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL)),
    s AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
    SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE both_ >= 0.5 * (x.n + y.n - both_)""",
}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(nearest(table(spark, sf_dir, "vectors")))


@query
def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "vectors"))


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id")


@query
def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sizes = count_tokens(documents.select("doc_id", "source", F.md5("text").alias("cluster"), "text"))
    return pack(sizes)


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first load of chunks, and the partition that came after it: over a week after the last file began to arrive.

    One time divides the rows, so no row is moved for it; rows without a time count as first deliveries.
    """
    chunks = table(spark, sf_dir, "chunks")
    begun = chunks.groupBy("source_file").agg(F.min("ingested_at").alias("begun")).agg(F.max("begun")).first()[0]
    late = F.coalesce(F.col("ingested_at") > F.lit(begun) + F.expr("interval 7 days"), F.lit(False))
    return chunks.where(~late), chunks.where(late)


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(similar_pairs(table(spark, sf_dir, "chunks"), width=3, threshold=0.5))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, late = _deliveries(spark, sf_dir)
    return repeated_lines(first, [late])


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = common_words(table(spark, sf_dir, "common_words"))
    return not_prose(text_statistics(table(spark, sf_dir, "chunks"), common))


@query
def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = common_words(table(spark, sf_dir, "common_words"))
    return text_statistics(table(spark, sf_dir, "chunks"), common, once=True)


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = common_words(table(spark, sf_dir, "common_words"))
    return spam_pages(table(spark, sf_dir, "documents"), common).select("doc_id")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = common_words(table(spark, sf_dir, "common_words"))
    return find_noise(table(spark, sf_dir, "chunks"), common)


@query
def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = common_words(table(spark, sf_dir, "common_words"))
    return repair(table(spark, sf_dir, "chunks"), common, once=True)


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(similar_pairs(table(spark, sf_dir, "chunks"), width=3, threshold=0.5))


@query
def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, late = _deliveries(spark, sf_dir)
    return without_lines(table(spark, sf_dir, "chunks"), written(repeated_lines(first, [late]), "line-places"))


@query
def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, late = _deliveries(spark, sf_dir)
    return cleaned_texts(table(spark, sf_dir, "chunks"), written(repeated_lines(first, [late]), "line-places"))
