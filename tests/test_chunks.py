"""Markers, the as-of chapter and the packer."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chapters, chunking
from quillspark.operators.chunking import FIRST, LATER, WHOLE, fold_units


def markers(spark, text, name, **options):
    df = spark.createDataFrame([("a", text, name)], "id string, text string, source_file string")
    return [(r.char_index, r.type, r.number, r.title) for r in chapters.find_markers(df, **options).orderBy("char_index").collect()]


def test_gate_falls_after_the_first_marker(spark):
    text = "12 May 1930\nCHAPTER IV: Alpha\n12 May 1930"
    assert markers(spark, text, "plain.txt") == [(12, "Chapter", "IV", "Alpha"), (30, "Letter", "", "12 May 1930")]
    assert markers(spark, text, "Letters.txt")[0] == (0, "Letter", "", "12 May 1930")


def test_roman_numbers_take_first_letters(spark):
    assert markers(spark, "CHAPTER Visions\nPart Two", "x") == [(0, "Chapter", "V", "isions")]


def test_titles_in_capitals_and_memoirs(spark):
    assert markers(spark, "THE LONG TITLE", "collected works.txt") == [(0, "Essay", "", "The Long Title")]
    assert markers(spark, "THE LONG TITLE", "other.txt") == []
    assert markers(spark, "the tower", "memories and dreams.txt", memoir_chapters=("The Tower",)) == [(0, "Chapter", "", "the tower")]


def test_fold():
    def groups(tokens, kinds=None):
        n = len(tokens)
        kinds = kinds or [WHOLE] * n
        return fold_units(kinds, tokens, range(n), range(1, n + 1), range(n), [None] * n, n)[0]

    assert groups([100, 200, 150, 390, 20, 500, 10]) == [0, 0, 1, 2, 3, 4, 5]
    # a paragraph over the maximum by its sentences, its rest open for the next paragraph
    assert groups([300, 200, 150, 120, 50], [FIRST, LATER, LATER, LATER, WHOLE]) == [0, 1, 1, 2, 2]


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n))


def test_packing(spark):
    text = "\n\n".join([words(100, 1), words(200, 2), words(150, 3), words(390, 4), words(20, 5), words(500, 6), words(10, 7)])
    df = spark.createDataFrame([(1, text, "f.txt"), (2, None, "g.txt"), (3, " \n ", None)], "doc_id long, text string, source_file string")
    rows = chunking.pack_chunks(df).orderBy("doc_id", "chunk_index").collect()
    assert [r.token_count for r in rows] == [300, 150, 390, 500]
    assert [r.chunk_index for r in rows] == [0, 1, 2, 3] and {r.total_chunks for r in rows} == {4}
    assert [r.prev_chunk_id for r in rows] == [None] + [r.id for r in rows[:-1]]
    assert [r.next_chunk_id for r in rows] == [r.id for r in rows[1:]] + [None]
    assert all(text[r.start_char :].startswith(r.text[:20]) for r in rows)


def test_chapters_cut_chunks(spark):
    text = "\n\n".join(["CHAPTER I: One", words(120, 1), "CHAPTER II: Two", words(130, 2)])
    df = spark.createDataFrame([(1, text, "f.txt")], "doc_id long, text string, source_file string")
    rows = chunking.pack_chunks(df, lexicon=[(0, "alpha", r"\balpha\b"), (1, "none", "zzz")]).orderBy("chunk_index").collect()
    assert [r.chapter for r in rows] == ["Chapter I: One", "Chapter II: Two"]
    assert rows[0].concepts == ["alpha"]
    assert rows[0].end_char == text.index("CHAPTER II") - 2 and rows[1].end_char == len(text)


def test_packed_invariants(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("source_file", F.col("doc_id").cast("string"))
    out = chunking.pack_chunks(docs).cache()
    assert out.count() > 0
    assert out.where((F.col("char_count") != F.length("text")) | ((F.col("token_count") < 80) & (F.col("chunk_index") > 0))).count() == 0
    dense = out.groupBy("doc_id").agg(F.max("chunk_index").alias("m"), F.count("*").alias("n"), F.max("total_chunks").alias("t"))
    assert dense.where("m + 1 <> n or n <> t").count() == 0


def test_chapter_asof_over_stretches(spark):
    marks = [("f", at, "Chapter", str(at), "") for at in (5, 70, 70, 200)] + [("g", 0, "Part", "1", "x")]
    marks_df = spark.createDataFrame(marks, "source_file string, char_index int, type string, number string, title string")
    places = [("a", "f", 0), ("b", "f", 5), ("c", "f", 69), ("d", "f", 70), ("e", "f", 199), ("h", "f", 1000), ("i", "g", 3), ("j", "z", 3), ("k", None, 3), ("l", "f", None)]
    df = spark.createDataFrame(places, "id string, source_file string, start_char int")
    expected = {"a": None, "b": "Chapter 5", "c": "Chapter 5", "d": "Chapter 70", "e": "Chapter 70", "h": "Chapter 200", "i": "Part 1: x", "j": None, "k": None, "l": None}
    for stretch in (1, 10, 65_536):
        assert {r.id: r.chapter for r in chapters.chapter_asof(df, marks_df, stretch=stretch).collect()} == expected


@pytest.mark.parametrize("parts", [1, 7])
def test_links_do_not_depend_on_partitions(spark, data, parts):
    chunks = spark.read.parquet(f"{data}/chunks.parquet").repartition(parts)
    links = chunking.neighbour_links(chunks)
    assert links.where("prev_chunk_id is null and chunk_index > 0").join(links.select("source_file", (F.col("chunk_index") + 1).alias("chunk_index")), ["source_file", "chunk_index"]).count() == 0
