"""Micro-cases of texts and lines."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.patterns import Author
from quillspark.functions.vectors import cosine
from quillspark.operators import cleaning
from quillspark.operators.quality import quality_scores

AUTHOR = Author("Carla", "Stone", "Grete")
PROSE = "The first long paragraph of prose has quite a few words in it, and a comma, so that it is counted as prose."


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        out = [r[0] for r in df.orderBy("i").select(function(F.col("t")).alias("x")).collect()]
        return out[0] if len(values) == 1 else out

    return run


def test_footnotes(apply):
    assert apply(T.drop_footnote_marks, "a[1] b [2] C") == "a b [2] C"
    assert apply(T.drop_footnote_marks, "x¹² y") == "x y"


def test_spaced_capitals(apply):
    assert apply(T.normalize_ocr, "A B C D", "S H A D O W") == ["ABCD", "SHADO W"]


def test_author_names_are_put_together(apply):
    assert apply(lambda c: T.normalize_ocr(c, AUTHOR), "s t o n e and C . G . here") == "Stone and C.G. here"


def test_dehyphenate_consumes_its_right_letter(apply):
    assert apply(T.dehyphenate, "a-\nb-\nc") == "ab-\nc"


def test_quotes_stay_unless_asked(apply):
    assert apply(T.normalize_ocr, "“a”") == "“a”"
    assert apply(lambda c: T.normalize_ocr(c, quotes=True), "“a”") == '"a"'


def test_merge_lines(apply):
    merge = lambda c: T.merge_lines(T.lines(c))
    assert apply(merge, "The end.\nNext one\ncontinues here\nand\n\nx") == "The end.\n\nNext one continues here and\n\nx"
    assert apply(merge, None) == ""


def test_sentences(apply):
    assert apply(T.sentences, "Dr. Smith saw CW 9. Then left.") == ["Dr. Smith saw CW.9.", "Then left."]
    assert apply(T.sentences, None) is None


def test_index_like(apply):
    assert apply(T.is_index_like, "alpha, 12, 15 beta, 20 gamma, 33-35 delta, 40 epsilon, 7") is True
    assert apply(T.is_index_like, "a, 1, 2, 3") is False


def test_titles(apply):
    m = apply(T.work_metadata, "(Series 12) Author, A. - Some Title - Press (1999).txt")
    assert (m["title"], m["year"], m["volume"]) == ("Some Title (1999)", "1999", None)


def test_chapter_labels(apply):
    shown = apply(T.display_chapter, "Chapter IV: Alpha", "12", "Children's Dreams", "", None, "x" * 70)
    assert shown[:5] == ["Ch. IV: Alpha", "Ch. 12", "Ch. ildren's Dreams", None, None]
    assert len(shown[5]) == 60


def test_page_header(apply):
    headers = apply(lambda c: T.is_page_header(c, AUTHOR), "12", "- 3 -", "ab", "CARLA STONE", "C. G. Stone", "Carla came home.")
    assert headers == [True, True, True, True, True, False]


def test_clean_header_heeds_case(apply):
    assert apply(T.is_clean_header, "chapter IV", "CHAPTER IV", "12") == [True, False, True]


def test_front_matter(spark):
    def cut(*lines):
        df = spark.createDataFrame([("\n".join(lines),)], "text string")
        return cleaning.remove_front_matter(df).first()[0].split("\n")

    p = [PROSE.replace("first", x) for x in ("one", "two", "three")]
    assert cut(p[0], "", p[1], "", p[2]) == ["", p[1], "", p[2]]
    assert cut(p[0], p[1]) == [p[0], p[1]]
    assert cut("Copyright 1950", "", p[0], p[1]) == [p[0], p[1]]
    assert cut("no prose") == ["no prose"]
    late = ["x " * 3] * 1002 + p
    assert cut(*late) == late


def test_back_matter(spark):
    def size(n, at, tail):
        rows = [f"line {i}" for i in range(n)]
        rows[at] = "INDEX"
        rows[-1] = "z" * tail
        df = spark.createDataFrame([("\n".join(rows),)], "text string")
        return len(cleaning.remove_back_matter(df).first()[0].split("\n"))

    assert size(100, 90, 600) == 90
    assert size(100, 90, 100) == 100
    assert size(100, 85, 600) == 100
    assert size(99, 90, 600) == 99


def test_removable_sections(spark):
    text = "Foreword\nby me\nChapter 1\ntext\nIndex\nBibliography\na\n1. Next\nIntroduction by Carla Stone\nb"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = cleaning.removable_sections(df, author=AUTHOR).orderBy("start_line").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 2, "Foreword"), (4, 7, "Index")]


def test_quality(spark):
    df = spark.createDataFrame([(1, "x" * 1000 + "."), (2, "hi"), (3, None), (4, " \n")], "doc_id long, text string")
    assert {r.doc_id: r.score for r in quality_scores(df).collect()} == {1: 50, 2: 75, 3: 0, 4: 0}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.6, None, None, None]


def test_cleaning_leaves_no_gaps(spark, data):
    out = cleaning.clean_documents(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    assert out.where(F.col("text").rlike("\n{3,}") | F.col("text").isNull() | F.col("text").contains("  ")).count() == 0


def test_needed_words_of_patterns():
    from quillspark.operators.tagging import needed

    assert needed(r"\bthresholds?\b") == ["threshold"] and needed(r"\b(sea|ship)\b") == ["sea", "ship"] and needed("whole(ness)?") == ["whole"]
    assert needed(r"\bdream(s|er|ers)?\b") == ["dream"] and needed(r"sea|ship") == [] and needed(r"s?ea.*") == [] and needed("A") == []


def test_tags_in_any_case(spark):
    from quillspark.operators.tagging import concept_tags

    lexicon = [(0, "sea", r"\b(sea|ship)\b"), (1, "dream", r"\bdream(s|er)?\b"), (2, "upper", r"\bRiver\b"), (3, "space", r"old\sman"), (4, "kin", "kin")]
    rows = [("The SEA and Dreamer", ["sea", "dream"]), ("undersea dreaming", []), ("RIVER ſhip", ["sea", "upper"]), ("OLD  MAN", []), ("Old Man \u212ain", ["space", "kin"]), (None, []), ("", [])]
    df = spark.createDataFrame(rows, "t string, expected array<string>")
    assert all(r.tags == r.expected for r in df.select(concept_tags(F.col("t"), lexicon).alias("tags"), "expected").collect())


def test_rules_of_lines_in_whole_texts(spark):
    """What is found over the whole text is what is found line by line."""
    from quillspark.functions import patterns as P
    from quillspark.operators import cleaning

    author = P.Author("Maria", "Stone", "Clara")
    words = ["A long line of prose, which has more than ten words and is longer than eighty characters in all of it.", "SHORT CAPS LINE", "12", "  - 7 -  ", "", " \t ",
             "Copyright 1950", "x published by y", "CONTENTS", "Index", "M. C. STONE", "Chapter 4", "II.", "A LINE OF CAPITALS, WHICH HAS MORE THAN TEN WORDS AND IS LONGER THAN EIGHTY CHARACTERS IN ALL.", "12 May 1931", "ISBN 1-2", "Chronology of", "a\rb", "\u2028x"]
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(200)] + ["", None, "\n", "\n\n12\n", "12", "12\n12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    lines = df.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "x"))
    header = T.is_clean_header(F.col("x"), author)
    slow = lines.groupBy("doc_id").agg(
        F.count_if(T.strip(F.col("x")) == "").alias("blank"), F.count_if(header).alias("headers"), F.count_if((T.strip(F.col("x")) != "") & T.is_toc_line(F.col("x"))).alias("toc"),
        F.count_if(T.is_front_matter(F.col("x"))).alias("front"), F.count_if(T.is_back_heading(T.strip(F.col("x")))).alias("back"),
        F.count_if(T.is_section_to_remove(T.strip(F.col("x")), author)).alias("sections"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~header, F.struct("n", "x")))), lambda r: r.x), "\n").alias("kept"),
    )
    fast = cleaning.line_classes(df, author=author).join(df.select("doc_id", cleaning.drop_headers(F.col("text"), author).alias("kept")), "doc_id")
    names = ["doc_id", "blank", "headers", "toc", "front", "back", "sections", "kept"]
    assert sorted(map(tuple, fast.select(names).collect())) == sorted(map(tuple, slow.select(names).collect()))
