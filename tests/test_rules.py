"""Every rule of lines: what it takes and what it leaves, said case by case."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import text as T

AUTHOR = P.Author("Carla", "Stone", "Grete")

CASES = {
    "front": (
        P.front_matter(("silver house", "some press")),
        ["Copyright 1950", "we hold a copyright here", "ALL RIGHTS  RESERVED", "ISBN 0-1", "Library of Congress", "Printed in the United States", "printed in USA",
         "Printed in the U.S.A.", "Published by X", "some presses", "The Silver House, 1950", "SOME PRESS", "First edition", "first printing 1950", "First published", "Table of  Contents",
         "  contents ", "Acknowledgment", "ACKNOWLEDGMENTS", "Members of the Seminar", "List of Abbreviations", "list of illustrations", "Bibliographical note",
         "Chronology of a life", "CHRONOLOGICAL table"],
        ["The right to copy", "contents of the box", "my acknowledgments", "a list of illustrations", "Printed in Vienna", "house of silver", "in a chronology", ""],
    ),
    "toc": (
        P.TOC_LINE,
        ["IV", "XII.", "iv", "II. 3 May 1931", "Chapter 4", "chapter 12: The rest", "Lecture 3", "SEMINAR 9", "17", "1931", "Introduction", "PREFACE ix", "Index", "Contents", "THE LONG WAY", "3 May 1931",
         # case does not count: any three to thirty-one letters and spaces are a title
         "Chapter Four", "Introduction to it", "The Long Way"],
        ["IV. The rest", "12345", "The Long Way, home", "A", "3 Maj 1931", "3 May 31", "The Long Way from the river to the sea", ""],
    ),
    "back": (P.BACK_HEADING, ["Index", " INDEX ", "Subject index", "NAME INDEX", "general  index", "Bibliography", "Works cited"], ["Index of names", "the index", "Bibliographies", "Works"]),
    "section": (
        P.SECTION_TO_REMOVE,
        ["Table of contents", "Table of content", "CONTENTS", "Content", "Inhalt", "Index", "Name index", "Foreword", "Editor's note", "EDITORS PREFACE", "Translator's introduction", "Publisher's note",
         "Editorial note", "Bibliography", "References", "Works cited", "Suggested reading", "Further reading", "Appendix: Chronology", "appendix : bibliography of", "Copyright © 1950", "copyright 1950",
         "All rights reserved", "ISBN: 0-12", "Library of Congress no.", "Printed in Great Britain", "printed in UK", "Published by the house", "First edition"],
        ["Foreword to the second", "Contents of it", "Editor's remarks", "the references", "Copyright law", "Printed in Vienna", "Appendix: Names", "Further readings"],
    ),
    "somebody": (P.BY_SOMEBODY, ["Introduction by A", "preface by the editor"], ["An introduction by A", "Foreword by A", "Introduction"]),
    "own": (
        P.author_content(AUTHOR),
        ["Author's preface", "AUTHORS NOTE", "Preface by C. G. Stone", "Foreword by Carla Stone", "introduction by Carla Grete Stone", "Stone's preface", "Stones note"],
        ["Preface by D. Stone", "The author's preface", "Foreword"],
    ),
    "header": (
        P.clean_header(AUTHOR),
        ["12", " 1234567 ", "- 12 -", "—12—", "chapter IV", "part 2", "THE COLLECTED WORKS", "C. G. STONE", "C G STONE", "CARLA STONE"],
        ["Chapter IV", "Part 2", "chapter four", "The Collected Works", "Carla Stone", "-- 12 --", "12a"],
    ),
    "page": (
        P.page_header(AUTHOR, "some series"),
        ["12", "1234", "- 12 -", "THE COLLECTED WORKS OF", "the collected works", "VOLUME IV", "volume 12", "C. G. Stone", "Carla Grete Stone", "carla stone", "Some series, 3"],
        ["12345", "VOLUME four", "Carla Stone wrote", "In some series"],
    ),
    "ends": (P.SECTION_END, ["Chapter IV", "part 12", "PART XI: Of", "1. The", "12. Of it"], ["Chapter four", "1.The", "1) The", "12"]),
    "heading": (P.HEADING_START, ["CHAPTER IV", "part 2 of", "Lecture 12"], ["CHAPTER", "Lectures 12", "A CHAPTER IV"]),
    "standard": (P.STANDARD_MARKER, ["CHAPTER IV", "Chapter 4: Of", "PART Two".replace("Two", "II"), "Lecture XI. On"], ["chapter IV", "Chapters IV", "A Chapter IV"]),
    "seminar": (P.SEMINAR_MARKER, ["Seminar 4", "Seminar 12: Of"], ["SEMINAR 4", "Seminar IV", "The Seminar 4"]),
    "letter": (P.LETTER_MARKER, ["3 May 1931", "12 December 1900", "May 3, 1931", "May 3 1931", "To Maria", "To Maria Stone"], ["3 may 1931", "To maria", "To Maria and", "3 May 1931."]),
    "essay": (P.ESSAY_MARKER, ["THE LONG WAY", "A LONG WAY HOME"], ["THE WAY", "THE LONG WAY!", "The LONG WAY HOME"]),
    "report": (P.QUALITY_TOC, ["IV. 12", "XI.3", "Chapter 4 ... 17", "chapter 12....3"], ["IV 12", "Chapter 4", "1. 12"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    rule, taken, left = CASES[name]
    rows = spark.createDataFrame([(x, k) for k, lines in ((True, taken), (False, left)) for x in lines], "x string, expected boolean")
    wrong = rows.where(T.strip(F.col("x")).rlike(rule) != F.col("expected")).collect()
    assert wrong == []
    # the same in the midst of a text
    inside = F.concat(F.lit("Some words.\n"), F.col("x"), F.lit("\nmore, or less."))
    whole = P.whole_line(P.FRONT_START, P.front_anywhere(("silver house", "some press"))) if name == "front" else P.by_line(rule)
    assert rows.where(inside.rlike(whole) != F.col("expected")).collect() == []
    # what guards a rule leaves out nothing of it
    guarded = {"front": P.front_somewhere(("silver house", "some press")), "toc": P.by_line(rule, P.TOC_GUARD)}.get(name, whole)
    assert rows.where(inside.rlike(guarded) != F.col("expected")).collect() == []


def test_rules_of_sections_begin_as_said():
    import re

    begins = re.compile(rf"(?i)\s*(?:{P.SECTION_BEGINS}|{AUTHOR.surname})")
    assert all(begins.match(x) for name in ("section", "somebody", "own", "ends") for x in CASES[name][1])
