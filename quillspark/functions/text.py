"""Column functions on texts and lines, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.patterns import Author


def once(value: Column, function) -> Column:
    """``function(value)``, the value being computed once however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def where_found(text: Column, rule: str, function) -> Column:
    """``function(text)`` where the rule holds somewhere in the text, else the text: one scan for texts that have nothing of it."""
    return once(text, lambda t: F.when(t.rlike(rule), function(t)).otherwise(t))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(P.SPACE_CHARS))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def unlines(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def squeeze_breaks(text: Column) -> Column:
    """At most one empty line between lines."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def squeeze_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t]+", " ")


def strip_lines(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?dm)^{P.L}+|{P.L}++$", "")


def dehyphenate(text: Column) -> Column:
    """Joins words broken by a hyphen over a line end."""
    return F.regexp_replace(text, rf"([\p{{L}}\p{{N}}_])-{P.S}*\n{P.S}*([\p{{L}}\p{{N}}_])", "$1$2")


def plain_dashes(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("—"), F.lit("-")), F.lit("–"), F.lit("-"))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "“”„«»‘’‚", "\"\"\"\"\"'''")


def normalize_ocr(text: Column, author: Author | None = None, quotes: bool = False) -> Column:
    """Repairs of scanned texts, in their fixed order."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, rf"(?i)Copyrighted Material{P.S}*", "")
    if author:
        spaced = rf"{P.S}+".join(author.surname)
        t = F.regexp_replace(t, rf"(?i)\b{spaced}\b", author.surname)
        names = [n for n in (author.first, author.middle) if n]
        t = F.regexp_replace(t, r"\b" + rf"{P.S}*\.{P.S}*".join(n[0] for n in names) + rf"{P.S}*\.", "".join(n[0] + "." for n in names))
    t = F.regexp_replace(t, rf"\bM{P.S}*\.{P.S}*D{P.S}*\.", "M.D.")
    t = F.regexp_replace(t, rf"\bP{P.S}*h{P.S}*\.{P.S}*D{P.S}*\.", "Ph.D.")
    spaced = lambda n, letter: r"\b" + rf"{P.S}+".join([letter] * n)
    joined = lambda x, n: F.regexp_replace(x, spaced(n, "([A-Z])") + r"\b", "".join(f"${i + 1}" for i in range(n)))
    t = where_found(t, spaced(4, "[A-Z]"), lambda x: joined(joined(x, 5), 4))
    if quotes:
        t = straight_quotes(t)
    t = F.replace(t, F.lit("…"), F.lit("..."))
    t = squeeze_blanks(dehyphenate(plain_dashes(t)))
    t = F.regexp_replace(t, rf"\[PAGE{P.S}+[0-9]+\]", "\n")
    t = F.replace(t, F.lit("---CHAPTER BREAK---"), F.lit("\n\n"))
    return squeeze_breaks(strip_lines(squeeze_breaks(t)))


def drop_page_markers(text: Column) -> Column:
    return F.regexp_replace(text, rf"\[PAGE{P.S}+[0-9]+\]", "")


def drop_footnote_marks(text: Column) -> Column:
    """Without raised digits and bracketed numbers; a bracketed number before a capital stays."""
    t = F.regexp_replace(text, "[¹²³⁰⁴-⁹]+", "")
    numbers = rf"\[[0-9]+\](?!{P.S}*[A-Z])"
    return once(t, lambda x: F.when(x.contains("["), F.regexp_replace(x, numbers, "")).otherwise(x))


def clean_extracted(text: Column) -> Column:
    """Repairs of text taken from pages."""
    t = plain_dashes(dehyphenate(text))
    t = F.regexp_replace(t, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}]", "")
    return strip_lines(squeeze_blanks(t))


# Predicates of a line ------------------------------------------------------------------------------------


def is_clean_header(line: Column, author: Author | None = None) -> Column:
    return strip(line).rlike(P.clean_header(author))


def is_page_header(line: Column, author: Author | None = None, series: str | None = None) -> Column:
    s = strip(line)
    return (F.length(s) < 3) | s.rlike(P.page_header(author, series))


def is_toc_line(line: Column) -> Column:
    return strip(line).rlike(P.TOC_LINE)


def is_front_matter(line: Column, publishers: tuple[str, ...] = ()) -> Column:
    return strip(line).rlike(P.front_matter(publishers))


def is_back_heading(line: Column) -> Column:
    return line.rlike(P.BACK_HEADING)


def is_section_to_remove(line: Column, author: Author | None = None) -> Column:
    return (line.rlike(P.SECTION_TO_REMOVE) | line.rlike(P.BY_SOMEBODY)) & ~line.rlike(P.author_content(author))


#: A long line that begins like a sentence, has ten words, a comma or point and is not all capitals; anywhere in a text.
PROSE_LINE = (
    rf"(?dm)^{P.L}*+(?=[A-Z\"'])(?=[^\n]{{79}}[^\n]*[^{P.SPACES}])(?=(?:[^{P.SPACES}]++{P.L}++){{9}}[^{P.SPACES}])(?=[^\n]*[,.])"
    r"(?:(?=[^\n]*\p{Ll})|(?![^\n]*\p{Lu}))"
)


def is_prose_line(line: Column) -> Column:
    return line.rlike(PROSE_LINE)


def count_lines(text: Column, rule: str) -> Column:
    """In how many lines a rule made by ``patterns.by_line`` or ``patterns.whole_line`` holds."""
    return F.regexp_count(text, F.lit(rule))


def without_lines(text: Column, rule: str) -> Column:
    """The text without the lines in which a rule of a whole stripped line holds."""
    inner = rule.removeprefix("(?dm)")
    last = rf"(?dm)(?:\A|\n){inner}\z"
    return where_found(text, rule, lambda t: F.regexp_replace(F.regexp_replace(t, f"(?dm){inner}\n", ""), last, ""))


def is_index_like(paragraph: Column) -> Column:
    """At least ten words, and page references at over 15 in a hundred words."""
    words = F.size(F.split(strip(paragraph), rf"{P.S}+"))
    # most paragraphs have no such reference, and their words need not be counted
    return paragraph.rlike(P.PAGE_REFERENCE) & (words >= 10) & (F.regexp_count(paragraph, F.lit(P.PAGE_REFERENCE)) > words * 0.15)


# Paragraphs and sentences --------------------------------------------------------------------------------


def paragraphs(text: Column) -> Column:
    """Stripped non-empty parts between empty lines."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), rf"\n{P.S}*\n", -1), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts that end in ``.``, ``!`` or ``?`` before a capital or a straight quote; abbreviations and initials do not end one."""
    mark = "\x01"
    t = F.regexp_replace(text, rf"\b({P.ABBREVIATIONS})\.{P.S}+", f"$1{mark} ")
    t = F.regexp_replace(t, rf"\b([A-Z])\.{P.S}+([A-Z])\.{P.S}+", f"$1{mark} $2{mark} ")
    t = F.regexp_replace(t, rf"\b(CW|cw){P.S}+([0-9])", f"$1{mark}$2")
    parts = F.split(t, rf"(?<=[.!?]){P.S}+(?=[A-Z\"'])", -1)
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(mark), F.lit(".")))), lambda s: s != "")


#: Marks of the merger; Unicode keeps these code points out of texts.
_BREAK, _INDENT = "\ufdd0", "\ufdd1"


def merge_lines(rows: Column) -> Column:
    return merge_text(unlines(rows))


def merge_text(text: Column) -> Column:
    """A text's lines put together into paragraphs.

    A paragraph begins after an empty line, at an indented line, at a heading, and at a capital after a line that ends a
    sentence.  Only the line before decides, so a few replacements over the whole text say it, without a fold.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?dm)^(?:   |\t){P.L}*+(?=[^\n])", _INDENT)
    t = strip_lines(t)
    opens = rf"\n{{2,}}(?:{_INDENT})?|\n{_INDENT}|\n(?={P.HEADING_START.replace(r"\A", "")})|(?<=[.!?:\"])\n(?=\p{{Lu}})"
    t = F.replace(F.regexp_replace(t, opens, _BREAK), F.lit("\n"), F.lit(" "))
    t = F.btrim(F.replace(t, F.lit(_INDENT), F.lit("")), F.lit(_BREAK + " "))
    return F.replace(t, F.lit(_BREAK), F.lit("\n\n"))


def count_tokens(text: Column) -> Column:
    """The native token counter: pieces of words and signs (``patterns.TOKEN``), each made one character and counted."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Za-z0-9]+", "a")
    return F.length(F.regexp_replace(t, r"[ \t\n\r\f\x0b]+", ""))


# Labels --------------------------------------------------------------------------------------------------


def chapter_label(kind: Column, number: Column, title: Column) -> Column:
    """``Type number: title``, parts that are empty left out."""
    number, title = F.coalesce(number, F.lit("")), F.coalesce(title, F.lit(""))
    return F.concat(
        kind,
        F.when(number != "", F.concat(F.lit(" "), number)).otherwise(""),
        F.when(title != "", F.concat(F.lit(": "), title)).otherwise(""),
    )


def display_chapter(chapter: Column) -> Column:
    """A short form of a chapter's label; null for none."""
    t = F.regexp_replace(strip(chapter), rf"{P.S}+", " ")
    t = F.regexp_replace(t, rf"(?i)\A(?:chapter|ch\.?|section){P.S}*", "Ch. ")
    t = F.regexp_replace(t, rf"(?i)\A(?:part){P.S}*", "Part ")
    t = F.when(t.rlike(r"\A[0-9]+\z"), F.concat(F.lit("Ch. "), t)).otherwise(t)
    t = F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 57), F.lit("..."))).otherwise(t)
    return F.when(chapter != "", t)


def capital_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_147_483_647))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def work_metadata(
    source_file: Column, titles: list[tuple[int, str, str]] | None = None, publishers: tuple[str, ...] = ()
) -> Column:
    """Struct of title, year and volume from a file's name.

    Title: that of the first entry of ``titles`` (ordinal, key, title) whose key is part of the name; else the second part
    between `` - ``, else the whole name; ``_`` as space; without a tail that begins with a dash and one of ``publishers``.
    With the year, unless it has one.
    """
    name = file_stem(source_file)
    years = F.regexp_extract_all(name, F.lit(r"\(([0-9]{4})\)"), F.lit(1))
    year = F.when(F.size(years) > 0, F.element_at(years, -1))
    volume = F.nullif(F.regexp_extract(name, rf"(?i)Volume{P.S}*([0-9]+)", 1), F.lit(""))
    title = F.regexp_replace(name, rf"\A\([^)]+\){P.S}*", "")
    parts = F.split(title, " - ", -1)
    title = F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(title)
    title = F.translate(title, "_", " ")
    if publishers:
        title = F.regexp_replace(title, rf"(?is){P.S}*-{P.S}*(?:{'|'.join(publishers)}).*\z", "")
    title = F.regexp_replace(title, rf"{P.S}*\([0-9]{{4}}\){P.S}*\z", "")
    title = strip(F.regexp_replace(title, rf"{P.S}+", " "))
    lower = F.lower(name)
    title = F.coalesce(*[F.when(lower.contains(key.lower()), F.lit(known)) for _, key, known in titles or []], title)
    title = F.when(year.isNotNull() & ~title.rlike(r"\([0-9]{4}"), F.concat(title, F.lit(" ("), year, F.lit(")"))).otherwise(title)
    return F.struct(strip(title).alias("title"), year.alias("year"), volume.alias("volume"))
