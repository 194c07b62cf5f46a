"""Removal of front matter, back matter, headers and marks from whole texts.

Rules of lines are matched over the whole text at once (anchored at its lines),
so the work is a narrow map of a few scans: no shuffle, no sort, no array of
lines, and the largest document is the largest unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.patterns import Author
from quillspark.functions.text import (
    PROSE_LINE, count_lines, drop_footnote_marks, is_section_to_remove, lines, normalize_ocr, once, squeeze_blanks, squeeze_breaks,
    strip, strip_lines, unlines, where_found, without_lines,
)

#: Lines after which the search for the beginning is given up.
FRONT_LINES = 1_000
BACK_LINES, BACK_SHARE, BACK_CHARS = 100, 0.85, 500
#: One letter for each line's kind; code points that Unicode keeps out of texts.
_FRONT, _TOC, _PROSE, _OTHER, _EMPTY = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4"
_KINDS = _FRONT + _TOC + _PROSE + _OTHER + _EMPTY


def line_kinds(text: Column, publishers: tuple[str, ...] = ()) -> Column:
    """A letter for each line: front matter, contents, prose, other or empty, of which the first that holds counts."""
    t = where_found(text, f"[{_KINDS}]", lambda x: F.translate(x, _KINDS, "?" * len(_KINDS)))
    # most texts have no front matter, which one search tells
    lines_of = P.whole_line(P.FRONT_START, P.front_anywhere(publishers), P.FRONT_GUARD)
    t = where_found(F.concat(t, F.lit("\n")), P.front_somewhere(publishers), lambda x: F.regexp_replace(x, lines_of, _FRONT))
    for rule, kind in (
        (P.whole_line(P.TOC_LINE, guard=P.TOC_GUARD), _TOC),
        (PROSE_LINE + "[^\n]*$", _PROSE),
        (rf"(?dm)^{P.L}*+$", _EMPTY),
        (rf"(?dm)^[^\n{_KINDS}][^\n]*$", _OTHER),
    ):
        t = F.regexp_replace(t, rule, kind)
    return F.replace(t, F.lit("\n"), F.lit(""))


def content_start(kinds: Column) -> Column:
    """The first line of the text proper: 0 where two prose lines in a row are not found.

    The second of two neighbouring prose lines (empty ones left out) decides; the start is the line before it, or the
    line after the last front matter, whichever is later.
    """
    # the search stops after the first prose or other line beyond the limit
    rest = F.regexp_extract(F.substring(kinds, FRONT_LINES + 2, 2_147_483_647), f"\\A[^{_PROSE}{_OTHER}]*+[{_PROSE}{_OTHER}]?", 0)
    searched = F.concat(F.substring(kinds, 1, FRONT_LINES + 1), rest)
    # up to the second of the two, which is then the last line of what is found
    upto = F.regexp_extract(searched, f"(?s)\\A.*?{_PROSE}{_EMPTY}*+{_PROSE}", 0)
    second = F.length(upto) - 1
    fronts = F.length(F.regexp_extract(upto, f"(?s)\\A.*{_FRONT}", 0))
    return F.when(second < 0, 0).otherwise(F.greatest(fronts, second - 1))


def remove_front_matter(documents: DataFrame, text: str = "text", publishers: tuple[str, ...] = ()) -> DataFrame:
    """The text from its first line proper on; adds nothing to the columns but changes ``text``."""
    df = documents.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_kinds", line_kinds(F.col(text), publishers)).withColumn("_start", content_start(F.col("_kinds")))
    cut = F.call_function("substring_index", F.col(text), F.lit("\n"), F.col("_start") - F.length("_kinds"))
    return df.withColumn(text, F.when(F.col("_start") > 0, cut).otherwise(F.col(text))).drop("_kinds", "_start")


def remove_back_matter(documents: DataFrame, text: str = "text") -> DataFrame:
    """Cut at the last heading of an index or bibliography in the last lines that over 500 characters follow."""
    # only a text that has such a line and is long enough is divided into lines
    n_lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    may = (n_lines >= BACK_LINES) & F.col(text).rlike(P.by_line(P.BACK_HEADING))
    df = documents.withColumn("_lines", F.when(may, lines(F.col(text))))
    n = F.size("_lines")
    first = F.floor(n * BACK_SHARE)
    places = F.filter(
        F.transform("_lines", lambda x, i: F.when((i > first) & x.rlike(P.by_line(P.BACK_HEADING)), i)), lambda i: i.isNotNull()
    )
    df = df.withColumn("_places", places)
    # the characters from a line to the end: the later lines and the breaks between them
    suffix = lambda i: F.length(unlines(F.slice("_lines", i + 1, n - i)))
    df = df.withColumn("_cut", F.array_max(F.filter("_places", lambda i: suffix(i) > BACK_CHARS)))
    kept = F.when(F.col("_cut").isNull(), F.col(text)).otherwise(unlines(F.slice("_lines", 1, F.col("_cut"))))
    return df.withColumn(text, kept).drop("_lines", "_places", "_cut")


def drop_headers(text: Column, author: Author | None = None) -> Column:
    return without_lines(F.coalesce(text, F.lit("")), P.by_line(P.clean_header(author)))


def clean_documents(
    documents: DataFrame, text: str = "text", author: Author | None = None, quotes: bool = False, publishers: tuple[str, ...] = ()
) -> DataFrame:
    """The whole cleaning, in its fixed order. Null texts become empty."""
    df = documents.withColumn(text, normalize_ocr(F.coalesce(F.col(text), F.lit("")), author, quotes))
    df = remove_back_matter(remove_front_matter(df, text, publishers), text)
    t = drop_footnote_marks(drop_headers(F.col(text), author))
    t = squeeze_breaks(strip_lines(squeeze_blanks(squeeze_breaks(t))))
    return df.withColumn(text, strip(t))


def reduction(before: Column, after: Column) -> Column:
    """What is left of a text, in per cent of its length; 0 for an empty one."""
    size = F.length(F.coalesce(before, F.lit("")))
    return F.when(size > 0, 100.0 * F.length(F.coalesce(after, F.lit(""))) / size).otherwise(0.0)


def line_classes(
    documents: DataFrame, key: str = "doc_id", text: str = "text", author: Author | None = None, publishers: tuple[str, ...] = ()
) -> DataFrame:
    """How many lines of each class a text has; a line may be of several."""
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    all_lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    sections = f"(?!{P.by_line(P.author_content(author)).removeprefix('(?dm)')})(?:"
    return rows.select(
        key,
        (all_lines - count_lines(t, rf"(?dm)^{P.L}*+[^\n]")).alias("blank"),
        count_lines(t, P.by_line(P.clean_header(author))).alias("headers"),
        count_lines(t, P.by_line(P.TOC_LINE, P.TOC_GUARD)).alias("toc"),
        count_lines(t, PROSE_LINE).alias("prose"),
        once(
            t,
            lambda x: F.when(
                x.rlike(P.front_somewhere(publishers)), count_lines(x, P.whole_line(P.FRONT_START, P.front_anywhere(publishers), P.FRONT_GUARD))
            ).otherwise(0),
        ).alias("front"),
        count_lines(t, P.by_line(P.BACK_HEADING)).alias("back"),
        count_lines(t, "(?dm)^" + sections + P.by_line(P.any_of(P.SECTION_TO_REMOVE, P.BY_SOMEBODY, ignore_case=False)).removeprefix("(?dm)") + ")").alias("sections"),
    )


def removable_sections(documents: DataFrame, key: str = "doc_id", text: str = "text", author: Author | None = None) -> DataFrame:
    """``key, start_line, end_line, heading``: sections from a removable heading to the next heading that ends it.

    Headings that end a section divide the lines into stretches; each stretch has at most one section, from its first
    removable heading on.
    """
    df = documents.select(F.col(key).alias("key"), lines(F.col(text)).alias("l"))
    # one test of what the rules begin with leaves few lines for the rules themselves
    begins = P.SECTION_BEGINS + (f"|{author.surname}" if author else "")
    marked = F.filter(
        F.transform("l", lambda x, i: F.struct(i.alias("i"), strip(x).alias("s"))), lambda r: r.s.rlike(rf"(?i)\A(?:{begins})")
    )
    flags = F.transform(
        marked,
        lambda r: F.struct(
            r.i.alias("i"), (r.s.rlike(P.SECTION_END) | r.s.rlike(P.author_content(author))).alias("ends"),
            is_section_to_remove(r.s, author).alias("starts"),
        ),
    )
    df = df.withColumn("flags", flags)
    places = lambda which: F.transform(F.filter("flags", lambda r: r[which]), lambda r: r.i)
    df = df.withColumn("ends", places("ends")).withColumn("starts", places("starts"))
    size = F.size("l")
    next_end = lambda i: F.coalesce(F.array_min(F.filter("ends", lambda e: e > i)), size)
    found = F.transform("starts", lambda i: F.struct(i.alias("start_line"), next_end(i).alias("end_line")))
    df = df.withColumn("found", found)
    # of the starts with one end the first is the section
    first = F.filter("found", lambda r, j: (j == 0) | (F.get(F.col("found"), j - 1).end_line != r.end_line))
    out = df.select("key", "l", F.explode(first).alias("r"))
    return out.select(F.col("key").alias(key), "r.start_line", "r.end_line", strip(F.get("l", F.col("r.start_line"))).alias("heading"))
