"""Chapter markers in texts, and the chapter that holds at a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import chapter_label, lines, strip

#: Characters of one stretch of a file in the as-of join.
STRETCH = 65_536


def with_markers(
    documents: DataFrame, text: str = "text", source_file: str = "source_file", memoir_chapters: tuple[str, ...] = ()
) -> DataFrame:
    """``documents`` with ``markers``: char_index, type, number and title of each line that opens a chapter.

    A line opens at most one.
    Numbered headings always count.  Date lines, a memoir's fixed chapter titles and titles in capitals count after the
    first marker, and before it where the file's name says that it is of that kind.  So the first marker's line
    decides, and it is found without a fold.  A narrow map: a document's lines stay one array.
    """
    name = F.lower(F.coalesce(F.col(source_file), F.lit("")))
    memoir = rf"(?i)\A(?:{'|'.join(memoir_chapters)})\z" if memoir_chapters else None
    # what every rule begins with: one scan of the text tells most texts, one match most lines
    begins = rf"\A{P.S}*(?:(?:{P.MARKER_WORDS}){P.S}|[0-9]|(?:{P.MONTHS_CAPITAL}){P.S}|[A-Z][A-Z{P.SPACES}]{{10}}"
    begins += rf"|(?i:{'|'.join(memoir_chapters)}))" if memoir_chapters else ")"
    text_lines = F.transform(lines(F.col(text)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    df = documents.select(
        F.struct(*documents.columns).alias("row"),
        (name.contains("letters") | name.contains("correspondence")).alias("is_letters"),
        (name.contains("memories") & name.contains("dreams")).alias("is_memoir"),
        name.contains("collected works").alias("is_works"),
        F.col(text).alias("text"),
        F.when(F.col(text).rlike(P.by_line(begins)), F.filter(text_lines, lambda r: r.x.rlike(begins))).alias("l"),
    )

    def candidate(r: Column) -> Column:
        s = strip(r.x)
        standard = F.when(s.rlike(P.STANDARD_MARKER), "standard").when(s.rlike(P.SEMINAR_MARKER), "seminar")
        return F.struct(
            r.i.alias("i"), s.alias("s"), standard.alias("standard"), s.rlike(P.LETTER_MARKER).alias("letter"),
            (s.rlike(memoir) if memoir else F.lit(False)).alias("memoir"),
            (s.rlike(P.ESSAY_MARKER) & ~s.rlike(P.ESSAY_EXCLUDED)).alias("essay"),
        )

    df = df.withColumn("rows", F.transform("l", candidate))
    some = F.filter("rows", lambda r: r.standard.isNotNull() | r.letter | r.memoir | r.essay)
    df = df.withColumn("some", some)
    early = F.filter(
        "some",
        lambda r: r.standard.isNotNull()
        | (F.col("is_letters") & r.letter)
        | (F.col("is_memoir") & r.memoir)
        | (F.col("is_works") & r.essay & (F.length(r.s) > 10)),
    )
    df = df.withColumn("first", F.array_min(F.transform(early, lambda r: r.i)))

    def kind(r: Column) -> Column:
        later = r.i > F.col("first")
        return (
            F.when(r.standard.isNotNull(), r.standard)
            .when(r.letter & (later | F.col("is_letters")), "letter")
            .when(r.memoir & (later | F.col("is_memoir")), "memoir")
            .when(r.essay & (later | F.col("is_works")), "essay")
        )

    marked = F.filter("some", lambda r: (r.i >= F.col("first")) & kind(r).isNotNull())
    df = df.withColumn("marked", F.transform(marked, lambda r: F.struct(r.i.alias("i"), r.s.alias("s"), kind(r).alias("k"))))

    def marker(m: Column) -> Column:
        s, k = m.s, m.k
        heading = k.isin("standard", "seminar")
        part = lambda n: F.when(k == "seminar", F.regexp_extract(s, P.SEMINAR_MARKER, n)).otherwise(
            F.regexp_extract(s, P.STANDARD_MARKER, n)
        )
        before = F.when(m.i > 0, F.length(F.call_function("substring_index", F.col("text"), F.lit("\n"), m.i)) + 1).otherwise(0)
        kinds = F.when(heading, F.initcap(part(1))).when(k == "letter", "Letter").when(k == "memoir", "Chapter").otherwise("Essay")
        title = F.when(heading, strip(part(3))).when(k == "essay", F.initcap(s)).otherwise(s)
        return F.struct(
            before.alias("char_index"), kinds.alias("type"), F.when(heading, part(2)).otherwise("").alias("number"), title.alias("title")
        )

    markers = F.transform("marked", marker)
    none = F.array().cast("array<struct<char_index:int,type:string,number:string,title:string>>")
    return df.select("row.*", F.coalesce(markers, none).alias("markers"))


def find_markers(documents: DataFrame, key: str = "id", **options) -> DataFrame:
    """``key, char_index, type, number, title``: one row for each marker."""
    return with_markers(documents, **options).select(key, F.explode("markers").alias("m")).select(key, "m.*")


def chapter_asof(
    positions: DataFrame, markers: DataFrame, key: str = "source_file", at: str = "start_char", stretch: int = STRETCH
) -> DataFrame:
    """``positions`` with ``chapter``: the label of the last marker at or before the position, null where there is none.

    Files are cut into stretches of characters, and rows and markers are ordered within a stretch only, so a file
    with a third of all rows is spread over many tasks.  What holds at a stretch's beginning is carried over a table
    with one row for each stretch.  Of markers at one position the greatest (type, number, title) holds.
    """
    cell = lambda c: F.floor(F.col(c) / stretch)
    own = [c for c in positions.columns]
    rows = positions.withColumn("_cell", cell(at)).withColumn("_row", F.struct(*own))
    marks = markers.where(F.col("char_index").isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col("char_index").alias("_at"),
        cell("char_index").alias("_cell"),
        F.struct("type", "number", "title", chapter_label(F.col("type"), F.col("number"), F.col("title")).alias("label")).alias("_mark"),
    )
    last = marks.groupBy("_key", "_cell").agg(F.max(F.struct("_at", "_mark")).alias("_last"))
    cells = (
        rows.select(F.col(key).alias("_key"), "_cell").where(F.col("_cell").isNotNull()).distinct()
        .join(last, ["_key", "_cell"], "full_outer")
    )
    before = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("_key", "_cell", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    both = (
        rows.select(F.col(key).alias("_key"), "_cell", F.col(at).alias("_at"), F.lit(1).alias("_order"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"), "_row")
        .unionByName(
            marks.select("_key", "_cell", "_at", F.lit(0).alias("_order"), "_mark", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
        )
    )
    upto = Window.partitionBy("_key", "_cell").orderBy("_at", "_order", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_mark", ignorenulls=True).over(upto)).where("_order = 1")
    found = found.join(carried, (found["_key"].eqNullSafe(carried["_key"])) & (found["_cell"] == carried["_cell"]), "left").select(
        "_row.*", F.coalesce(F.col("_in.label"), F.col("_carried._mark.label")).alias("_chapter")
    )
    return found.drop(*(["chapter"] if "chapter" in own else [])).withColumnRenamed("_chapter", "chapter")
