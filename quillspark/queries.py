"""Registered queries of the core: name -> (spark, sf_dir) -> DataFrame, and their SQL.

Every query reads its whole tables.  The SQL is written for the oracle on its own terms
(unnested lines, windows, as-of join, a recursion for the packer), not as a copy of the
expressions.  Patterns are fixed values that both sides share; what each takes and leaves
is said case by case in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import text as T
from quillspark.operators import chapters, chunking, cleaning, indexing, quality, retrieval, tagging
from quillspark.sources import books, html
from quillspark.staging import ship

#: Patterns of publishers' names that the queries take for front matter.
PUBLISHERS = (f"university{P.S}+press", f"some{P.S}+houses{P.S}+press")
#: Whose running heads and prefaces the framed texts have.
AUTHOR = P.Author("Maria", "Stone", "Clara")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


# Pieces of SQL ------------------------------------------------------------------------------------------


def q(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {to if to.startswith('chr(') else q(to)}, 'g')"


def strip(expr: str) -> str:
    return sub(expr, P.STRIP)


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


NL = "chr(10)"


def split(expr: str) -> str:
    return f"string_split(coalesce({expr}, ''), {NL})"


def squeeze(expr: str) -> str:
    return f"regexp_replace({expr}, {q(chr(10) + '{3,}')}, {NL} || {NL}, 'g')"


def strip_lines(expr: str) -> str:
    return f"array_to_string(list_transform(string_split({expr}, {NL}), lambda z: {strip('z')}), {NL})"


def blanks(expr: str) -> str:
    return sub(expr, "[ \t]+", " ")


def dehyphen(expr: str) -> str:
    return sub(expr, rf"([\p{{L}}\p{{N}}_])-{P.S}*\n{P.S}*([\p{{L}}\p{{N}}_])", r"\1\2")


def dashes(expr: str) -> str:
    return f"translate({expr}, '—–', '--')"


def ocr(expr: str, author: bool = False) -> str:
    t = f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = sub(t, rf"(?i)Copyrighted Material{P.S}*")
    if author:
        t = sub(t, rf"(?i)\bS{P.S}+t{P.S}+o{P.S}+n{P.S}+e\b", "Stone")
        t = sub(t, rf"\bM{P.S}*\.{P.S}*C{P.S}*\.", "M.C.")
    t = sub(t, rf"\bM{P.S}*\.{P.S}*D{P.S}*\.", "M.D.")
    t = sub(t, rf"\bP{P.S}*h{P.S}*\.{P.S}*D{P.S}*\.", "Ph.D.")
    for n in (5, 4):
        t = sub(t, r"\b" + rf"{P.S}+".join(["([A-Z])"] * n) + r"\b", "".join(f"\\{i + 1}" for i in range(n)))
    t = blanks(dehyphen(dashes(f"replace({t}, '…', '...')")))
    t = f"regexp_replace({t}, {q(rf'\[PAGE{P.S}+[0-9]+\]')}, {NL}, 'g')"
    t = f"replace({t}, '---CHAPTER BREAK---', {NL} || {NL})"
    return squeeze(strip_lines(squeeze(t)))


def footnotes(expr: str) -> str:
    """The look-ahead said without one: numbers before a capital are hidden while the others go."""
    t = sub(expr, "[¹²³⁴⁵⁶⁷⁸⁹⁰]+")
    t = f"regexp_replace({t}, {q(rf'\[([0-9]+)\]({P.S}*[A-Z])')}, chr(1) || '\\1' || chr(2) || '\\2', 'g')"
    return f"replace(replace({sub(t, '\\[[0-9]+\\]')}, chr(1), '['), chr(2), ']')"


def front_of(source: str) -> str:
    """CTEs that give ``fronted(doc_id, text)`` of ``source(doc_id, text)``."""
    s = strip("x")
    prose = (
        f"length({s}) >= 80 AND {has(s, chr(92) + 'A[A-Z' + chr(34) + chr(39) + ']')} "
        f"AND len(regexp_split_to_array({s}, {q(P.S + '+')})) >= 10 AND {has(s, '[,.]')} AND NOT ({s} = upper({s}) AND {s} <> lower({s}))"
    )
    return f"""
    rows_ AS (SELECT doc_id, i - 1 AS i, ls[i] AS x, len(ls) AS n FROM
        (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {split('text')} AS ls FROM {source}))),
    kinds AS (SELECT doc_id, i, CASE WHEN {has(s, P.front_matter(PUBLISHERS))} THEN 'front' WHEN {has(s, P.TOC_LINE)} THEN 'toc'
        WHEN {prose} THEN 'prose' ELSE 'other' END AS k FROM rows_ WHERE {s} <> ''),
    pairs AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM kinds),
    stops AS (SELECT doc_id, min(i) AS stop FROM kinds WHERE i > {cleaning.FRONT_LINES} AND k IN ('prose', 'other') GROUP BY doc_id),
    seconds AS (SELECT doc_id, min(i) AS second FROM pairs LEFT JOIN stops USING (doc_id)
        WHERE k = 'prose' AND p = 'prose' AND (stop IS NULL OR i <= stop) GROUP BY doc_id),
    starts AS (SELECT s.doc_id, greatest(coalesce(max(k.i) FILTER (k.k = 'front' AND k.i < s.second), -1) + 1, s.second - 1) AS start
        FROM seconds s JOIN kinds k USING (doc_id) GROUP BY s.doc_id, s.second),
    fronted AS (SELECT r.doc_id, coalesce(string_agg(x, {NL} ORDER BY i) FILTER (i >= coalesce(start, 0)), '') AS text
        FROM rows_ r LEFT JOIN starts USING (doc_id) GROUP BY r.doc_id)"""


def back_of(source: str) -> str:
    return f"""
    brows AS (SELECT doc_id, i - 1 AS i, ls[i] AS x, len(ls) AS n FROM
        (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {split('text')} AS ls FROM {source}))),
    tails AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i DESC) - 1 AS tail FROM brows),
    cuts AS (SELECT doc_id, max(i) AS cut FROM tails WHERE n >= {cleaning.BACK_LINES} AND i > floor(n * {cleaning.BACK_SHARE})
        AND tail > {cleaning.BACK_CHARS} AND {has(strip('x'), P.BACK_HEADING)} GROUP BY doc_id),
    backed AS (SELECT b.doc_id, coalesce(string_agg(x, {NL} ORDER BY i) FILTER (cut IS NULL OR i < cut), '') AS text
        FROM brows b LEFT JOIN cuts USING (doc_id) GROUP BY b.doc_id)"""


def without_headers(expr: str, author: P.Author | None = None) -> str:
    return f"array_to_string(list_filter(string_split({expr}, {NL}), lambda y: NOT {has(strip('y'), P.clean_header(author))}), {NL})"


# Texts with what the given ones lack -----------------------------------------------------------------------

#: Before, between and after the given texts: rights and contents, headings of each kind, lines to drop, an index.
FRAME = (
    "Copyright 1950 by the heirs\nSome Houses Press\nTABLE OF CONTENTS\n1. One .... 3\n\nTRANSLATOR'S NOTE\nA word before.\n\nCHAPTER I: The Beginning\n\n",
    "\n\n17\n\nTHE COLLECTED WORKS\nM. C. STONE\n3 May 1931\n\nS T O N E had come - M . C. Stone wrote.\nMARIA STONE\n\nFOREWORD\nNot hers.\n\nPreface by Maria Clara Stone\n\n",
    "\n\nTo Maria Stone\n\nTHE LONG WAY HOME\n\n",
    "\n\n- 18 -\nPart Two\nSeminar 4: Of Water\n\n",
    "\n\nINDEX\n",
)


def framed() -> Column:
    """The text four times between the pieces of the frame: once as it stands, once without empty lines, once doubled into one
    long paragraph, and after an index."""
    t = F.coalesce(F.col("text"), F.lit(""))
    flat = F.replace(t, F.lit("\n"), F.lit(" "))
    dense = F.replace(t, F.lit("\n\n"), F.lit("\n"))
    a, b, c, d, e = map(F.lit, FRAME)
    return F.concat(a, t, b, F.repeat(F.concat(dense, F.lit("\n")), F.lit(8)), c, flat, F.lit(" "), flat, d, t, e, t)


def framed_sql() -> str:
    a, b, c, d, e = (" || chr(10) || ".join(q(x) for x in piece.split("\n")) for piece in FRAME)
    t = "coalesce(text, '')"
    flat = f"replace({t}, {NL}, ' ')"
    return f"({a} || {t} || {b} || repeat(replace({t}, {NL} || {NL}, {NL}) || {NL}, 8) || {c} || {flat} || ' ' || {flat} || {d} || {t} || {e} || {t})"


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", framed().alias("text"))


_FRAMED = f"framed AS (SELECT doc_id, {framed_sql()} AS text FROM documents)"


# Quality ------------------------------------------------------------------------------------------------

_Q = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, t, list_filter(string_split(t, {NL}), lambda x: {strip('x')} <> '') AS v,
    list_filter(string_split(t, {NL} || {NL}), lambda x: {strip('x')} <> '') AS p FROM base),
nums AS (SELECT doc_id, t, length(t) AS chars, len(v) AS n, len(p) AS np,
    list_sum(list_transform(p, lambda x: length(x)))::DOUBLE / nullif(len(p), 0) AS ap,
    len(list_filter(v, lambda x: {has('x', P.QUALITY_TOC)})) AS toc,
    len(list_filter(v, lambda x: {has(strip('x'), chr(92) + 'A[0-9]{1,4}' + chr(92) + 'z')})) AS num,
    regexp_matches(lower(t)[1:2000], 'copyright|isbn|all rights reserved|library of congress') AS front,
    len(list_filter(v, lambda x: length(x) > 60 AND {has('x', '[.!?]')}))::DOUBLE / nullif(len(v), 0) AS prose FROM parts),
scored AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE chars END AS chars, n AS lines, CASE WHEN n = 0 THEN 0 ELSE np END AS paragraphs,
    CASE WHEN n = 0 THEN 0 ELSE floor(ap)::INT END AS avg_para_len,
    CASE WHEN n = 0 THEN ['EMPTY FILE'] ELSE list_filter([
        CASE WHEN n = 1 AND chars > 1000 THEN 'SINGLE LINE (no paragraphs)' END,
        CASE WHEN ap > 5000 THEN 'Paragraphs too long (avg ' || round_even(ap, 0)::BIGINT || ' chars)' END,
        CASE WHEN ap < 50 THEN 'Paragraphs too short (avg ' || round_even(ap, 0)::BIGINT || ' chars)' END,
        CASE WHEN toc > 5 THEN 'TOC remnants (' || toc || ' lines)' END,
        CASE WHEN num > 20 THEN 'Page numbers (' || num || ')' END,
        CASE WHEN front THEN 'Front matter remnants' END,
        CASE WHEN prose < 0.3 THEN 'Low prose ratio (' || round_even(prose * 100, 0)::INT || '%)' END], lambda x: x IS NOT NULL) END AS issues,
    CASE WHEN n = 0 THEN 0 ELSE greatest(0, 100 - CASE WHEN n = 1 AND chars > 1000 THEN 50 ELSE 0 END - CASE WHEN ap > 5000 THEN 20 ELSE 0 END
        - CASE WHEN ap < 50 THEN 10 ELSE 0 END - CASE WHEN toc > 5 THEN 10 ELSE 0 END - CASE WHEN num > 20 THEN 5 ELSE 0 END
        - CASE WHEN front THEN 5 ELSE 0 END - CASE WHEN prose < 0.3 THEN 15 ELSE 0 END) END AS score FROM nums)
"""


@query(_Q + "SELECT doc_id, chars, lines, paragraphs, avg_para_len, array_to_string(issues, '; ') AS issues, score FROM scored")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(_table(spark, sf_dir, "documents"))
    return scores.withColumn("issues", F.array_join("issues", "; "))


@query(_Q + "SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS place, doc_id, score FROM scored")
def quality_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(_table(spark, sf_dir, "documents")).select("doc_id", "score")
    return indexing.numbered(scores, F.desc("score"), F.asc("doc_id"), name="place")


@query(_Q + "SELECT count(*) AS files, coalesce(sum(chars), 0)::BIGINT AS chars, count(*) FILTER (score >= 70) AS good, round(avg(score), 6) AS avg_score FROM scored")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_summary(quality.quality_scores(_table(spark, sf_dir, "documents")))


@query(_Q + "SELECT issue, count(*) AS texts FROM (SELECT regexp_replace(unnest(issues), ' \\(.*', '') AS issue FROM scored) GROUP BY issue")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_counts(quality.quality_scores(_table(spark, sf_dir, "documents")))


# Cleaning -----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {ocr('text')} AS text FROM documents")
def ocr_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize_ocr(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {strip_lines(blanks(sub(dashes(dehyphen('text')), '[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}]')))} AS text FROM documents")
def page_text_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.clean_extracted(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {footnotes('text')} AS text FROM documents")
def footnotes_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.drop_footnote_marks(F.col("text")).alias("text"))


def _count(test: str) -> str:
    return f"len(list_filter(l, lambda x: {test}))"


_SX = strip("x")
_PROSE = (
    f"length({_SX}) >= 80 AND {has(_SX, chr(92) + 'A[A-Z' + chr(34) + chr(39) + ']')} AND len(regexp_split_to_array({_SX}, {q(P.S + '+')})) >= 10 "
    f"AND {has(_SX, '[,.]')} AND NOT ({_SX} = upper({_SX}) AND {_SX} <> lower({_SX}))"
)


def _classes_sql(text: str, author: P.Author | None = None) -> str:
    kept = f"NOT {has(_SX, P.author_content(author))}"
    return f"""SELECT doc_id, {_count(f"{_SX} = ''")} AS blank, {_count(has(_SX, P.clean_header(author)))} AS headers,
    {_count(f"{_SX} <> '' AND {has(_SX, P.TOC_LINE)}")} AS toc, {_count(_PROSE)} AS prose, {_count(has(_SX, P.front_matter(PUBLISHERS)))} AS front,
    {_count(has(_SX, P.BACK_HEADING))} AS back, {_count(f"({has(_SX, P.SECTION_TO_REMOVE)} OR {has(_SX, P.BY_SOMEBODY)}) AND {kept}")} AS sections
    FROM (SELECT doc_id, {split(text)} AS l FROM documents)"""


@query(_classes_sql(framed_sql(), AUTHOR))
def line_classes_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.line_classes(_framed(spark, sf_dir), author=AUTHOR, publishers=PUBLISHERS)


@query(_classes_sql("text"))
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.line_classes(_table(spark, sf_dir, "documents"), publishers=PUBLISHERS)


@query(f"WITH {front_of('documents')} SELECT doc_id, text FROM fronted")
def front_matter_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.remove_front_matter(_table(spark, sf_dir, "documents").select("doc_id", "text"), publishers=PUBLISHERS)


@query(f"WITH {back_of('documents')} SELECT b.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE b.text END AS text FROM backed b JOIN documents d USING (doc_id)")
def back_matter_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.remove_back_matter(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {_FRAMED}, {front_of('framed')} SELECT doc_id, text FROM fronted")
def front_matter_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.remove_front_matter(_framed(spark, sf_dir), publishers=PUBLISHERS)


@query(f"WITH {_FRAMED}, {back_of('framed')} SELECT doc_id, text FROM backed")
def back_matter_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.remove_back_matter(_framed(spark, sf_dir))


@query(f"""WITH {_FRAMED} SELECT doc_id, {without_headers("text", AUTHOR)} AS text FROM framed""")
def headers_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir).select("doc_id", cleaning.drop_headers(F.col("text"), AUTHOR).alias("text"))


@query(f"""SELECT doc_id, {without_headers("coalesce(text, '')")} AS text FROM documents""")
def headers_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", cleaning.drop_headers(F.col("text")).alias("text"))


def _cleaned_sql(text: str, author: P.Author | None = None) -> str:
    return f"""WITH normal AS (SELECT doc_id, {ocr(text, author is not None)} AS text FROM documents), {front_of('normal')}, {back_of('fronted')}
    SELECT doc_id, {strip(squeeze(strip_lines(blanks(squeeze(footnotes(without_headers('text', author)))))))} AS text FROM backed"""


@query(_cleaned_sql("coalesce(text, '')"))
def documents_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), publishers=PUBLISHERS)


@query(_cleaned_sql(framed_sql(), AUTHOR))
def cleaned_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_documents(_framed(spark, sf_dir), author=AUTHOR, publishers=PUBLISHERS)


@query(
    f"""SELECT d.doc_id, length(coalesce(d.text, ''))::INT AS before, length(c.text)::INT AS after,
    round(CASE WHEN d.text <> '' THEN 100.0 * length(c.text) / length(d.text) ELSE 0 END, 6) AS reduction
    FROM documents d JOIN ({_cleaned_sql("coalesce(text, '')")}) c USING (doc_id)"""
)
def cleaning_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("given"), "text")
    cleaned = cleaning.clean_documents(df, publishers=PUBLISHERS)
    percent = F.round(cleaning.reduction(F.col("given"), F.col("text")), 6)
    return cleaned.select("doc_id", F.length("given").alias("before"), F.length("text").alias("after"), percent.alias("reduction"))


def _sections_sql(text: str, author: P.Author | None = None) -> str:
    return f"""WITH l AS (SELECT doc_id, i - 1 AS i, {strip('ls[i]')} AS s, len(ls) AS n FROM
        (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {split(text)} AS ls FROM documents))),
    flags AS (SELECT *, {has('s', P.SECTION_END)} OR {has('s', P.author_content(author))} AS e,
        ({has('s', P.SECTION_TO_REMOVE)} OR {has('s', P.BY_SOMEBODY)}) AND NOT {has('s', P.author_content(author))} AS b FROM l),
    ends AS (SELECT *, min(CASE WHEN e THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM flags)
    SELECT doc_id, i::INT AS start_line, end_line::INT AS end_line, s AS heading FROM (SELECT doc_id, i, s, coalesce(nx, n) AS end_line,
        row_number() OVER (PARTITION BY doc_id, coalesce(nx, n) ORDER BY i) AS r FROM ends WHERE b) WHERE r = 1"""


@query(_sections_sql("text"))
def removable_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.removable_sections(_table(spark, sf_dir, "documents"))


@query(_sections_sql(framed_sql(), AUTHOR))
def sections_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.removable_sections(_framed(spark, sf_dir), author=AUTHOR)


# Paragraphs and sentences -------------------------------------------------------------------------------


@query(
    f"""WITH l AS (SELECT doc_id, i, ls[i] AS x, {strip('ls[i]')} AS s FROM
        (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {split('text')} AS ls FROM documents))),
    b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY i), '') AS before FROM l),
    g AS (SELECT *, sum(CASE WHEN before = '' OR ({has('before', '[.!?:"]' + chr(92) + 'z')} AND {has('s', chr(92) + 'A' + chr(92) + 'p{Lu}')})
        OR {has('x', chr(92) + 'A(?:   |' + chr(92) + 't)')} OR {has('s', P.HEADING_START)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para
        FROM b WHERE s <> ''),
    p AS (SELECT doc_id, para, string_agg(s, ' ' ORDER BY i) AS t FROM g GROUP BY doc_id, para)
    SELECT d.doc_id, coalesce(string_agg(t, {NL} || {NL} ORDER BY para), '') AS text FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id"""
)
def lines_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.merge_text(F.col("text")).alias("text"))


_PARAS = f"""list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {q(chr(92) + 'n' + P.S + '*' + chr(92) + 'n')}), lambda x: {_SX}), lambda x: x <> '')"""


@query(f"SELECT doc_id, (i - 1)::INT AS n, ps[i] AS paragraph FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, {_PARAS} AS ps FROM documents))")
def paragraphs_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents")
    return df.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("n", "paragraph"))


def _sentences_sql(c: str = "text") -> str:
    t = f"regexp_replace({c}, {q(rf'\b({P.ABBREVIATIONS})\.{P.S}+')}, '\\1' || chr(1) || ' ', 'g')"
    t = f"regexp_replace({t}, {q(rf'\b([A-Z])\.{P.S}+([A-Z])\.{P.S}+')}, '\\1' || chr(1) || ' \\2' || chr(1) || ' ', 'g')"
    t = f"regexp_replace({t}, {q(rf'\b(CW|cw){P.S}+([0-9])')}, '\\1' || chr(1) || '\\2', 'g')"
    t = f"""regexp_replace({t}, {q('([.!?])' + P.S + '+([A-Z"' + chr(39) + '])')}, '\\1' || chr(2) || '\\2', 'g')"""
    return f"list_filter(list_transform(string_split({t}, chr(2)), lambda x: {strip('replace(x, chr(1), chr(46))')}), lambda x: x <> '')"


@query(f"SELECT doc_id, (i - 1)::INT AS n, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {_sentences_sql()} AS ss FROM documents WHERE text IS NOT NULL))")
def sentences_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents")
    return df.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


@query(
    f"""SELECT DISTINCT id FROM chunks WHERE len(regexp_split_to_array({strip('text')}, {q(P.S + '+')})) >= 10
    AND len(regexp_extract_all(text, {q(P.PAGE_REFERENCE)})) > 0.15 * len(regexp_split_to_array({strip('text')}, {q(P.S + '+')}))"""
)
def index_like_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "chunks").where(T.is_index_like(F.col("text"))).select("id").distinct()


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {q(P.TOKEN)}))::INT AS tokens, len(string_split(coalesce(text, ''), {NL} || {NL}))::INT AS paragraphs, length(coalesce(text, ''))::INT AS chars FROM documents")
def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return _table(spark, sf_dir, "documents").select(
        "doc_id", T.count_tokens(t).alias("tokens"), F.size(F.split(t, "\n\n", -1)).alias("paragraphs"), F.length(t).alias("chars")
    )


# Titles, chapters, concepts -----------------------------------------------------------------------------


def _title_sql(source: str = "epub_metadata") -> str:
    name = "regexp_replace(source_file, '(.)\\.[^.]*$', '\\1')"
    title = f"regexp_replace({name}, {q(rf'^\([^)]+\){P.S}*')}, '')"
    part = f"CASE WHEN len(string_split({title}, ' - ')) >= 2 THEN string_split({title}, ' - ')[2] ELSE {title} END"
    plain = strip(sub(f"regexp_replace(replace({part}, '_', ' '), {q(rf'{P.S}*\([0-9]{{4}}\){P.S}*$')}, '')", P.S + "+", " "))
    return f"""SELECT source_file, year, volume, CASE WHEN year IS NOT NULL AND NOT regexp_matches(t, '\\([0-9]{{4}}') THEN t || ' (' || year || ')' ELSE t END AS title
    FROM (SELECT source_file, list_last(regexp_extract_all({name}, '\\(([0-9]{{4}})\\)', 1)) AS year,
    nullif(regexp_extract({name}, {q(rf'(?i)Volume{P.S}*([0-9]+)')}, 1), '') AS volume, {plain} AS t FROM {source})"""


@query(_title_sql())
def title_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "epub_metadata").select("source_file", T.work_metadata(F.col("source_file")).alias("m"))
    return df.select("source_file", "m.year", "m.volume", "m.title")


#: Keys of names that have a title of their own, and patterns of publishers that end a name.
TITLES = [(0, "letters to", "The Letters"), (1, " and ", "Of Two Things"), (2, "seminar", "The Seminars")]
TAILS = (f"{P.S}*(?:The|On|Notes)",)


@query(
    f"""WITH n AS (SELECT source_file, 'X - ' || replace(regexp_replace(source_file, '(.)\\.[^.]*$', '\\1'), ' - ', ' -') AS name FROM epub_metadata),
    p AS (SELECT source_file, name, list_last(regexp_extract_all(name, '\\(([0-9]{{4}})\\)', 1)) AS year,
        {strip(sub(f"regexp_replace(regexp_replace(replace(string_split(name, ' - ')[2], '_', ' '), {q(rf'(?is){P.S}*-{P.S}*(?:{TAILS[0]}).*$')}, ''), {q(rf'{P.S}*\([0-9]{{4}}\){P.S}*$')}, '')", P.S + "+", " "))} AS t,
        CASE {" ".join(f"WHEN contains(lower(name), {q(key)}) THEN {q(title)}" for _, key, title in TITLES)} END AS known FROM n)
    SELECT source_file, CASE WHEN year IS NOT NULL AND NOT regexp_matches(coalesce(known, t), '\\([0-9]{{4}}') THEN coalesce(known, t) || ' (' || year || ')' ELSE coalesce(known, t) END AS title FROM p"""
)
def titles_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by a lexicon, and without publishers' tails: the names' own parts after a dash stand in for a publisher."""
    files = _table(spark, sf_dir, "epub_metadata").select("source_file")
    name = F.concat(F.lit("X - "), F.replace(T.file_stem(F.col("source_file")), F.lit(" - "), F.lit(" -")), F.lit(".txt"))
    return files.select("source_file", T.work_metadata(name, TITLES, TAILS).title.alias("title"))


@query(
    """SELECT m.source_file, arg_min(l.concept, l.ordinal) AS title FROM epub_metadata m
    LEFT JOIN lexicon l ON contains(lower(m.source_file), lower(l.concept)) GROUP BY m.source_file"""
)
def lexicon_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = tagging.read_lexicon(_table(spark, sf_dir, "lexicon"), "ordinal", "concept", "concept")
    return _table(spark, sf_dir, "epub_metadata").select("source_file", tagging.lexicon_title(F.col("source_file"), lexicon).alias("title"))


@query(
    # letters beyond ASCII as x: there a word's bound is a matter of ASCII letters only
    r"""WITH c AS (SELECT id, regexp_replace(replace(any_value(text), 'ſ', 's'), '[\x{c0}-\x{24f}]', 'x', 'g') AS text FROM chunks GROUP BY id)
    SELECT c.id, coalesce(string_agg(l.concept, ',' ORDER BY l.ordinal), '') AS concepts FROM c
    LEFT JOIN lexicon l ON regexp_matches(c.text, '(?i)' || l.pattern) GROUP BY c.id"""
)
def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = tagging.read_lexicon(_table(spark, sf_dir, "lexicon"), "ordinal", "concept", "pattern")
    tags = F.array_join(tagging.concept_tags(F.col("text"), lexicon), ",")
    return _table(spark, sf_dir, "chunks").select("id", tags.alias("concepts")).distinct()


@query(
    """WITH c AS (SELECT id, min(source_file) AS source_file, min(chunk_index) AS chunk_index, any_value(concepts) AS concepts FROM chunks GROUP BY id),
    e AS (SELECT source_file, chunk_index, i, concepts[i] AS concept FROM (SELECT *, unnest(range(1, len(concepts) + 1)) AS i FROM c))
    SELECT concept, count(*) AS n FROM e GROUP BY concept ORDER BY n DESC, min((source_file, chunk_index, i)), concept LIMIT 15"""
)
def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "chunks").select("id", "source_file", "chunk_index", "concepts").dropDuplicates(["id"])
    return tagging.top_concepts(chunks)


@query(
    """WITH c AS (SELECT DISTINCT id, lower(text) AS t FROM chunks WHERE text IS NOT NULL),
    r AS (SELECT id, l.concept, row_number() OVER (PARTITION BY id ORDER BY l.ordinal) AS n FROM c JOIN lexicon l ON contains(t, lower(l.concept)) AND length(l.concept) > 4)
    SELECT c.id, coalesce(string_agg(upper(concept[1]) || concept[2:], ',' ORDER BY n), '') AS related FROM c LEFT JOIN r ON c.id = r.id AND n <= 4 GROUP BY c.id"""
)
def related_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = [t for _, t in tagging.read_lexicon(_table(spark, sf_dir, "lexicon"), "ordinal", "concept")]
    chunks = _table(spark, sf_dir, "chunks").where(F.col("text").isNotNull())
    return chunks.select("id", F.array_join(tagging.related_concepts(F.col("text"), terms), ",").alias("related")).distinct()


@query(
    """WITH c AS (SELECT DISTINCT id, source_file, start_char FROM chunks),
    m AS (SELECT source_file, char_index, type || CASE WHEN number <> '' THEN ' ' || number ELSE '' END || CASE WHEN title <> '' THEN ': ' || title ELSE '' END AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY source_file, char_index ORDER BY type DESC, number DESC, title DESC) AS r FROM markers) WHERE r = 1)
    SELECT c.id, c.source_file, c.start_char, m.label AS chapter FROM c ASOF LEFT JOIN m ON c.source_file = m.source_file AND c.start_char >= m.char_index"""
)
def chapter_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = _table(spark, sf_dir, "chunks").select("id", "source_file", "start_char").distinct()
    return chapters.chapter_asof(positions, _table(spark, sf_dir, "markers"))


def _display_sql(c: str) -> str:
    t = sub(strip(c), P.S + "+", " ")
    t = f"regexp_replace({t}, {q(rf'(?i)\A(?:chapter|ch\.?|section){P.S}*')}, 'Ch. ')"
    t = f"regexp_replace({t}, {q(rf'(?i)\A(?:part){P.S}*')}, 'Part ')"
    t = f"CASE WHEN regexp_full_match({t}, '[0-9]+') THEN 'Ch. ' || {t} ELSE {t} END"
    return f"CASE WHEN {c} <> '' THEN CASE WHEN length({t}) > 60 THEN left({t}, 57) || '...' ELSE {t} END END"


@query(f"SELECT DISTINCT id, chapter, {_display_sql('chapter')} AS shown FROM chunks")
def chapter_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "chunks").select("id", "chapter", T.display_chapter(F.col("chapter")).alias("shown")).distinct()


@query(
    f"""WITH c AS (SELECT id, any_value(source_file) AS source_file, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id),
    l AS (SELECT id, lower(source_file) AS f, i, ls[i] AS x, {strip('ls[i]')} AS s FROM
        (SELECT id, source_file, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, source_file, string_split(text, {NL}) AS ls FROM c))),
    o AS (SELECT *, (sum(length(x) + 1) OVER (PARTITION BY id ORDER BY i) - length(x) - 1)::INT AS char_index,
        {has('s', P.STANDARD_MARKER)} AS st, {has('s', P.SEMINAR_MARKER)} AS se, {has('s', P.LETTER_MARKER)} AS le,
        {has('s', P.ESSAY_MARKER)} AND NOT {has('s', P.ESSAY_EXCLUDED)} AS es, contains(f, 'letters') OR contains(f, 'correspondence') AS il,
        contains(f, 'collected works') AS iw FROM l),
    w AS (SELECT *, min(CASE WHEN st OR se OR (il AND le) OR (iw AND es AND length(s) > 10) THEN i END) OVER (PARTITION BY id) AS first FROM o)
    SELECT id, char_index, CASE WHEN st THEN upper(h[1]) || lower(h[2:]) WHEN se THEN 'Seminar' WHEN le AND (il OR i > first) THEN 'Letter' ELSE 'Essay' END AS type,
        CASE WHEN st THEN regexp_extract(s, {q(P.STANDARD_MARKER)}, 2) WHEN se THEN regexp_extract(s, {q(P.SEMINAR_MARKER)}, 2) ELSE '' END AS number,
        CASE WHEN st THEN {strip(f'regexp_extract(s, {q(P.STANDARD_MARKER)}, 3)')} WHEN se THEN {strip(f'regexp_extract(s, {q(P.SEMINAR_MARKER)}, 3)')}
            WHEN le AND (il OR i > first) THEN s ELSE array_to_string(list_transform(string_split(s, ' '), lambda y: upper(y[1]) || lower(y[2:])), ' ') END AS title
    FROM (SELECT *, regexp_extract(s, {q(P.STANDARD_MARKER)}, 1) AS h FROM w)
    WHERE i >= first AND (st OR se OR (le AND (il OR i > first)) OR (es AND (iw OR i > first)))"""
)
def chapter_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "chunks").where(F.col("text").isNotNull()).select("id", "source_file", "text")
    return chapters.find_markers(chunks).distinct()


# Chunks -------------------------------------------------------------------------------------------------


def marks_of(source: str) -> str:
    """CTEs that give ``marks(doc_id, char_index, label)`` of ``source(doc_id, source_file, text)``."""
    return f"""
    mlines AS (SELECT doc_id, lower(source_file) AS f, i, ls[i] AS x, {strip('ls[i]')} AS s FROM
        (SELECT doc_id, source_file, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source_file, string_split(text, {NL}) AS ls FROM {source}))),
    mflags AS (SELECT *, (sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1)::INT AS char_index,
        {has('s', P.STANDARD_MARKER)} AS st, {has('s', P.SEMINAR_MARKER)} AS se, {has('s', P.LETTER_MARKER)} AS le,
        {has('s', P.ESSAY_MARKER)} AND NOT {has('s', P.ESSAY_EXCLUDED)} AS es, contains(f, 'letters') OR contains(f, 'correspondence') AS il,
        contains(f, 'collected works') AS iw FROM mlines),
    mfirst AS (SELECT *, min(CASE WHEN st OR se OR (il AND le) OR (iw AND es AND length(s) > 10) THEN i END) OVER (PARTITION BY doc_id) AS first FROM mflags),
    mparts AS (SELECT doc_id, char_index, CASE WHEN st THEN upper(h[1]) || lower(h[2:]) WHEN se THEN 'Seminar' WHEN le AND (il OR i > first) THEN 'Letter' ELSE 'Essay' END AS type,
        CASE WHEN st THEN regexp_extract(s, {q(P.STANDARD_MARKER)}, 2) WHEN se THEN regexp_extract(s, {q(P.SEMINAR_MARKER)}, 2) ELSE '' END AS number,
        CASE WHEN st THEN {strip(f'regexp_extract(s, {q(P.STANDARD_MARKER)}, 3)')} WHEN se THEN {strip(f'regexp_extract(s, {q(P.SEMINAR_MARKER)}, 3)')}
            WHEN le AND (il OR i > first) THEN s ELSE array_to_string(list_transform(string_split(s, ' '), lambda y: upper(y[1]) || lower(y[2:])), ' ') END AS title
        FROM (SELECT *, regexp_extract(s, {q(P.STANDARD_MARKER)}, 1) AS h FROM mfirst)
        WHERE i >= first AND (st OR se OR (le AND (il OR i > first)) OR (es AND (iw OR i > first)))),
    marks AS (SELECT doc_id, char_index, type || CASE WHEN number <> '' THEN ' ' || number ELSE '' END || CASE WHEN title <> '' THEN ': ' || title ELSE '' END AS label FROM mparts)"""


def packed_of(source: str) -> str:
    """The packer on ``source(doc_id, source_file, text)``: units in their order, the fold as a recursion over them, a step for
    each unit of all texts at once, then the chunks."""
    words = f"len(regexp_split_to_array(s, {q(P.S + '+')}))"
    return f"""{marks_of(source)},
    raw AS (SELECT doc_id, i, ps[i] AS x FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM
        (SELECT doc_id, string_split(regexp_replace(text, {q(chr(92) + 'n' + P.S + '*' + chr(92) + 'n')}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS ps FROM {source}))),
    spots AS (SELECT doc_id, i, {strip('x')} AS s, (sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length({sub('x', '^' + P.S + '+')}))::INT AS start FROM raw),
    paras AS (SELECT *, start + length(s) AS stop, coalesce(lag(start + length(s)) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before,
        len(regexp_extract_all(s, {q(P.TOKEN)})) AS tokens FROM spots WHERE s <> ''),
    held AS (SELECT p.*, m.label FROM (SELECT * FROM paras WHERE NOT ({words} >= 10 AND len(regexp_extract_all(s, {q(P.PAGE_REFERENCE)})) > 0.15 * {words})) p
        ASOF LEFT JOIN marks m ON p.doc_id = m.doc_id AND p.start >= m.char_index),
    said AS (SELECT * EXCLUDE (s), {_sentences_sql('s')} AS ss FROM held),
    parts AS (SELECT doc_id, i, 0 AS j, 0 AS kind, array_to_string(ss, ' ') AS t, tokens, start, stop, before, label FROM said WHERE tokens <= {chunking.MAX_TOKENS}
        UNION ALL SELECT doc_id, i, j, CASE WHEN j = 1 THEN 1 ELSE 2 END, ss[j], len(regexp_extract_all(ss[j], {q(P.TOKEN)})), start, stop, before, label
        FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS j FROM said WHERE tokens > {chunking.MAX_TOKENS})),
    units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM parts),
    fold AS (
        SELECT doc_id, 0::BIGINT AS n, 0 AS g, 0::BIGINT AS total, NULL::VARCHAR AS chapter, 0 AS begun, NULL::INT AS closes FROM {source}
        UNION ALL
        SELECT doc_id, n, CASE WHEN g = 0 THEN 1 WHEN turn OR full_ THEN g + 1 ELSE g END, CASE WHEN turn OR full_ THEN 0 ELSE total END + tokens,
            CASE WHEN turn THEN label ELSE chapter END, CASE WHEN turn OR full_ THEN start ELSE begun END,
            CASE WHEN g > 0 AND turn THEN before WHEN full_ THEN CASE WHEN kind = 2 THEN stop ELSE start END END
        FROM (SELECT *, NOT turn AND g > 0 AND (kind = 1 OR total + tokens > {chunking.TARGET_TOKENS}) AS full_
            FROM (SELECT u.*, f.g, f.total, f.chapter, f.begun, u.kind <> 2 AND u.label IS DISTINCT FROM f.chapter AS turn
                FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.n = f.n + 1))),
    closed AS (SELECT doc_id, g - 1 AS g, closes FROM fold WHERE closes IS NOT NULL),
    made AS (SELECT f.doc_id, f.g, any_value(f.chapter) AS chapter, min(f.begun) AS start_char,
        regexp_replace(string_agg(CASE WHEN u.kind = 2 THEN ' ' ELSE chr(10) || chr(10) END || u.t, '' ORDER BY u.n), '^(?:\\n\\n| )', '') AS text
        FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.n = f.n GROUP BY f.doc_id, f.g),
    ended AS (SELECT m.*, d.source_file, coalesce(c.closes, length(d.text)) AS end_char, len(regexp_extract_all(m.text, {q(P.TOKEN)}))::INT AS token_count
        FROM made m JOIN {source} d ON d.doc_id = m.doc_id LEFT JOIN closed c ON c.doc_id = m.doc_id AND c.g = m.g),
    kept AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks
        FROM ended WHERE g = 1 OR token_count >= {chunking.MIN_TOKENS}),
    keyed AS (SELECT *, substr(md5(source_file || ':' || start_char || ':' || end_char || ':' || chunk_index), 1, 16) AS id FROM kept),
    tagged AS (SELECT k.doc_id, k.chunk_index, string_agg(l.concept, ',' ORDER BY l.ordinal) AS concepts
        FROM keyed k JOIN lexicon l ON regexp_matches(regexp_replace(replace(k.text, 'ſ', 's'), '[\\x{{c0}}-\\x{{24f}}]', 'x', 'g'), '(?i)' || l.pattern) GROUP BY ALL)
    SELECT k.doc_id, k.id, k.text, k.source_file, w.title AS work_title, k.chapter, k.chunk_index, k.total_chunks, k.token_count, length(k.text)::INT AS char_count,
        k.start_char, k.end_char::INT AS end_char, lag(k.id) OVER o AS prev_chunk_id, lead(k.id) OVER o AS next_chunk_id, coalesce(t.concepts, '') AS concepts
    FROM keyed k LEFT JOIN tagged t ON t.doc_id = k.doc_id AND t.chunk_index = k.chunk_index
    LEFT JOIN ({_title_sql(f"(SELECT DISTINCT source_file FROM {source})")}) w ON w.source_file = k.source_file WINDOW o AS (PARTITION BY k.doc_id ORDER BY k.chunk_index)"""


_NAMED = "named AS (SELECT doc_id, coalesce(source_file, doc_id::VARCHAR) AS source_file, coalesce(text, '') AS text FROM documents)"


def _packed(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    lexicon = tagging.read_lexicon(_table(spark, sf_dir, "lexicon"), "ordinal", "concept", "pattern")
    named = _table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source_file", F.col("doc_id").cast("string")).alias("source_file"), text.alias("text")
    )
    return chunking.pack_chunks(named, lexicon=lexicon).withColumn("concepts", F.array_join("concepts", ","))


@query(f"WITH RECURSIVE {_NAMED}, {packed_of('named')}")
def chunks_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, F.col("text"))


@query(
    f"""WITH RECURSIVE named AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Letters of ' WHEN 1 THEN 'Collected Works ' ELSE '' END || doc_id || '.txt' AS source_file,
    {framed_sql()} AS text FROM documents), {packed_of('named')}"""
)
def chunks_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packer on texts with headings, paragraphs over the maximum and files of each kind."""
    lexicon = tagging.read_lexicon(_table(spark, sf_dir, "lexicon"), "ordinal", "concept", "pattern")
    kind = F.element_at(F.array(F.lit("Letters of "), F.lit("Collected Works "), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    named = _table(spark, sf_dir, "documents").select("doc_id", F.concat(kind, F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), framed().alias("text"))
    return chunking.pack_chunks(named, lexicon=lexicon).withColumn("concepts", F.array_join("concepts", ","))


@query(
    """WITH r AS (SELECT DISTINCT id, source_file, chunk_index FROM chunks), t AS (SELECT source_file, count(*)::INT AS total_chunks FROM r GROUP BY source_file)
    SELECT r.id, r.source_file, r.chunk_index, p.id AS prev_chunk_id, n.id AS next_chunk_id, t.total_chunks FROM r
    LEFT JOIN r p ON p.source_file = r.source_file AND p.chunk_index = r.chunk_index - 1
    LEFT JOIN r n ON n.source_file = r.source_file AND n.chunk_index = r.chunk_index + 1 LEFT JOIN t ON t.source_file = r.source_file"""
)
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.neighbour_links(_table(spark, sf_dir, "chunks"))


@query(
    """SELECT source_file, count(*) AS chunks, round(avg(token_count), 6) AS avg_tokens, count(*) FILTER (len(concepts) > 0) AS with_concepts,
    count(*) FILTER (coalesce(chapter, '') <> '') AS with_chapter
    FROM (SELECT DISTINCT ON (id) * FROM chunks ORDER BY id, ingested_at NULLS LAST) GROUP BY source_file"""
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_statistics(_table(spark, sf_dir, "chunks"))


@query(
    """SELECT count(*) AS chunks, count(DISTINCT source_file) AS files, round(avg(token_count), 6) AS avg_tokens,
    count(*) FILTER (len(concepts) > 0) AS with_concepts, count(*) FILTER (coalesce(chapter, '') <> '') AS with_chapter
    FROM (SELECT DISTINCT ON (id) * FROM chunks ORDER BY id, ingested_at NULLS LAST)"""
)
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_totals(_table(spark, sf_dir, "chunks"))


@query("SELECT id, substr(md5(source_file || ':' || start_char || ':' || end_char || ':' || chunk_index), 1, 16) AS made FROM (SELECT DISTINCT id, source_file, start_char, end_char, chunk_index FROM chunks)")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "chunks").select("id", "source_file", "start_char", "end_char", "chunk_index").distinct()
    name = F.concat(*[x for c in ("source_file", "start_char", "end_char", "chunk_index") for x in (F.col(c).cast("string"), F.lit(":"))][:-1])
    return rows.select("id", F.substring(F.md5(name), 1, 16).alias("made"))


def _deliveries(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first load, and the rows that came over a week after the last file began to arrive; rows without a time are of the first."""
    begun = chunks.groupBy("source_file").agg(F.min("ingested_at").alias("begun")).agg(F.max("begun")).first()[0]
    late = F.coalesce(F.col("ingested_at") > F.lit(begun) + F.expr("interval 7 days"), F.lit(False))
    return chunks.where(~late), chunks.where(late)


# Sources: HTML, books and pages made of the given texts ------------------------------------------------------


def _squeezed(expr: str) -> str:
    return strip(sub(expr, P.S + "+", " "))


def _html(paragraphs: Column, before: str = "", after: str = "") -> Column:
    escaped = F.transform(paragraphs, lambda p: F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    body = F.array_join(F.transform(escaped, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")
    return F.concat(F.lit("<html><head><title>x</title></head><body>" + before), body, F.lit(after + "</body></html>"))


@query(
    f"""SELECT doc_id, CASE WHEN len(ps) = 0 THEN 'Head' || {NL} || {NL} || 'Head' ELSE array_to_string(['Head ' || array_to_string(ps, ' '), 'Head'] || ps, {NL} || {NL}) END AS text
    FROM (SELECT doc_id, list_filter(list_transform({_PARAS}, lambda x: {_squeezed('x')}), lambda x: x <> '') AS ps FROM documents)"""
)
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages of HTML: a block that holds others is given with them, navigation and what follows is left out."""
    df = _table(spark, sf_dir, "documents")
    pages = df.select("doc_id", _html(T.paragraphs(F.col("text")), "<nav><p>Contents</p></nav><div><h1>Head</h1>", "</div><footer>Foot</footer>").alias("html"))
    return html.html_texts(pages, "doc_id")


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform({_PARAS}, lambda x: {_squeezed('x')}), lambda x: x <> '') AS ps FROM documents),
    c AS (SELECT doc_id, array_to_string(ps, {NL} || {NL}) AS one, array_to_string(['Chapter two'] || list_reverse(ps), {NL} || {NL}) AS two FROM p)
    SELECT doc_id || '.epub' AS source_file, CASE WHEN length(one) > 100 THEN two || {NL} || {NL} || one ELSE two END AS text FROM c WHERE length(two) > 100"""
)
def book_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of EPUB files, one a document: two chapters of which the spine names the second first, and a page of contents."""
    parts = T.paragraphs(F.col("text"))
    files = books.pack_books(
        _table(spark, sf_dir, "documents").select(
            F.concat(F.col("doc_id").cast("string"), F.lit(".epub")).alias("source_file"),
            F.array(
                F.struct(F.lit("one.xhtml").alias("href"), _html(parts).alias("html")),
                F.struct(F.lit("nav.xhtml").alias("href"), F.lit("<html><body><nav><p>One</p></nav></body></html>").alias("html")),
                F.struct(F.lit("two.xhtml").alias("href"), _html(F.reverse(parts), "<h1>Chapter two</h1>").alias("html")),
            ).alias("items"),
            F.array(F.lit("two.xhtml"), F.lit("one.xhtml")).alias("spine"),
        )
    )
    return books.book_texts(books.epub_items(files))


_PAGE_LINES = f"""list_filter(string_split(coalesce(text, ''), {NL}), lambda x: NOT (length({_SX}) < 3 OR {has(_SX, P.page_header(AUTHOR, 'some series'))}))"""


@query(
    f"""WITH pages AS (SELECT doc_id, array_to_string({_PAGE_LINES} || [''] || ['It ended.', ''], {NL}) AS t FROM documents),
    clean AS (SELECT doc_id, {strip_lines(blanks(sub(dashes(dehyphen('t')), '[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}]')))} AS t FROM pages),
    l AS (SELECT doc_id, i, ls[i] AS x, {strip('ls[i]')} AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(t, {NL}) AS ls FROM clean))),
    b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY i), '') AS before FROM l),
    g AS (SELECT *, sum(CASE WHEN before = '' OR ({has('before', '[.!?:"]' + chr(92) + 'z')} AND {has('s', chr(92) + 'A' + chr(92) + 'p{Lu}')})
        OR {has('s', P.HEADING_START)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM b WHERE s <> ''),
    p AS (SELECT doc_id, para, string_agg(s, ' ' ORDER BY i) AS t FROM g GROUP BY doc_id, para)
    SELECT doc_id, string_agg(t, {NL} || {NL} ORDER BY para) AS text FROM p GROUP BY doc_id"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages of blocks: headers and footers of a page go, pictures are left out, lines become paragraphs."""
    block = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).alias("kind"))
    first = F.array(block(F.coalesce(F.col("text"), F.lit("")), 0), block(F.lit("picture"), 1))
    second = F.array(block(F.lit("THE COLLECTED WORKS\n12\nSome series, vol. 2\nM. C. Stone\nIt ended.\n- 13 -"), 0))
    df = _table(spark, sf_dir, "documents")
    return df.select("doc_id", books.page_text(F.array(first, second), AUTHOR, "some series").alias("text"))


# The vector table ---------------------------------------------------------------------------------------


@query(
    """SELECT id, source_file, chunk_index, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS n FROM chunks) WHERE n = 1"""
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "chunks").select("id", "source_file", "chunk_index", "ingested_at")
    held, incoming = _deliveries(chunks)
    current = indexing.upsert(held.limit(0), held, version="ingested_at")
    return indexing.upsert(current, incoming, version="ingested_at")


@query("SELECT row_number() OVER (ORDER BY ingested_at DESC NULLS LAST, id) AS place, id, ingested_at FROM (SELECT id, max(ingested_at) AS ingested_at FROM chunks GROUP BY id)")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id by its last delivery, the newest first."""
    last = _table(spark, sf_dir, "chunks").groupBy("id").agg(F.max("ingested_at").alias("ingested_at"))
    return indexing.numbered(last, F.desc_nulls_last("ingested_at"), F.asc("id"))


@query(
    """SELECT DISTINCT id, left(text, 8000) AS text, source_file, work_title, chunk_index, total_chunks, left(nullif(chapter, ''), 200) AS chapter, start_char, end_char FROM chunks"""
)
def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.vector_records(_table(spark, sf_dir, "chunks")).select("id", "metadata.*").distinct()


@query(
    """SELECT b AS batch, count(*) AS rows, min(id) AS first_id, max(id) AS last_id FROM
    (SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 50 + 1)::INT AS b FROM (SELECT DISTINCT id FROM vectors)) GROUP BY b"""
)
def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "vectors").select("id").distinct()
    return indexing.batch_sizes(indexing.numbered_batches(ids))


@query("SELECT coalesce(len(\"values\"), -1)::INT AS dimension, count(DISTINCT id) AS vectors FROM vectors GROUP BY 1")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.index_statistics(_table(spark, sf_dir, "vectors"))


# Retrieval ----------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS score,
    (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id))::INT AS rank FROM e a, e b WHERE a.vec_id % 50 = 0) WHERE rank <= 6"""
)
def top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % 50 == 0)
    dim = 64
    hits = retrieval.top_similar(asked, rows, dim, query_id="vec_id", query_values="embedding", row_id="vec_id", row_values="embedding")
    return hits.withColumn("score", F.round("score", 6))


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (ids that are divisible by 50, read as hexadecimal numbers) and their relevant hits with their fields."""
    rows = _table(spark, sf_dir, "vectors").where(F.size("values") == 128)
    once = rows.groupBy("id").agg(F.first("values").alias("values"))
    # an id of 16 digits is high * 2^32 + low, and 2^32 leaves 46 when divided by 50
    half = lambda at: F.conv(F.substring("id", at, 8), 16, 10).cast("long") % 50
    asked = once.where((46 * half(1) + half(9)) % 50 == 0).withColumnRenamed("id", "query_id")
    hits = retrieval.relevant(retrieval.top_similar(asked, once, 128))
    fields = rows.select("id", "metadata.work_title", "metadata.chapter", "metadata.text").dropDuplicates(["id"])
    return asked, retrieval.hit_fields(hits.join(fields, "id"))


_HITS = f"""WITH v AS (SELECT id, any_value("values")::DOUBLE[] AS v, any_value(metadata) AS m FROM vectors WHERE len("values") = 128 AND list_sum(list_transform("values", lambda x: abs(x))) > 0 GROUP BY id),
a AS (SELECT id AS query_id, v FROM v WHERE ('0x' || id)::UBIGINT % 50 = 0),
s AS (SELECT query_id, id, m, list_cosine_similarity(a.v, v.v) AS score FROM a, v),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s),
h AS (SELECT query_id, id, rank, score, coalesce(nullif(m.work_title, ''), 'Unknown') AS work_title, nullif(m.chapter, '') AS chapter, coalesce(m.text, '') AS text FROM r WHERE rank <= 3 AND score > 0.7)
"""


@query(_HITS + "SELECT query_id, rank, id, round(score, 6) AS score, work_title, chapter FROM h")
def relevant_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "work_title", "chapter")


@query(
    _HITS
    + f"""SELECT query_id, rank, '[' || rank || '] ' || work_title || CASE WHEN chapter IS NOT NULL THEN ' — ' || shown ELSE '' END AS line
    FROM (SELECT *, {_display_sql('chapter')} AS shown FROM h)"""
)
def hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir)
    return hits.select("query_id", "rank", retrieval.hit_line(F.col("rank"), F.col("work_title"), F.col("chapter")).alias("line"))


_CITE = "'[' || rank || '] ' || work_title || CASE WHEN chapter IS NOT NULL THEN ', ' || chapter ELSE '' END"


@query(
    _HITS
    + f"""SELECT query_id, hits, context, citations, {q(retrieval.RULES + chr(10) + chr(10))} || CASE WHEN hits > 0 THEN 'Sources:' || chr(10) || context ELSE {q(retrieval.NO_SOURCES)} END AS system
    FROM (SELECT a.query_id, count(h.rank)::INT AS hits, coalesce(string_agg({_CITE} || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '') AS context,
    coalesce(string_agg({_CITE}, chr(10) ORDER BY rank), '') AS citations FROM a LEFT JOIN h USING (query_id) GROUP BY a.query_id)"""
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    return retrieval.prompts(hits, asked)
