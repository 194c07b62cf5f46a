"""Concept tags by a lexicon of patterns, and titles by a lexicon of names."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import capital_first, file_stem

#: Entries of a lexicon read to the driver as a parameter; more are an error, not a cut.
MOST_ENTRIES = 10_000


def read_lexicon(lexicon: DataFrame, *columns: str) -> list[tuple]:
    rows = lexicon.select(*columns).orderBy(columns[0]).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a lexicon has at most {MOST_ENTRIES} entries")
    return [tuple(r) for r in rows]


#: What the letters of an ASCII pattern also match when case is folded, beside their own other case.
_FOLDED = ("ſKıİ", "skii")


#: A word with an optional end, or words to choose from, with or without bounds.
_WORDS = re.compile(r"(?:\\b)?(?:([a-z]+?)(?:[a-z]\?|\([a-z|]*\)\?)?|\((?:\?:)?([a-z]+(?:\|[a-z]+)*)\))(?:\\b)?")


def needed(pattern: str) -> list[str]:
    """Words of which a text that the pattern matches contains at least one; none where that is not plain to see."""
    m = _WORDS.fullmatch(pattern)
    return [] if m is None else [m.group(1)] if m.group(1) else m.group(2).split("|")


def concept_tags(text: Column, lexicon: list[tuple[int, str, str]]) -> Column:
    """Concepts whose pattern occurs in any case, in the lexicon's order; each pattern is a literal, compiled once.

    A pattern of lower-case ASCII without escapes that a capital names is looked for in the lower-cased text, which is
    made once: a search without folding is several times as fast and finds the same.
    """
    none = F.array().cast("array<string>")
    if not lexicon:
        return none

    def found(lower: Column, pattern: str) -> Column:
        plain = pattern.isascii() and pattern == pattern.lower() and "(?" not in pattern
        if not plain:
            return text.rlike(f"(?iu){pattern}")
        # plain searches for its words tell most texts before the pattern is tried
        contained = [lower.contains(w) for w in needed(pattern)]
        return reduce(or_, contained) & lower.rlike(pattern) if contained else lower.rlike(pattern)

    # the lambda's variable holds the lower-cased text for all patterns
    once = F.array(F.lower(F.translate(text, *_FOLDED)))
    tags = F.transform(once, lambda t: F.array(*[F.when(found(t, pattern), F.lit(name)) for _, name, pattern in lexicon]))
    tags = F.filter(F.flatten(tags), lambda x: x.isNotNull())
    return F.when(text.isNull(), none).otherwise(F.array_distinct(tags))


def top_concepts(chunks: DataFrame, concepts: str = "concepts", order: tuple[str, ...] = ("source_file", "chunk_index"), k: int = 15) -> DataFrame:
    """``concept, n``: the k most frequent; ties by the first place where they occur."""
    rows = chunks.select(F.struct(*order).alias("place"), F.posexplode(concepts).alias("p", "concept"))
    counted = rows.groupBy("concept").agg(F.count("*").alias("n"), F.min(F.struct("place", "p")).alias("first"))
    return counted.orderBy(F.desc("n"), "first", "concept").limit(k).select("concept", "n")


def lexicon_title(source_file: Column, lexicon: list[tuple[int, str, str]]) -> Column:
    """The title of the first entry whose key is part of the file's name, in any case; null where there is none."""
    name = F.lower(file_stem(source_file))
    return F.coalesce(*[F.when(name.contains(key.lower()), F.lit(title)) for _, key, title in lexicon], F.lit(None).cast("string"))


def related_concepts(text: Column, terms: list[str], k: int = 4, shortest: int = 5) -> Column:
    """Up to k terms of at least five letters that the text contains, in the list's order, with a capital."""
    lower = F.lower(text)
    found = [F.when(lower.contains(t.lower()), capital_first(F.lit(t))) for t in terms if len(t) >= shortest]
    if not found:
        return F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())), 1, k)
