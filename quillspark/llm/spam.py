"""Pages of repeated keywords, links or product tags.

Three streams of a page's symbols are each made into a suffix automaton: its
words and signs as they stand, its content words alone, and its shape, in which
a run of content words is one symbol, numbers are another and the words of
clauses, signs and line ends stay.  The suffix link of a position's state gives
the longest sequence ending there that occurs elsewhere on the page; the union
of these maximal repeats is the page's covered part.  Keywords repeat by the
word, also where they are dressed as sentences; lists of links or tags repeat
by their shape however different their words.

A page is cut into lines and long lines into sentences.  A piece counts as spam
by its covered characters where it lacks the structure of a clause: the common
and function words that every clause of prose has, or a content word without a
capital.  Covered characters also count where a piece's content words come
again and again; links and tags add a little.  ``WEIGHTS`` started from a
logistic regression on 116,000 pieces of 10,000 pages, labelled by an earlier
form of this operator, and were set by reading the pages on which both differ.  Pieces built
as references (contents, indexes, bibliographies) are not spam however much
they repeat.

Results: a page is found when over half of its visible characters stand in such
pieces, at any length.  Null, empty and blank texts are never found.  A
repeated key counts once; extra columns are left out.  Pages of over
``LONG_PAGE`` symbols get the same covered part by counting sequences of the
least length in arrays, in less memory.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.quality import FUNCTION_WORDS

TOKEN = re.compile(r"\w+|[^\w\s]|\n")
SENTENCE = re.compile(r"(?<=[.!?])[\"”»]?\s+(?=[^\W\d_a-zäöüß]|[\"“„«])")
LINK = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)\S+")
TAG = re.compile(r"#\w+")
#: Signs between link texts.
BAR = re.compile(r" [|·•»›] ")
DIGIT, YEAR = re.compile(r"\d"), re.compile(r"\b1[5-9]\d\d\b")
LEADER = re.compile(r"(?:\.[ .]{3,}|…{2,}|_{4,})\s*(?:\d+|[ivxlc]+)\s*$", re.M)
REFERENCE = re.compile(r", \d{1,4}(?:[-–]\d{1,4})?(?=[,;\s]|$)")
#: ``Name, X.`` ... ``Place: House, year`` as bibliographies have it.
ENTRY = re.compile(r"[^\W\d_]+, (?:[^\W\d_]\.[ -]?)+ [^\n]{3,160}?(?:: [^\n:]{2,60}|, )\b1[5-9]\d\d\b")
LONG_LINE = 300
#: Symbols that a repeat must have at least: of words and signs, and of content words.
LEAST_REPEAT, LEAST_CONTENT = 3, 2
#: Of shapes, by chance of repeating: fewer on pages of fewer symbols.
LEAST_SHAPE = (3, 5)
#: Symbols of a page from which on arrays are used.
LONG_PAGE = 200_000
#: A clause has at least this share of common and function words.
CLAUSE_SHARE = 0.4
#: Of covered words without a clause, covered shape without a clause, links and tags, covered words that come again, covered
#: shape between signs without a clause.
WEIGHTS = (3.5, 4.2, 3.2, 10.0, 6.0)
BIAS = -2.0


def repeated(symbols: Sequence, least: int = LEAST_REPEAT) -> np.ndarray:
    """For each symbol whether it stands in a maximal repeat of at least ``least`` symbols, by a suffix automaton."""
    n = len(symbols)
    if n <= least:
        return np.zeros(n, dtype=bool)
    if n > LONG_PAGE:
        return repeated_long(symbols, least)
    edges: list[dict] = [{}] + [{} for _ in range(n)]
    # states 1 to n are the prefixes, clones follow
    link, length = [-1] + [0] * n, list(range(n + 1))
    last = 0
    for state, symbol in enumerate(symbols, 1):
        p = last
        last = state
        while p >= 0:
            out = edges[p]
            if symbol in out:
                break
            out[symbol] = state
            p = link[p]
        else:
            continue
        q = out[symbol]
        if length[p] + 1 == length[q]:
            link[state] = q
            continue
        clone = len(edges)
        edges.append(edges[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and edges[p].get(symbol) == q:
            edges[p][symbol] = clone
            p = link[p]
        link[q] = link[state] = clone
    links, lengths, at = np.array(link), np.array(length), np.arange(1, n + 1)
    # a state to which another links has more than one end position
    shared = np.zeros(len(links), dtype=bool)
    shared[links[1:]] = True
    run = np.where(shared[at], lengths[at], lengths[links[at]])
    last_at = np.flatnonzero(run >= least)
    return _covered(last_at - run[last_at] + 1, last_at + 1, n)


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_long(symbols: Sequence, least: int) -> np.ndarray:
    """The same: a symbol stands in such a repeat if and only if it is in a sequence of ``least`` symbols that comes twice."""
    n = len(symbols)
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(s, len(ids)) for s in symbols), np.int64, n)
    windows = codes[: n - least + 1].copy()
    for k in range(1, least):
        # the codes of shorter sequences and one symbol more, numbered anew
        windows = np.unique(windows * len(ids) + codes[k : n - least + 1 + k], return_inverse=True)[1].ravel()
    starts = np.flatnonzero(np.bincount(windows)[windows] > 1)
    return _covered(starts, starts + least, n)


def pieces(text: str) -> list[tuple[int, int]]:
    """Start and end of each line, and of each sentence of long lines."""
    out, at = [], 0
    for line in text.split("\n"):
        if len(line) > LONG_LINE:
            start = at
            for cut in SENTENCE.finditer(line):
                out.append((start, at + cut.end()))
                start = at + cut.end()
            out.append((start, at + len(line)))
        elif line.strip():
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def is_reference(part: str, words: int) -> bool:
    return DIGIT.search(part) is not None and bool(
        LEADER.search(part)
        or len(REFERENCE.findall(part)) * 3 >= max(words, 1)
        or (YEAR.search(part) is not None and len(ENTRY.findall(part)) * 110 >= len(part))
    )


class Page:
    """A page's symbols and pieces; coverage is found when it is asked for."""

    def __init__(self, text: str, common: frozenset[str]):
        spans = [m.span() for m in TOKEN.finditer(text)]
        self.raw = [text[s:e] for s, e in spans]
        self.symbols = [x.lower() for x in self.raw]
        self.content = [x[0].isalpha() and x not in common and x not in FUNCTION_WORDS for x in self.symbols]
        starts = [s for s, _ in spans]
        self.sizes = np.array([0 if x == "\n" else len(x) for x in self.raw], np.int64)
        total = np.concatenate([[0], np.cumsum(self.sizes)]).tolist()
        #: Of each piece: its first symbol and the one after its last, visible characters, lack of a clause, share of links
        #: and tags, how much its content words come again, how much it is parted by signs, whether it is a reference.
        self.pieces: list[tuple] = []
        for s, e in pieces(text):
            i, j = bisect_left(starts, s), bisect_left(starts, e)
            if total[j] > total[i]:
                self.pieces.append((i, j, total[j] - total[i], *self._features(text[s:e], i, j)))

    def _features(self, part: str, i: int, j: int) -> tuple[float, float, float, float, bool]:
        counts = Counter([x for x in self.symbols[i:j] if x[0].isalpha()])
        held = Counter([x for x, c in zip(self.symbols[i:j], self.content[i:j]) if c])
        n, content = counts.total(), held.total()
        # a function word counts at most twice, or once in twelve words: a list of places with one preposition is no clause
        most = max(2, n // 12)
        clause = sum([min(c, most) for w, c in counts.items() if w not in held]) / max(n, 1)
        missing = max(0.0, 1.0 - clause / CLAUSE_SHARE)
        if content and missing < 1.0 and not any([c and x[0].islower() for x, c in zip(self.raw[i:j], self.content[i:j])]):
            # a title: all content words have capitals
            missing = max(missing, min(1.0, 2.0 - clause * 2.0 / 0.6))
        linked = 0.0
        if "://" in part or "](" in part or "href" in part or "www." in part:
            linked = sum(map(len, LINK.findall(part))) / len(part)
        if "#" in part:
            linked += sum(map(len, TAG.findall(part))) / len(part)
        again = max(0.0, (content - len(held)) / content - 0.2) if content > 3 else 0.0
        bars = len(BAR.findall(part))
        return missing, min(1.0, linked), again, min(1.0, 4.0 * bars / max(n, 1)) if bars > 2 else 0.0, is_reference(part, n)

    def coverage(self) -> tuple[list[float], list[float]]:
        """Of each piece: the share of its characters in repeats of words, and of its content words in repeats of shapes."""
        content = np.array(self.content, dtype=bool)
        words = repeated(self.symbols)
        inner = np.flatnonzero(content)
        words[inner] |= repeated([self.symbols[k] for k in inner.tolist()], LEAST_CONTENT)
        shape: list[str] = []
        group = []
        for raw, symbol, held in zip(self.raw, self.symbols, self.content):
            kind = ("W" if raw[0].isupper() else "w") if held else "9" if symbol[0].isdigit() else symbol
            # a run of content words is one symbol
            if not (held and shape and shape[-1] in "Ww" and group):
                shape.append(kind)
            group.append(len(shape) - 1)
        low, high = LEAST_SHAPE
        shaped = repeated(shape, max(low, min(high, len(shape).bit_length())))[group] if group else content
        total, covered, all_content, in_shape = (
            np.concatenate([[0], np.cumsum(x)]).tolist()
            for x in (self.sizes, self.sizes * words, self.sizes * content, self.sizes * (content & shaped))
        )
        first = [(covered[p[1]] - covered[p[0]]) / (total[p[1]] - total[p[0]]) for p in self.pieces]
        return first, [(in_shape[p[1]] - in_shape[p[0]]) / max(1, all_content[p[1]] - all_content[p[0]]) for p in self.pieces]


def piece_weight(piece: tuple, words: float, shape: float) -> float:
    """Over 0: a piece of keywords, links or tags, seen alone."""
    missing, linked, again, bars, reference = piece[3:]
    if reference:
        return -2.0
    a, b, c, d, e = WEIGHTS
    return a * words * missing + b * shape * missing + c * linked + d * words * again + e * bars * shape * missing + BIAS


def spam_weights(sizes: list[int], own: list[float]) -> list[float]:
    """The pieces' weights, each with a part of its neighbours': spam comes in runs, and short pieces say little."""
    own = [max(-3.0, min(3.0, w)) for w in own]
    sizes = [min(x, 200) for x in sizes]
    out = []
    for i, w in enumerate(own):
        weight, total = w * sizes[i], float(sizes[i])
        for k in (i - 2, i - 1, i + 1, i + 2):
            if 0 <= k < len(own):
                weight += 0.4 * own[k] * sizes[k]
                total += 0.4 * sizes[k]
        out.append(weight / total)
    return out


def _share(sizes: list[int], own: list[float]) -> float:
    # where a page has pieces that are spam by themselves, the weaker ones (over -1, which prose hardly reaches) count too
    weights = spam_weights(sizes, own)
    least = -1.0 if max(weights) > 0 else 0.0
    return sum([s for s, w in zip(sizes, weights) if w > least]) / sum(sizes)


def spam_share(text: str | None, common: frozenset[str], share: float = 0.0) -> float:
    """The share of the page's visible characters in spam pieces; 0 where it is at most ``share``.

    Weights only rise with coverage, so a page that would not pass with all characters covered needs no automaton.
    """
    if text is None or not text.strip():
        return 0.0
    page = Page(text, common)
    if not page.pieces:
        return 0.0
    sizes = [p[2] for p in page.pieces]
    if _share(sizes, [piece_weight(p, 1.0, 1.0) for p in page.pieces]) <= share:
        return 0.0
    found = _share(sizes, [piece_weight(p, w, x) for p, w, x in zip(page.pieces, *page.coverage())])
    return found if found > share else 0.0


def spam_pages(
    documents: DataFrame, common: frozenset[str], id_col: str = "doc_id", text: str = "text", share: float = 0.5
) -> DataFrame:
    """``id, spam_share`` of pages over the share; a map over Arrow batches, then one row a key."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shares = np.array([spam_share(t, common, share) for t in pdf["_text"]])
            found = shares > share
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy()[found], "spam_share": shares[found]})

    rows = documents.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    found = rows.mapInPandas(run, f"_id {kind}, spam_share double")
    return found.groupBy(F.col("_id").alias(id_col)).agg(F.max("spam_share").alias("spam_share"))
