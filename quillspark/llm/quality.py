"""Statistics that tell prose from lists, tables and junk.

A text is cut into blocks at empty lines.  A block's layout is read from its
rows, which are its lines or, in a block of one or two lines, the items between
its signs: do the same delimiters stand at the same places of every row
(vertical alignment), do indents come again at a fixed distance, are the
lengths of rows like those a few rows before (autocorrelation), and are the
rows short and without an end.  With the share of unusual signs and of rare
letters (junk, encoded text) and against the share of common words (clauses)
they give the block a score; blocks over 0 are lists, tables or junk and count
with all their characters.  A block without common words, but with neither such
a layout nor such letters, is prose: a heading, a name, a short note.

The weights were fitted by ``fit_weights`` on the blocks of 20,000 chunks,
labelled by an earlier set of rules and checked by reading; no block there is
indented, so the period's weight is a guess.

Results: null, empty and blank texts have zero counts and are never found.  A
missing, zero or wrong ``char_count`` is reported by ``char_count_gap`` (null
where it is missing) and never used for ratios, which count the text itself.
Rows are neither dropped nor merged, unless ``once`` is asked for: then an id
delivered again has one row, of differing texts the one with the greatest
numbers.  Extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent determiners and connectives beside the given table of common words.
FUNCTION_WORDS = frozenset(
    "each every such both any some these those my your me him them us upon beyond through within without under "
    "beneath before behind between against until unless whereas although while because since then after always "
    "cet cette ces leur leurs son sa ses mon ma mes notre votre dont où comme tandis parce pendant toujours souvent "
    "dieser diese dieses ihr ihre sein seine mein meine zwischen auch immer oft wo da durch gegen über unter vor".split()
)

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
#: Between a row's cells.
CELLS = re.compile(r"\t| {2,}")
#: Where items of a list that stands on one line end: after a sign of a list, or between a number and a word.
ITEM_ENDS = (re.compile(r"(?<=[;•·‣◦▪])\s+"), re.compile(r"(?<=\d)\s+(?=[^\W\d_])"))
LEAST_ITEMS, ITEM_CHARS = 4, 70
#: What tokens of such items end with.
LIST_SIGNS = frozenset(";•·‣◦▪")
#: A row's places that are compared: from its start, and from its end.
PLACES = (0, 1, 2, 3, 4, -1, -2)
#: Signs at a row's end that say nothing of a list.
ROW_ENDS = frozenset(".!?,;:\"”»…")
CLOSED = tuple(".!?,;:\"”»’)—-")
SHORT_ROW = 60
STRANGE = re.compile(r"[^\w\s.,;:!?'\"()\[\]‘’“”„«»‹›—–‐\-…\xad\xa0¬]")
#: Letter-spaced headings, as ``T H E   W A T E R``.
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ ]+){4,}[^\W\d_](?!\w)")
#: Letters that make up about four fifths of English, German and French texts.
FREQUENT_LETTERS = "etaoinsrhdlu"
LETTERS_SHARE, LEAST_LETTERS = 0.74, 30
#: Prose in the corpus' languages has well over a third of common and function words; under this share there is no clause.
CLAUSE_SHARE = 0.15
SENTENCE_END = tuple(".!?…”\"'»’:;)")

#: Of alignment, indent period, length autocorrelation, short open rows, unusual signs, rare letters, clause words; and the bias.
WEIGHTS = (6.5, 0.5, 1.5, 2.5, 2.7, 4.8, -4.6)
BIAS = -1.0
#: The most that the layout can add, from each feature on in the order in which they are made.
MOST_LAYOUT, MOST_ALIGNED, MOST_PERIODS = sum(WEIGHTS[:4]), sum(WEIGHTS[:3]), WEIGHTS[1] + WEIGHTS[2]


def rows_of(lines: list[str]) -> tuple[list[str], bool]:
    """A block's rows, and whether they are items of a list that stands on one or two lines."""
    if len(lines) > 2:
        return lines, False
    text = " ".join(lines)
    items = max(([x for x in cut.split(text) if x.strip()] for cut in ITEM_ENDS), key=len)
    return (items, True) if len(items) > LEAST_ITEMS and len(text) < ITEM_CHARS * len(items) else (lines, False)


def _place(part: str) -> str | None:
    """A number, the sign at a part's end or start, or None for a word."""
    if part.isalpha():
        return None
    first, last = part[0], part[-1]
    if last.isdigit() or first.isdigit():
        return "9"
    if last.isalpha():
        return None if first.isalpha() else first
    return "…" if len(part) > 3 and part == last * len(part) else last


def _parts(row: str) -> list[str]:
    """What stands at ``PLACES`` of a row's parts between spaces, with a bar between cells; a letter where there is nothing."""
    if "\t" in row or "  " in row:
        row = CELLS.sub(" | ", row)
    found = row.split(None, 5)
    n = len(found)
    if n == 6:
        tail = found.pop().rsplit(None, 2)
        found += (tail[-1], tail[-2] if len(tail) > 1 else found[4])
        return found
    return [*found, *["a"] * (5 - n), found[n - 1] if n > 1 else "a", found[n - 2] if n > 2 else "a"]


def alignment(rows: list[str], items: bool = False) -> float:
    """How many places have the same delimiter or number in most rows; 1 for two such places in all rows."""
    if len(rows) < 2 or len(rows) < 3 and items:
        return 0.0
    total = 0.0
    for k, column in enumerate(zip(*[_parts(x.strip()) for x in rows])):
        if 2 * sum(map(str.isalpha, column)) >= len(rows):
            # words in half of the rows: no sign is in more
            continue
        counts = Counter(map(_place, column))
        del counts[None]
        if PLACES[k] == -1 and not items:
            for sign in ROW_ENDS & counts.keys():
                del counts[sign]
        if counts:
            total += max(0.0, max(counts.values()) / len(rows) - 0.5)
    # two rows agree by chance more easily
    return min(1.0, total) if len(rows) > 2 else min(1.0, total / 2) * (total >= 1.5)


def _best_autocorrelation(values: np.ndarray, most: int = 6) -> float:
    """The largest autocorrelation at a distance of 1 to ``most``; 0 for short or constant series."""
    if len(values) < 6:
        return 0.0
    v = values - values.mean()
    total = float(v @ v)
    if total == 0:
        return 0.0
    return max(0.0, *(float(v[d:] @ v[:-d]) / total for d in range(1, min(most, len(v) - 3) + 1)))


def periods(rows: list[str]) -> tuple[float, float]:
    """Indentation periodicity and row-length autocorrelation."""
    indents = np.array([len(x) - len(x.lstrip()) for x in rows], dtype=float)
    lengths = np.array([len(x) for x in rows], dtype=float)
    return _best_autocorrelation(indents), _best_autocorrelation(lengths)


def open_rows(rows: list[str], items: bool = False) -> float:
    """The share of short rows that do not end as a sentence or verse does."""
    if len(rows) < 3:
        return 0.0
    stripped = [x.strip() for x in rows]
    return sum([len(x) < SHORT_ROW and (items or not x.endswith(CLOSED)) for x in stripped]) / len(rows)


def layout(lines: list[str]) -> tuple[float, float, float, float]:
    """Delimiter alignment, indentation periodicity, row-length autocorrelation and short open rows of a block's lines."""
    rows, items = rows_of(lines)
    return (alignment(rows, items), *periods(rows), open_rows(rows, items))


def letter_features(block: str, words: list[str], known: float) -> tuple[float, float, float]:
    """Shares of unusual signs and of rare letters beyond what texts have, and of clause words; each about 0 to 1."""
    joined = "".join(words)
    return _shares(len(block), len(STRANGE.findall(block)), len(joined), sum(map(joined.count, FREQUENT_LETTERS)), known)


def _shares(size: int, strange: int, count: int, frequent: int, known: float) -> tuple[float, float, float]:
    """``letter_features`` by the numbers of characters, unusual signs, letters of words and frequent ones among them."""
    rare = 0.0
    if count >= LEAST_LETTERS:
        rare = min(0.25, max(0.0, LETTERS_SHARE - frequent / count)) * 4.0
    return min(0.2, strange / size) * 5.0, rare, max(0.0, known - CLAUSE_SHARE) * 4.0


def _words(block: str) -> list[str]:
    """Lower-case words; the letters of letter-spaced headings are none."""
    words = WORD.findall(block.lower())
    if sum([len(w) == 1 for w in words]) > 4 and SPACED.search(block):
        words = WORD.findall(SPACED.sub("", block).lower())
    return words


def _known(words: list[str], common: frozenset[str] | set[str]) -> float:
    return sum([w in common or w in FUNCTION_WORDS for w in words]) / len(words) if words else 0.0


class Tallies(dict):
    """What each token between spaces adds to the numbers of its block, kept by token: one integer, ``BITS`` bits a number.

    Words, signs and letters never go over a space, so a block's numbers are the sums of its tokens'.
    """

    BITS, MASK = 32, (1 << 32) - 1
    #: Tokens that are kept at most, and the longest of them.
    KEPT, LONGEST = 200_000, 40

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, token: str) -> int:
        words = WORD.findall(token.lower())
        joined = "".join(words)
        end = token[-1:]
        total = 0
        for number in (
            len(words), sum([w in self.common or w in FUNCTION_WORDS for w in words]), sum([len(w) == 1 for w in words]), len(joined),
            sum(map(joined.count, FREQUENT_LETTERS)), len(STRANGE.findall(token)), end in LIST_SIGNS or end.isdecimal(),
        ):
            total = total << self.BITS | number
        if len(token) <= self.LONGEST:
            self[token] = total
        return total

    def of(self, block: str) -> list[int]:
        """Words, common ones, those of one letter, letters, frequent letters, unusual signs, and ends that a list's items may have."""
        if len(self) > self.KEPT:
            self.clear()
        total = sum(map(self.__getitem__, block.split()))
        return [total >> k * self.BITS & self.MASK for k in range(6, -1, -1)]


#: The tallies of the last table of common words.
_TALLIES: list[Tallies] = []


def tallies_of(common: frozenset[str] | set[str]) -> Tallies:
    known = _TALLIES[-1] if _TALLIES else None
    if known is None or known.common is not common:
        if known is None or known.common != common:
            known = Tallies(frozenset(common))
        elif isinstance(common, frozenset):
            # another task's copy, known by itself from now on
            known.common = common
        _TALLIES[:] = [known]
    return known


def block_features(block: str, lines: list[str], common: frozenset[str] | set[str]) -> tuple[float, ...]:
    """What ``WEIGHTS`` weigh."""
    words = _words(block)
    return (*layout(lines), *letter_features(block, words, _known(words, common)))


def nonprose_score(block: str, lines: list[str], common: frozenset[str] | set[str]) -> float:
    """Over 0: list, table or junk. A score that cannot come over 0 any more is given without the rest of its layout."""
    n, common_ones, single, count, frequent, strange, ends = tallies_of(common).of(block)
    if single > 4 and SPACED.search(block):
        words = _words(block)
        features = letter_features(block, words, _known(words, common))
    else:
        features = _shares(len(block), strange, count, frequent, common_ones / n if n else 0.0)
    score = BIAS + sum([w * x for w, x in zip(WEIGHTS[4:], features)])
    if score + MOST_LAYOUT <= 0:
        return score
    # so few ends make no list on one line
    rows, items = rows_of(lines) if len(lines) > 2 or ends >= LEAST_ITEMS else (lines, False)
    if len(rows) < 2:
        return score
    score += WEIGHTS[3] * open_rows(rows, items)
    if score + MOST_ALIGNED <= 0:
        return score
    score += WEIGHTS[0] * alignment(rows, items)
    if score + MOST_PERIODS <= 0:
        return score
    indents, lengths = periods(rows)
    return score + WEIGHTS[1] * indents + WEIGHTS[2] * lengths


#: Labelled blocks on which weights are fitted, at most.
FIT_BLOCKS = 50_000


def fit_weights(
    blocks: DataFrame, common: frozenset[str], block: str = "block", label: str = "nonprose", bias: float = BIAS,
    most: int = FIT_BLOCKS, rounds: int = 5_000,
) -> tuple[float, ...]:
    """Weights by logistic regression on labelled blocks, of which at most ``most`` are taken (by a hash of the block).

    Features are made in tasks; the sample's few numbers a block come to the driver. The bias is given: under 0, so that
    a block without layout and rare letters is prose.
    """
    names = [f"f{k}" for k in range(len(WEIGHTS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [block_features(t, [x for x in t.split("\n") if x.strip()], common) for t in pdf["block"]]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(size=pdf["block"].str.len().clip(upper=400).to_numpy(), label=pdf["label"].to_numpy())

    rows = blocks.where(F.trim(F.col(block)) != "").select(F.col(block).alias("block"), F.col(label).cast("boolean").alias("label"))
    rows = rows.where("label is not null").orderBy(F.xxhash64("block"), "block", "label").limit(most)
    table = rows.mapInPandas(run, ", ".join(f"{n} double" for n in names) + ", size int, label boolean").toPandas()
    x, y = table[names].to_numpy(), table["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        raise ValueError("labelled blocks of both kinds are needed")
    weight = table["size"].to_numpy() * np.where(y > 0, (1 - y.mean()) / y.mean(), 1.0)
    weight = weight / weight.sum()
    found = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(x @ found + bias)))
        found -= x.T @ ((p - y) * weight) * 2.0 + 1e-4 * found
    return tuple(found.tolist())


STATS = (
    "word_count int, char_len int, line_count int, mean_word_len double, symbol_ratio double, digit_ratio double, "
    "sentence_line_share double, common_word_share double, delimiter_alignment double, indent_period double, "
    "length_autocorrelation double, nonprose_share double, is_prose boolean"
)


def nonprose_share(text: str, common: frozenset[str] | set[str]) -> float:
    """The share of a text's characters, outside the gaps between blocks, that stand in lists, tables and junk."""
    inner = counted = 0
    for block in BLANK.split(text.strip("\n")):
        lines = [x for x in block.split("\n") if x.strip()]
        if lines:
            counted += len(block)
            if nonprose_score(block, lines, common) > 0:
                inner += len(block)
    return inner / counted if counted else 0.0


def describe(text: str | None, common: frozenset[str] | set[str]) -> tuple:
    if text is None or not text.strip():
        return (0, len(text or ""), 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False)
    words = WORD.findall(text.lower())
    visible = [x for x in text.split("\n") if x.strip()]
    size = sum(map(len, text.split()))
    share = nonprose_share(text, common)
    n = len(words)
    return (
        n, len(text), len(visible),
        sum(map(len, words)) / n if n else 0.0,
        len(STRANGE.findall(text)) / size,
        sum(map(str.isdigit, text)) / size,
        sum(x.rstrip().endswith(SENTENCE_END) for x in visible) / len(visible),
        _known(words, common),
        alignment(*rows_of(visible)), *periods(visible), share, share <= 0.5,
    )


#: Words of the given table at most; more are an error, not a cut.
MOST_COMMON = 10_000


def common_words(table: DataFrame, word: str = "word") -> frozenset[str]:
    """The given table of common words, which is of fixed size: read to the driver, as a parameter."""
    rows = table.select(word).where(F.col(word).isNotNull()).distinct().limit(MOST_COMMON + 1).collect()
    if len(rows) > MOST_COMMON:
        raise ValueError(f"a table of common words has at most {MOST_COMMON} entries")
    return frozenset(r[0] for r in rows)


def text_statistics(
    chunks: DataFrame, common: frozenset[str], id_col: str = "id", text: str = "text", char_count: str | None = "char_count",
    once: bool = False,
) -> DataFrame:
    """One row of statistics for each row of ``chunks`` (``once``: for each id); a map over Arrow batches.

    Only ``once`` shuffles, and only the rows of numbers.
    """
    kind = chunks.schema[id_col].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in STATS.split(",")]
    count = F.col(char_count).cast("long") if char_count else F.lit(None).cast("long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [describe(t, common) for t in pdf["_text"]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "_id", pdf["_id"].to_numpy())
            out.insert(1, "_count", pdf["_count"].to_numpy())
            yield out

    rows = chunks.select(F.col(id_col).alias("_id"), count.alias("_count"), F.col(text).alias("_text"))
    stats = rows.mapInPandas(run, f"_id {kind}, _count double, {STATS}")
    gap = F.when(F.col("_count") > 0, F.col("char_len") - F.col("_count").cast("long"))
    stats = stats.select(F.col("_id").alias(id_col), *names, gap.alias("char_count_gap"))
    if not once:
        return stats
    rest = [*names, "char_count_gap"]
    return stats.groupBy(id_col).agg(F.max(F.struct(*rest)).alias("_s")).select(id_col, *[F.col(f"_s.{c}").alias(c) for c in rest])


def not_prose(stats: DataFrame, id_col: str = "id") -> DataFrame:
    """The ids, once each, of texts most of whose characters stand in lists, tables or junk."""
    return stats.where(F.col("nonprose_share") > 0.5).select(id_col).distinct()
