"""Byte-level BPE encoding of a corpus with a public rank table.

The vocabulary file maps every token's bytes to its rank, which is also its id.
A text is cut into pretokens by the tokenizer's pattern; each pretoken's bytes
are merged pair by pair, always the leftmost pair of lowest rank.  The pairs
that can still merge are the leaves of a segment tree whose root holds that
pair, so one merge costs three logarithmic leaf updates, however long the
pretoken is (a page of unbroken signs stays ``n log n``).

Results: null and empty texts give an empty list; a blank text gives the ids of
its white space; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabulary files lie, unless a caller passes another folder.
TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

#: Unicode White_Space, and the pretoken pattern of the vocabulary.
_SPACE = r"\p{White_Space}"
_CLITICS = r"'s|'t|'re|'ve|'m|'ll|'d"
PATTERN = regex.compile(
    rf"{_CLITICS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: The same pattern over ASCII texts, where the letter and digit classes are short.
ASCII_PATTERN = re.compile(
    rf"{_CLITICS}| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)

#: Pretokens whose ids a worker keeps; the cache is emptied when it is full.
CACHE_ENTRIES = 200_000
#: Longer pretokens are encoded each time and not kept.
CACHED_CHARS = 64

_CODERS: dict[str, PieceCoder] = {}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken: merges from the root of a segment tree over pair ranks."""
    n = len(piece)
    if n == 0:
        return []
    if n == 1:
        return [ranks[piece]]
    rank = ranks.get
    size = 1
    while size < n - 1:
        size *= 2
    none = (len(ranks) + 1) * n
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    after = list(range(1, n + 2))
    before = list(range(-1, n))

    def put(leaf: int, key: int) -> None:
        at = size + leaf
        tree[at] = key
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left < right else right
            if tree[at] == least:
                break
            tree[at] = least

    while tree[1] != none:
        i = tree[1] % n
        j = after[i]
        k = after[j]
        after[i] = k
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            r = rank(piece[i : after[k]])
            put(i, none if r is None else r * n + i)
        else:
            put(i, none)
        if i > 0:
            h = before[i]
            r = rank(piece[h:k])
            put(h, none if r is None else r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PieceCoder(dict):
    """Ids by pretoken, filled as pretokens come up."""

    def __init__(self, path: str, content: bytes | None = None):
        super().__init__()
        if content is None:
            with open(path, "rb") as file:
                content = file.read()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        ids = merge_bytes(data, self.ranks) if whole is None else [whole]
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        return (ASCII_PATTERN if text.isascii() else PATTERN).findall(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.pieces(text))))


def coder(path: str, content: bytes | None = None) -> PieceCoder:
    """The process' coder of a vocabulary file, made once of its content (read from the path where that is not given)."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path, content)
    return _CODERS[path]


#: Bytes of a vocabulary file that are broadcast, at most.
MOST_BYTES = 64_000_000


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The file's content for all executors: only the driver needs to have the file."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"a vocabulary file has at most {MOST_BYTES} bytes")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def vocabulary_path(tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = DEFAULT_VOCABULARY) -> str:
    return f"{tokenizer_dir}/{vocabulary}"


def encode_column(
    df: DataFrame, key: str, text: str = "text", out: str = "ids", vocabulary: str | None = None
) -> DataFrame:
    """``key, out``: one row for each row of ``df``, ``out`` the ids of ``text``.

    A narrow map over Arrow batches: no shuffle, only the two columns are read.
    Extra columns of any name are left out; a null or repeated key is kept.
    """
    path = vocabulary or vocabulary_path()
    content = shared_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path, content.value).encode
        for batch in batches:
            ids: list[int] = []
            offsets = [0]
            for t in batch.column(1):
                ids += encode(t.as_py())
                offsets.append(len(ids))
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["k", "v"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("v"))
    return rows.mapInArrow(run, f"k {kind}, v array<int>").select(F.col("k").alias(key), F.col("v").alias(out))


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with ``out``, the number of its tokens (0 for null and empty)."""
    path = vocabulary or vocabulary_path()
    content = shared_vocabulary(df.sparkSession, path)
    kept = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = coder(path, content.value).count
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(len(kept))], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], n], names=[*kept, out])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{out}` int"]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text)).mapInArrow(run, ", ".join(fields))
