"""Pairs and groups of texts that share most of their word sequences.

Each text becomes the set of hashes of its runs of ``width`` words, and of that
set two signatures: band keys (several least hashes each), which send texts that
may be alike to the same shard, and a sketch of ``BITS`` one-bit least hashes,
whose Hamming distance estimates the share that differs.  A shard's sketches
stand in a BK-tree, whose children are keyed by their Hamming distance to the
parent; a search follows only edges within the radius.  What is found is checked
exactly on the whole texts.

The shards' trees are not broadcast: their total size grows with the collection
and has no bound, so each tree is built where its shard's texts come together,
in one pass over rows sorted by band key.  One tree over all sketches does not
prune: unrelated sketches lie about half their bits apart, all at nearly the same
distance, so that the edges within any useful radius are nearly all (README).  A band key that over ``SHARD_ROWS``
texts share is passed on and divided: texts are put into blocks by hash, and
each pair of blocks is a shard of its own, so no task holds more than two blocks.

Texts with equal word sets are one class and are represented by one; results
are pairs of class representatives plus the membership of every id
(``ClassPairs``), or expanded pairs of ids.

Results: null, empty and short texts (fewer than ``width`` words) take no part.
An id counts once, however often delivered; delivered with different texts it is
a member of each text's class.  Class keys are 64-bit hashes of word sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import unwritten, written

WORD = regex.compile(r"[\p{L}\p{N}]+")
BANDS, BAND_ROWS, BITS = 44, 3, 128
#: Texts of one band key that are held in one tree.
SHARD_ROWS = 4_096
#: Word hashes and classes that a worker remembers; emptied when full.
REMEMBERED = 200_000
#: Sets of classes that a task keeps while it checks pairs.
KEPT_SETS = 2_000
#: Classes in candidate pairs up to which their keys (16 bytes each) are broadcast to choose texts.
BROADCAST_KEYS = 500_000

_WORD_HASH: dict[str, int] = {}
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``width`` words."""
    words = WORD.findall(text.lower()) if text else []
    if len(words) < width:
        return np.zeros(0, np.uint64)
    if len(_WORD_HASH) > REMEMBERED:
        _WORD_HASH.clear()
    known = _WORD_HASH
    codes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh64_intdigest(w)
        codes[i] = code
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = _mix(total + codes[k : len(codes) - width + 1 + k] + _U(k + 1))
    return np.unique(total)


def class_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A key of each set: of its size and the sum of its members' hashes."""
    sizes = np.diff(np.append(starts, len(values))).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(values), starts) + sizes).view(np.int64)


class Signer:
    """Band keys and sketches of many sets at once."""

    def __init__(self, bands: int, band_rows: int, bits: int = BITS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.band_rows, self.bits = bands, band_rows, bits
        count = bands * band_rows + bits
        self.factor = rng.integers(1, 2**63, count, dtype=np.uint64) | _U(1)
        self.term = rng.integers(0, 2**63, count, dtype=np.uint64)

    def _least(self, values: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        hashed = ((values * self.factor[k] + self.term[k]) >> _U(32)).astype(np.uint32)
        return np.minimum.reduceat(hashed, starts)

    def sign(self, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sets, bands)`` keys and ``(sets, bits / 64)`` sketch words."""
        keys = np.empty((len(starts), self.bands), np.uint64)
        for b in range(self.bands):
            key = np.full(len(starts), _U(b + 1))
            for r in range(self.band_rows):
                key = _mix(key + self._least(values, starts, b * self.band_rows + r))
            keys[:, b] = key
        sketch = np.zeros((len(starts), self.bits // 64), np.uint64)
        for j in range(self.bits):
            bit = (self._least(values, starts, self.bands * self.band_rows + j) * np.uint32(2654435761)) >> np.uint32(31)
            sketch[:, j // 64] |= bit.astype(np.uint64) << _U(j % 64)
        return keys, sketch


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's node: a new one, or the one that has it already."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        node = 0
        while True:
            distance = (self.values[node] ^ value).bit_count()
            if distance == 0:
                return node
            below = self.children[node]
            if distance not in below:
                below[distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return below[distance]
            node = below[distance]

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            least, most = distance - radius, distance + radius
            stack.extend([child for edge, child in self.children[node].items() if least <= edge <= most])
        return found


def shard_pairs(keys: list[int], sketches: list[int], radius: int, others: tuple[list[int], list[int]] | None = None) -> set:
    """Pairs of keys whose sketches lie within the radius, inside a shard or between it and ``others``."""
    out: set[tuple[int, int]] = set()
    tree = BKTree()
    held: list[list[int]] = []
    for key, sketch in zip(keys, sketches):
        if others is None:
            for node in tree.within(sketch, radius):
                out.update((min(key, k), max(key, k)) for k in held[node] if k != key)
        node = tree.add(sketch)
        if node == len(held):
            held.append([])
        if key not in held[node]:
            held[node].append(key)
    if others is not None:
        for key, sketch in zip(*others):
            for node in tree.within(sketch, radius):
                out.update((min(key, k), max(key, k)) for k in held[node] if k != key)
    return out


def radius_for(threshold: float, bits: int = BITS, deviations: float = 3.2) -> int:
    """The Hamming distance that sketches of sets of the threshold's similarity hardly ever exceed."""
    share = (1 - threshold) / 2
    return int(bits * share + deviations * (bits * share * (1 - share)) ** 0.5)


@dataclass
class ClassPairs:
    """``pairs``: class_a, class_b, similarity; ``members``: class, id (each once)."""

    pairs: DataFrame
    members: DataFrame


def _sketch_rows(chunks: DataFrame, id_col: str, text: str, width: int, bands: int, band_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, band_rows)
        met: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                sets = [shingles(t.as_py(), width) for t in batch.column(1)]
                use = np.flatnonzero([len(s) > 0 for s in sets])
                if not len(use):
                    continue
                kept = [sets[i] for i in use]
                values = np.concatenate(kept)
                starts = np.cumsum([0, *map(len, kept[:-1])])
                classes = class_keys(values, starts)
                # a text met before in this task has sent its band keys already: hot groups of copies stay small
                first = np.zeros(len(kept), dtype=bool)
                for i, c in enumerate(classes.tolist()):
                    if c not in met:
                        met.add(c)
                        first[i] = True
                if len(met) > REMEMBERED:
                    met.clear()
                keys, sketch = signer.sign(values, starts)
                flat = pa.array(keys[first].view(np.int64).ravel())
                offsets = np.concatenate([[0], np.cumsum(np.where(first, bands, 0))]).astype(np.int32)
                mask = pa.array(~first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(use)).cast(pa.string()),
                        pa.array(classes),
                        pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask),
                        pa.array(np.ascontiguousarray(sketch[:, 0]).view(np.int64)),
                        pa.array(np.ascontiguousarray(sketch[:, 1]).view(np.int64)),
                    ],
                    names=["id", "class", "bands", "low", "high"],
                )

    rows = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id string, class long, bands array<long>, low long, high long")


def _pairs_table(pairs: set) -> pa.Table:
    a = np.array([p[0] for p in pairs], np.int64)
    b = np.array([p[1] for p in pairs], np.int64)
    return pa.table({"class_a": a, "class_b": b})


def _sketch_list(low: np.ndarray, high: np.ndarray) -> list[int]:
    return [(h << 64) | w for h, w in zip(high.view(np.uint64).tolist(), low.view(np.uint64).tolist())]


def _candidates(sketches: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """``class_a, class_b``: pairs within the radius in some shard."""
    rows = sketches.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("band"), "class", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by band: a shard is a run of equal bands, which may go on in the next batch
        rest: tuple[np.ndarray, ...] | None = None
        hot_band: int | None = None

        def out(pairs: set, hot: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
            n, m = len(a), sum(len(h[0]) for h in hot)
            cat = [np.concatenate([h[i] for h in hot]) if hot else np.zeros(0, np.int64) for i in range(4)]
            pad = np.zeros(n, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, cat[1]])),
                    pa.array(np.concatenate([b, np.zeros(m, np.int64)])),
                    pa.array(np.concatenate([pad, cat[0]])),
                    pa.array(np.concatenate([pad, cat[2]])),
                    pa.array(np.concatenate([pad, cat[3]])),
                    pa.array(np.concatenate([np.zeros(n, bool), np.ones(m, bool)])),
                ],
                names=["class_a", "class_b", "band", "low", "high", "hot"],
            )

        def runs(columns: tuple[np.ndarray, ...], bounds: np.ndarray, pairs: set) -> None:
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s > 1:
                    pairs |= shard_pairs(columns[1][s:e].tolist(), _sketch_list(columns[2][s:e], columns[3][s:e]), radius)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            if rest is not None:
                columns = tuple(np.concatenate([r, c]) for r, c in zip(rest, columns))
            band = columns[0]
            starts = np.concatenate([[0], np.flatnonzero(band[1:] != band[:-1]) + 1, [len(band)]])
            pairs: set = set()
            hot: list[tuple[np.ndarray, ...]] = []
            lengths = np.diff(starts)
            last = len(lengths) - 1
            # the last run stays open; runs over the limit are passed on
            for i in np.flatnonzero(lengths[:last] > 1):
                s, e = int(starts[i]), int(starts[i + 1])
                if e - s > shard_rows or band[s] == hot_band:
                    hot.append(tuple(c[s:e] for c in columns))
                else:
                    pairs |= shard_pairs(columns[1][s:e].tolist(), _sketch_list(columns[2][s:e], columns[3][s:e]), radius)
            if last > 0 and lengths[0] == 1 and band[0] == hot_band:
                hot.append(tuple(c[:1] for c in columns))
            s = int(starts[last])
            rest = tuple(c[s:] for c in columns)
            if len(rest[0]) > shard_rows or rest[0][0] == hot_band:
                hot_band = int(rest[0][0])
                hot.append(rest)
                rest = tuple(c[:0] for c in columns)
            if pairs or hot:
                yield out(pairs, hot)
        if rest is not None and len(rest[0]) > 1:
            pairs = set()
            runs(rest, np.array([0, len(rest[0])]), pairs)
            yield out(pairs, [])

    spark = sketches.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(
        rows.repartition(parts, "band").sortWithinPartitions("band").mapInArrow(
            run, "class_a long, class_b long, band long, low long, high long, hot boolean"
        ),
        "near-candidates",
    )
    pairs = found.where(~F.col("hot")).select("class_a", "class_b")
    hot = found.where("hot").select("band", F.col("class_a").alias("class"), "low", "high")
    sizes = hot.groupBy("band").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / shard_rows).cast("int")
    spread = hot.join(sizes, "band").withColumn("blocks", blocks).withColumn(
        "mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    )
    cells = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "class", "low", "high"
    )

    def cell(table: pa.Table) -> pa.Table:
        a, b, mine = (table.column(c).to_numpy() for c in ("a", "b", "mine"))
        keys = table.column("class").to_numpy()
        sketch = _sketch_list(np.ascontiguousarray(table.column("low").to_numpy()), np.ascontiguousarray(table.column("high").to_numpy()))
        left = np.flatnonzero(mine == a[0])
        if a[0] == b[0]:
            return _pairs_table(shard_pairs(keys[left].tolist(), [sketch[i] for i in left], radius))
        right = np.flatnonzero(mine == b[0])
        return _pairs_table(
            shard_pairs(
                keys[left].tolist(), [sketch[i] for i in left], radius, (keys[right].tolist(), [sketch[i] for i in right])
            )
        )

    hot_pairs = cells.groupBy("band", "a", "b").applyInArrow(cell, "class_a long, class_b long")
    return pairs.unionByName(hot_pairs).distinct()


def similar_pairs(
    chunks: DataFrame,
    id_col: str = "id",
    text: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> ClassPairs:
    """Pairs of different texts with a Jaccard similarity of word runs of at least the threshold, and who has each text."""
    sketches = written(_sketch_rows(chunks, id_col, text, width, bands, band_rows), "near-sketches")
    candidates = written(_candidates(sketches, radius_for(threshold), shard_rows), "near-pairs")
    members = sketches.select("class", "id").distinct()

    ends = candidates.select(F.col("class_a").alias("class")).union(candidates.select("class_b")).distinct()
    chosen = sketches.select("class", "id").join(
        F.broadcast(ends) if candidates.count() * 2 <= BROADCAST_KEYS else ends, "class", "left_semi"
    )
    speakers = written(chosen.groupBy("class").agg(F.min("id").alias("id")), "near-speakers")
    small = speakers.count() <= BROADCAST_KEYS
    source = chunks.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    texts = source.join(F.broadcast(speakers) if small else speakers, "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def set_of(key: int, text: pa.Scalar) -> np.ndarray:
            """A class' set, made once for its pairs in this task; empty where the text is of another class."""
            if key not in kept:
                found = shingles(text.as_py(), width)
                # an id that came with several texts speaks for the class of each: only that text counts
                if not len(found) or class_keys(found, [0])[0] != key:
                    return found[:0]
                if len(kept) >= KEPT_SETS:
                    kept.clear()
                kept[key] = found
            return kept[key]

        for batch in batches:
            a, b, x, y = batch.columns
            score = []
            for i, j, s, t in zip(a.to_pylist(), b.to_pylist(), x, y):
                p, q = set_of(i, s), set_of(j, t)
                if not (len(p) and len(q)):
                    score.append(-1.0)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                score.append(both / (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(score, pa.float64())], names=["class_a", "class_b", "similarity"])

    pairs = (
        candidates.join(texts.select(F.col("class").alias("class_a"), F.col("text").alias("x")), "class_a")
        .join(texts.select(F.col("class").alias("class_b"), F.col("text").alias("y")), "class_b")
        .select("class_a", "class_b", "x", "y")
        .mapInArrow(check, "class_a long, class_b long, similarity double")
        .groupBy("class_a", "class_b")
        .agg(F.max("similarity").alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return ClassPairs(written(pairs, "near-verified"), members)


def expanded(found: ClassPairs) -> DataFrame:
    """``id_a, id_b``: every pair of ids, those of equal texts included, the smaller id first, once."""
    members = found.members
    a = members.select(F.col("class").alias("class_a"), F.col("id").alias("x"))
    b = members.select(F.col("class").alias("class_b"), F.col("id").alias("y"))
    across = found.pairs.join(a, "class_a").join(b, "class_b").select("x", "y")
    shared = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    copies = members.join(shared, "class")
    inside = copies.select("class", F.col("id").alias("x")).join(copies.select("class", F.col("id").alias("y")), "class")
    pairs = across.where("x <> y").unionByName(inside.where("x < y").select("x", "y"))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(found: ClassPairs, most_rounds: int = 60) -> DataFrame:
    """``id, class, group, links``: each id's class, the least class of its connected group, and its number of links.

    Links are to other classes and to other ids of its own class. Labels spread by minimum over the links and through the
    labels themselves (a class takes its label's label), so rounds grow with the logarithm of a chain's length. Each round is
    two joins and a pre-aggregated minimum, written in the shared folder; only a count comes to the driver.
    """
    both = found.pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    links = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    held = labels = written(links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "near-labels")
    for _ in range(most_rounds):
        near = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "label", F.least("label", F.coalesce("least", "label")).alias("next")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = spread.join(jump, spread["next"] == jump["at"], "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("new")
        )
        before, held = held, written(moved, "near-labels")
        unwritten(before)
        labels = held.select("node", "label")
        if held.where("new").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("the groups did not settle")
    sizes = found.members.groupBy("class").agg(F.count("*").alias("n"))
    degree = links.join(sizes, links["b"] == sizes["class"]).groupBy("a").agg(F.sum("n").alias("across"))
    per_class = (
        sizes.join(labels, sizes["class"] == labels["node"], "left")
        .join(degree, sizes["class"] == degree["a"], "left")
        .select("class", F.coalesce("label", "class").alias("group"), (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    )
    return found.members.join(per_class, "class").select("id", "class", "group", "links")
