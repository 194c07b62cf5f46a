"""Packing texts into sequences of fixed capacity.

Items are spread over shards of a bounded number of items and each shard is
filled by best fit, largest item first.  A shard's open sequences are kept in
the order of their free space: a bitmap has one bit for every amount of free
space that some sequence has, and each sequence carries a bitmap of the sources
and one of the duplicate clusters that it holds.  An item goes to the tightest
sequence in which it fits and meets neither a copy of itself nor its own
source; the search steps from each amount of free space to the next larger one
until such a sequence is found.  Where there is none, a new sequence is opened
while the shard's items need more anyway; beyond that space goes first: the item
joins the tightest sequence without a copy of it, else the tightest at all.
``source_rule`` and ``cluster_rule`` as ``"strict"`` open a new sequence instead;
then a third of all rows being copies costs as many sequences as there are copies.

Sequences that a shard leaves with more than ``slack`` free are opened again
and their items packed with those of other shards, round by round, while what is
left fits in fewer shards of the same bounded size; so the space lost does not
grow with the number of shards.

Results: an item longer than the capacity is cut into full pieces and a rest;
nothing else is split.  Items of size 0 (null and empty texts) take a place in
some sequence of their shard but no space.  A null or negative size counts as 0;
a null source or cluster conflicts with nothing.  Ties go to the smaller key, so
equal inputs in equal shards give equal packings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

#: Items a shard holds at most on average; bounds a packing task's memory and time.
SHARD_ITEMS = 8_192


class Shard:
    """Open sequences by free space, with their source and cluster bitmaps.

    ``needed`` is how many sequences the shard's items take at least: while fewer are open, a new one costs no space.
    """

    def __init__(self, capacity: int, needed: int = 0, source_rule: str = "prefer", cluster_rule: str = "prefer"):
        self.capacity, self.needed = capacity, needed
        self.share_source, self.share_cluster = source_rule != "strict", cluster_rule != "strict"
        self.free_bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.free: list[int] = []

    def _open(self) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        self.free.append(self.capacity)
        return len(self.free) - 1

    def _tightest(self, size: int, source: int, cluster: int) -> int:
        """The tightest sequence with room that meets neither; -1 where there is none."""
        rest, at = self.free_bits >> size, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            at += step
            for b in self.by_free[at]:
                if not self.clusters[b] & cluster and not self.sources[b] & source:
                    return b
            rest >>= step + 1
            at += 1
        return -1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The sequence that takes the item, and where in it; the bitmaps of one bit are 0 where nothing conflicts."""
        chosen = self._tightest(size, source, cluster)
        if chosen < 0 and len(self.free) >= self.needed:
            if self.share_source and source:
                chosen = self._tightest(size, 0, cluster)
            if chosen < 0 and self.share_cluster and cluster:
                chosen = self._tightest(size, 0 if self.share_source else source, 0)
        if chosen < 0:
            chosen = self._open()
        else:
            old = self.free[chosen]
            self.by_free[old].remove(chosen)
            if not self.by_free[old]:
                self.free_bits &= ~(1 << old)
        left = self.free[chosen] - size
        self.free[chosen] = left
        self.by_free[left].append(chosen)
        self.free_bits |= 1 << left
        self.sources[chosen] |= source
        self.clusters[chosen] |= cluster
        return chosen, self.capacity - left - size


def _bits(values: pd.Series) -> list[int]:
    codes = pd.factorize(values)[0]
    return [0 if c < 0 else 1 << int(c) for c in codes]


def _pack_shard(pdf: pd.DataFrame, capacity: int, *rules: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable")
    shard = Shard(capacity, -(-int(pdf["size"].sum()) // capacity), *rules)
    places = [shard.place(*x) for x in zip(pdf["size"].tolist(), _bits(pdf["source"]), _bits(pdf["cluster"]))]
    pdf = pdf.assign(seq=[b for b, _ in places], start=[at for _, at in places])
    return pdf.assign(free=[shard.free[b] for b in pdf["seq"]])


def pack(
    items: DataFrame,
    key: str = "doc_id",
    size: str = "n_tokens",
    source: str | None = "source",
    cluster: str | None = "cluster",
    capacity: int = 2_048,
    slack: int = 16,
    source_rule: str = "prefer",
    cluster_rule: str = "prefer",
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """``key, piece, sequence_id, start_token, n_tokens``: where each item, or each piece of a long one, lies."""
    kind = items.schema[key].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size).cast("int"), F.lit(0)), F.lit(0))
    missing = F.lit(None).cast("string")
    rows = items.select(
        F.col(key).alias("key"),
        n.alias("n"),
        (F.col(source).cast("string") if source else missing).alias("source"),
        (F.col(cluster).cast("string") if cluster else missing).alias("cluster"),
    )
    last = F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0))
    rows = rows.select(
        "key", "n", "source",
        F.when(F.col("n") > 0, F.col("cluster")).alias("cluster"),
        F.explode(F.sequence(F.lit(0), last)).alias("piece"),
    ).select(
        "key", "piece",
        F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("size"),
        # the full pieces of a long item fill their sequences alone
        F.when(F.col("n") <= capacity, F.col("source")).alias("source"),
        F.when(F.col("n") <= capacity, F.col("cluster")).alias("cluster"),
    )
    schema = f"key {kind}, piece int, size int, source string, cluster string, seq int, start int, free int, shard int, round int"

    def packer(round_no: int):
        return lambda pdf: _pack_shard(pdf, capacity, source_rule, cluster_rule).assign(round=round_no)

    open_rows = written(rows, "pack-items")
    placed: DataFrame | None = None
    shards, round_no = max(1, -(-open_rows.count() // shard_items)), 0
    while True:
        shard = F.pmod(F.xxhash64("key", "piece", F.lit(round_no)), F.lit(shards)).cast("int")
        packed = (
            open_rows.select("key", "piece", "size", "source", "cluster", shard.alias("shard"))
            .groupBy("shard")
            .applyInPandas(packer(round_no), schema)
        )
        if shards == 1:
            placed = packed if placed is None else placed.unionByName(packed)
            break
        packed = written(packed, f"pack-{round_no}")
        open_rows = packed.where(F.col("free") > slack)
        fewer = max(1, -(-open_rows.count() // shard_items))
        if fewer >= shards:
            # what is left does not fit in fewer shards of bounded size: packing it again would not help
            placed = packed if placed is None else placed.unionByName(packed)
            break
        full = packed.where(F.col("free") <= slack)
        placed = full if placed is None else placed.unionByName(full)
        round_no += 1
        # what is left is small, and it must come together to be packed tighter
        shards = fewer
    sequence = F.concat_ws("-", "round", "shard", "seq")
    return placed.select(
        F.col("key").alias(key), "piece", sequence.alias("sequence_id"), F.col("start").alias("start_token"),
        F.col("size").alias("n_tokens"),
    )
