"""The k most similar vectors of every vector, by graphs over shards.

Vectors are routed to shards by the nearest of a set of centroids, fitted on a
bounded sample; every vector is indexed in its shard, by a hierarchical
navigable small-world graph.  A vector is searched for in its own shard, from
its own node, and in the next shards whose centroid is nearly as near; the
results of its shards are merged.  A shard that holds over twice the planned
rows is split by a hash of the id and all its parts are searched; a part that
very many rows search is indexed in several tasks, each with some of them.  So
no task grows with a crowded region.

Where more than ``FIRST_LEVEL`` shards are planned there are two levels: about
the square root of so many cells, and in each cell centroids of its own.  These
are fitted by Spark, a task a cell, on a sample that grows with the number of
shards, and stay in a table that meets the rows of their cell; the driver holds
the cells' centroids only.

Results: rows whose vector is null, of another length, all zero, or has a null,
NaN or infinite component take no part.  A row delivered again counts once; of
an id with different vectors each is indexed and the best similarity counts.
Equal vectors of different ids are neighbours of similarity 1.  Ties go to the
smaller id.  A collection of fewer than ``k + 1`` vectors gives fewer rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.hnsw import FlatGraph

#: Rows planned for one shard, and the most centroids that are held at once (0.5 MB at 128 numbers).
SHARD_ROWS = 8_192
FIRST_LEVEL = 1_024
#: Rows on which the centroids are fitted (about; never over twice as many), and at the second level for each centroid.
SAMPLE_ROWS = 16_384
CENTROID_ROWS = 16
#: Rows of a cell that one task routes to its shards.
ROUTE_ROWS = 65_536
#: Searches of other shards' rows that one task takes; a shard with more is searched in several tasks, each with its graph.
SHARD_SEARCHES = 4 * SHARD_ROWS
#: What a row does in its task: it is indexed and searched for, only indexed, or only searched for.
BOTH, INDEXED, ASKS = 0, 1, 2
ROUTED = "id string, values array<float>, shard long, part int, task int, role byte"
#: Other shards searched, at most, and how much less similar their centroid may be than the own one's.
PROBES = 3
PROBE_MARGIN = 0.10


def usable(vectors: DataFrame, id_col: str, values: str, dim: int) -> DataFrame:
    v = F.col(values)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(
        F.col(id_col).isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)
    ).select(F.col(id_col).cast("string").alias("id"), v.cast("array<float>").alias("values"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.array(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
    return x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None].astype(np.float32)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Spherical k-means over the sample's unit vectors."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    centroids = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids, dtype=np.float64)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-12)[:, None], centroids).astype(np.float32)
    return centroids


def _search_shard(table: pa.Table, dim: int, k: int, m: int, ef: int) -> pa.Table:
    ids = table.column("id").to_numpy(zero_copy_only=False)
    role = table.column("role").to_numpy(zero_copy_only=False)
    x = _matrix(table.column("values"), dim)
    at = np.flatnonzero(role != ASKS)
    if not len(at):
        return pa.table({"id": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
    # equal vectors are one node of the graph; its members are all ids that have it
    _, first, member = np.unique(
        np.ascontiguousarray(x[at]).view(np.dtype((np.void, 4 * dim))).ravel(), return_index=True, return_inverse=True
    )
    graph = FlatGraph(x[at[first]], m=m, ef_build=ef)
    members = pd.DataFrame({"rep": member.ravel(), "neighbour": ids[at]}).drop_duplicates()
    members = members.sort_values(["rep", "neighbour"]).groupby("rep").head(k + 1)
    found = []
    home = pd.DataFrame({"id": ids[at], "rep": member.ravel()})[role[at] == BOTH].drop_duplicates()
    near, sims = graph.search(x[at[first]][home["rep"].to_numpy()], k + 1, ef, own=home["rep"].to_numpy())
    found.append((home["id"].to_numpy(), near, sims))
    away = np.flatnonzero(role == ASKS)
    if len(away):
        away = away[np.unique(ids[away], return_index=True)[1]]
        near, sims = graph.search(x[away], k + 1, ef)
        found.append((ids[away], near, sims))
    parts = [
        pd.DataFrame({"id": np.repeat(i, n.shape[1]), "rep": n.ravel(), "similarity": s.ravel()}) for i, n, s in found
    ]
    out = pd.concat(parts)
    out = out[out["rep"] >= 0].merge(members, on="rep")
    out = out[out["id"] != out["neighbour"]].sort_values(["id", "similarity", "neighbour"], ascending=[True, False, True])
    out = out.groupby("id", sort=False).head(k)
    return pa.table(
        {
            "id": pa.array(out["id"], pa.string()),
            "neighbour": pa.array(out["neighbour"], pa.string()),
            "similarity": pa.array(out["similarity"].to_numpy(np.float64), pa.float64()),
        }
    )


def nearest(
    vectors: DataFrame,
    id_col: str = "id",
    values: str = "values",
    dim: int = 128,
    k: int = 5,
    m: int = 8,
    ef: int = 24,
    shard_rows: int = SHARD_ROWS,
    probes: int = PROBES,
    margin: float = PROBE_MARGIN,
    sample_rows: int = SAMPLE_ROWS,
    first_level: int = FIRST_LEVEL,
) -> DataFrame:
    """``id, neighbour, similarity, rank``: for each usable row its ``k`` most similar others, by cosine."""
    rows = usable(vectors, id_col, values, dim)
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    plan = _Routes(dim, shard_rows, probes, margin, sample_rows)
    if shards <= first_level:
        routed = plan.one_level(rows, total, shards)
    else:
        routed = plan.two_levels(rows, total, min(first_level, int(np.ceil(np.sqrt(shards)))))
    found = routed.groupBy("shard", "part", "task").applyInArrow(
        lambda table: _search_shard(table, dim, k, m, ef), "id string, neighbour string, similarity double"
    )
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return (
        found.groupBy("id", "neighbour")
        .agg(F.max("similarity").alias("similarity"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
    )


@dataclass(frozen=True)
class _Routes:
    """How rows come to the tasks that index and search them: ``id, values, shard, part, task, role``."""

    dim: int
    shard_rows: int
    probes: int
    margin: float
    sample_rows: int

    def _sample(self, rows: DataFrame, total: int, least: int) -> np.ndarray:
        # chosen by a hash of the id, so that a rerun takes the same rows
        wanted = max(self.sample_rows, least)
        cut = int(min(1.0, wanted / max(1, total)) * (1 << 30))
        drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < cut).select("values").limit(2 * wanted)
        return _matrix(pa.concat_tables([drawn.toArrow()]).column("values"), self.dim)

    def _near(self, values: pa.Array, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row, best first, and which of them are near enough to be searched."""
        sims = _matrix(values, self.dim) @ centroids.T
        order = np.argsort(-sims, axis=1, kind="stable")[:, : self.probes + 1]
        best = np.take_along_axis(sims, order, 1)
        return order, best >= best[:, :1] - self.margin

    def _counts(self, rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each centroid the rows that are nearest to it, and the others that search it: a row a centroid to the driver."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, more = (np.zeros(len(centroids), np.int64) for _ in range(2))
            for batch in batches:
                if batch.num_rows:
                    order, near = self._near(batch.column(1), centroids)
                    n += np.bincount(order[:, 0], minlength=len(centroids))
                    more += np.bincount(order[:, 1:][near[:, 1:]], minlength=len(centroids))
            some = np.flatnonzero(n + more)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(more[some])], names=["shard", "n", "more"])

        own, asks = (np.zeros(len(centroids), np.int64) for _ in range(2))
        counted = rows.mapInArrow(count, "shard long, n long, more long")
        for row in counted.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("more").alias("more")).collect():
            own[row["shard"]], asks[row["shard"]] = row["n"], row["more"]
        return own, asks

    def one_level(self, rows: DataFrame, total: int, shards: int) -> DataFrame:
        centroids = np.zeros((1, self.dim), np.float32)
        parts, asked = (np.ones(1, np.int64) for _ in range(2))
        if shards > 1:
            centroids = fit_centroids(self._sample(rows, total, 4 * shards), shards)
            own, asks = self._counts(rows, centroids)
            parts = np.maximum(1, -(-own // (2 * self.shard_rows)))
            # the other parts' rows search a part too
            searches = self.shard_rows * SHARD_SEARCHES // SHARD_ROWS
            asked = np.maximum(1, -(-(asks + np.where(parts > 1, own, 0)) // searches))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                order, near = self._near(batch.column(1), centroids)
                code = np.array([hash_of(i) for i in batch.column(0).to_pylist()], np.int64)
                home = order[:, 0]
                mine, turn = code % parts[home], code // 7919
                sent: list[tuple] = []

                def send(index: np.ndarray, shard: np.ndarray, part: np.ndarray | int, task: np.ndarray | int, what: int) -> None:
                    sent.append((index, shard, np.broadcast_to(part, len(index)), np.broadcast_to(task, len(index)), np.full(len(index), what)))

                for task in range(int(asked[home].max())):
                    some = np.flatnonzero(asked[home] > task)
                    send(some, home[some], mine[some], task, BOTH if task == 0 else INDEXED)
                for p in range(order.shape[1] if shards > 1 else 1):
                    asks = np.flatnonzero(near[:, p]) if p else np.arange(batch.num_rows)
                    for sub in range(int(parts[order[asks, p]].max()) if len(asks) else 0):
                        some = asks[(parts[order[asks, p]] > sub) & ((p > 0) | (mine[asks] != sub))]
                        shard = order[some, p]
                        send(some, shard, sub, turn[some] % asked[shard], ASKS)
                index, shard, part, task, role = (np.concatenate(x) for x in zip(*sent))
                taken = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken), batch.column(1).take(taken), pa.array(shard.astype(np.int64)),
                        pa.array(part.astype(np.int32)), pa.array(task.astype(np.int32)), pa.array(role.astype(np.int8)),
                    ],
                    names=["id", "values", "shard", "part", "task", "role"],
                )

        routed = rows.mapInArrow(route, ROUTED)
        tasks = int((parts * asked).sum())
        # one task's rows a partition, as far as the hash allows it
        return routed.repartition(min(tasks * 2, 4 * FIRST_LEVEL), "shard", "part", "task") if tasks > 1 else routed

    def two_levels(self, rows: DataFrame, total: int, cells: int) -> DataFrame:
        spark = rows.sparkSession
        centroids = fit_centroids(self._sample(rows, total, CENTROID_ROWS * cells), cells)
        own, asks = self._counts(rows, centroids)
        inner = np.maximum(1, -(-own // self.shard_rows))
        salts = np.maximum(1, -(-(own + asks) // ROUTE_ROWS))
        share = np.minimum(1.0, CENTROID_ROWS * inner / np.maximum(1, own))
        table = written(self._inner_centroids(rows, centroids, inner, share), "neighbour-cells")
        spread = spark.createDataFrame([(i, int(n)) for i, n in enumerate(salts)], "cell int, salts int")
        held = table.join(F.broadcast(spread), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "centroids")

        def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                order, near = self._near(batch.column(1), centroids)
                index, place = np.nonzero(near)
                cell = order[index, place]
                code = np.array([hash_of(i) for i in batch.column(0).to_pylist()], np.int64)
                taken = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken), batch.column(1).take(taken), pa.array(cell.astype(np.int32)),
                        pa.array((code[index] % salts[cell]).astype(np.int32)), pa.array(np.where(place == 0, BOTH, ASKS).astype(np.int8)),
                    ],
                    names=["id", "values", "cell", "salt", "role"],
                )

        def to_shards(visitors: pa.Table, known: pa.Table) -> pa.Table:
            if not visitors.num_rows:
                return pa.Table.from_pylist([], pa.schema([("id", pa.string()), ("values", pa.list_(pa.float32())), ("shard", pa.int64()), ("role", pa.int8())]))
            cell = visitors.column("cell")[0].as_py()
            local = np.asarray(known.column("centroids").combine_chunks().flatten(), np.float32).reshape(-1, self.dim)
            order, near = self._near(visitors.column("values"), local)
            # a visitor from another cell searches the nearest shard only, so that a row goes to 2 * probes + 1 shards at most
            near[visitors.column("role").to_numpy() == ASKS, 1:] = False
            index, place = np.nonzero(near)
            role = visitors.column("role").to_numpy()[index]
            taken = visitors.take(pa.array(index))
            return pa.table(
                {
                    "id": taken.column("id"), "values": taken.column("values"),
                    "shard": pa.array((np.int64(cell) << 32) + order[index, place]),
                    "role": pa.array(np.where(place == 0, role, ASKS).astype(np.int8)),
                }
            )

        visitors = rows.mapInArrow(to_cells, "id string, values array<float>, cell int, salt int, role byte")
        placed = visitors.groupBy("cell", "salt").cogroup(held.groupBy("cell", "salt")).applyInArrow(
            to_shards, "id string, values array<float>, shard long, role byte"
        )
        return self._divided(written(placed, "neighbour-shards"))

    def _inner_centroids(self, rows: DataFrame, centroids: np.ndarray, inner: np.ndarray, share: np.ndarray) -> DataFrame:
        """``cell, centroids`` (all numbers of a cell's centroids), fitted on a part of the rows of each cell."""

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = self._near(batch.column(1), centroids)[0][:, 0]
                code = np.array([hash_of(i) for i in batch.column(0).to_pylist()], np.float64) / 2.0**32
                some = pa.array(np.flatnonzero(code < share[cell]))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)).take(some), batch.column(1).take(some)], names=["cell", "values"])

        def fit(table: pa.Table) -> pa.Table:
            cell = table.column("cell")[0].as_py()
            # in one order, so that a rerun fits the same
            x = _matrix(table.column("values"), self.dim)
            x = x[np.lexsort(x.T[::-1])]
            return pa.table({"cell": pa.array([cell], pa.int32()), "centroids": pa.array([fit_centroids(x, int(inner[cell])).ravel()], pa.list_(pa.float32()))})

        drawn = rows.mapInArrow(draw, "cell int, values array<float>")
        fitted = drawn.groupBy("cell").applyInArrow(fit, "cell int, centroids array<float>")
        # a cell of which no row was drawn has its own centroid
        plain = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, plain array<float>")
        return plain.join(fitted, "cell", "left").select("cell", F.coalesce("centroids", "plain").alias("centroids"))

    def _divided(self, placed: DataFrame) -> DataFrame:
        """Crowded shards in parts, and parts that many rows search in several tasks; the counts meet the rows by their shard."""
        searches = self.shard_rows * SHARD_SEARCHES // SHARD_ROWS
        counts = placed.groupBy("shard").agg(F.count_if(F.col("role") != ASKS).alias("n"), F.count_if(F.col("role") == ASKS).alias("more"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("n") / (2 * self.shard_rows))).cast("int")
        counts = counts.withColumn("parts", parts)
        tasks = F.greatest(F.lit(1), F.ceil((F.col("more") + F.when(F.col("parts") > 1, F.col("n")).otherwise(0)) / searches)).cast("int")
        counts = counts.select("shard", "parts", tasks.alias("tasks"))
        code = F.pmod(F.crc32(F.encode("id", "utf-8")), F.lit(1 << 30))
        df = placed.join(counts, "shard").withColumns(
            {"mine": F.pmod(code, F.col("parts")).cast("int"), "turn": F.pmod(F.floor(code / 7919), F.col("tasks")).cast("int")}
        )
        place = lambda part, task, role: F.struct(part.alias("part"), task.alias("task"), role.cast("byte").alias("role"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        asks = F.transform(F.filter(every, lambda p: (F.col("role") == ASKS) | (p != F.col("mine"))), lambda p: place(p, F.col("turn"), F.lit(ASKS)))
        held = F.transform(
            F.sequence(F.lit(0), F.col("tasks") - 1), lambda t: place(F.col("mine"), t, F.when(t == 0, F.lit(BOTH)).otherwise(F.lit(INDEXED)))
        )
        places = F.when(F.col("role") == ASKS, asks).otherwise(F.concat(held, asks))
        return df.select("id", "values", "shard", F.explode(places).alias("p")).select("id", "values", "shard", "p.part", "p.task", "p.role")


def hash_of(text: str) -> int:
    """A hash that is the same in every process."""
    return zlib.crc32(text.encode("utf-8"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """``id_a, id_b``: the pairs of which one is a neighbour of the other, the smaller id first, once."""
    return neighbours.select(
        F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    ).distinct()
