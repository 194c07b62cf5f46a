"""Neighbours of vectors and near-duplicate texts against brute force."""

import random

import numpy as np
import pytest

from quillspark.llm import near_duplicates, neighbours
from quillspark.llm.hnsw import FlatGraph


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.5 * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def brute(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_graph_recall():
    x = clustered(2_000, 32, 1)
    graph = FlatGraph(x)
    truth = brute(x, 5)
    for own in (np.arange(len(x)), None):
        near, _ = graph.search(x, 6, own=own)
        assert np.mean([len(set(near[i]) & set(truth[i])) / 5 for i in range(len(x))]) > 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_tiny_graphs(n):
    x = clustered(n, 8, 2) if n else np.zeros((0, 8), np.float32)
    near, sims = FlatGraph(x).search(x, 3) if n else (np.zeros((0, 3)), None)
    assert near.shape == (n, 3) and all(len(set(r[r >= 0])) == min(n, 3) for r in near)


def test_neighbours(spark):
    x = clustered(900, 16, 3) * 2.5
    rows = [(f"v{i:04d}", x[i].tolist()) for i in range(len(x))]
    rows += rows[:20] + [("null", None), ("short", [1.0]), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "id string, values array<float>").repartition(4)
    truth = brute(x / np.linalg.norm(x, axis=1)[:, None], 5)
    # one shard, several shards, and shards that are split
    # (with shards of 20 rows also several tasks for one part)
    # (and two levels of shards, also with crowded ones)
    for options in (
        {}, {"shard_rows": 150}, {"shard_rows": 60, "sample_rows": 300}, {"shard_rows": 20, "sample_rows": 300, "probes": 8, "margin": 0.4},
        {"shard_rows": 60, "first_level": 4, "probes": 5, "margin": 0.3}, {"shard_rows": 15, "first_level": 6, "probes": 8, "margin": 0.4},
    ):
        got = neighbours.nearest(df, dim=16, **options).collect()
        found = {}
        for r in got:
            found.setdefault(r.id, set()).add(r.neighbour)
        assert len(found) == 900 and all(len(v) == 5 for v in found.values())
        recall = np.mean([len(found[f"v{i:04d}"] & {f"v{j:04d}" for j in truth[i]}) / 5 for i in range(900)])
        assert recall > 0.9, options
    pairs = neighbours.neighbour_pairs(neighbours.nearest(df, dim=16))
    assert pairs.where("id_a >= id_b").count() == 0 and pairs.count() == pairs.distinct().count()


def test_neighbours_of_equal_and_few_vectors(spark):
    rows = [(f"a{i}", [1.0, 0.0]) for i in range(8)] + [("b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, values array<float>")
    got = {}
    for r in neighbours.nearest(df, dim=2, k=3).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert [n for _, n in sorted(got["a0"])] == ["a1", "a2", "a3"]
    assert [n for _, n in sorted(got["b"])] == ["a0", "a1", "a2"]
    for first_level in (1, 3):
        two = {(r.id, r.neighbour, r["rank"]) for r in neighbours.nearest(df, dim=2, k=3, shard_rows=2, first_level=first_level, probes=9, margin=2.0).collect()}
        assert two == {(r.id, r.neighbour, r["rank"]) for r in neighbours.nearest(df, dim=2, k=3).collect()}
    assert neighbours.nearest(df.limit(0), dim=2).count() == 0
    assert neighbours.nearest(df.limit(1), dim=2).count() == 0


def jaccard(a, b, width):
    p, q = (set(near_duplicates.shingles(t, width).tolist()) for t in (a, b))
    return len(p & q) / len(p | q) if p and q else 0.0


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3_000)]
    out = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        out.append(base)
        if rng.random() < 0.4:
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[len(copy) // 2 :] + copy[: len(copy) // 2]
            out.append(copy)
    return [" ".join(x) for x in out]


def test_bk_tree():
    rng = random.Random(5)
    values = list({rng.getrandbits(16) for _ in range(300)})
    tree = near_duplicates.BKTree()
    for v in values:
        tree.add(v)
    for probe in values[:20] + [rng.getrandbits(16) for _ in range(20)]:
        got = {tree.values[i] for i in tree.within(probe, 4)}
        assert got == {v for v in values if (v ^ probe).bit_count() <= 4}
    assert near_duplicates.BKTree().within(3, 5) == []


@pytest.mark.parametrize("width,threshold", [(3, 0.5), (5, 0.8)])
def test_near_duplicates(spark, width, threshold):
    rows = [(f"t{i:04d}", t) for i, t in enumerate(texts(300, 7))]
    rows += rows[:9] + [("same", rows[0][1].upper() + "!"), ("null", None), ("empty", ""), ("short", "two words"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "id string, text string").repartition(3)
    found = near_duplicates.expanded(near_duplicates.similar_pairs(df, width=width, threshold=threshold))
    got = {(r.id_a, r.id_b) for r in found.collect()}
    unique = dict(r for r in rows if r[0] and r[1])
    ids = sorted(unique)
    truth = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(unique[a], unique[b], width) >= threshold}
    assert got <= truth and len(got) >= 0.97 * len(truth) and ("same", "t0000") in got


def test_hot_shards_are_divided(spark):
    """More texts share a band key than a shard holds: the blocks' pairs give the same result."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(60)] = f"x{i}"
        rows.append((f"t{i:02d}", " ".join(copy)))
    df = spark.createDataFrame(rows, "id string, text string").repartition(3)
    pairs = lambda n: {(r.id_a, r.id_b) for r in near_duplicates.expanded(near_duplicates.similar_pairs(df, width=3, threshold=0.5, shard_rows=n)).collect()}
    truth = {(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if jaccard(x, y, 3) >= 0.5}
    assert pairs(4_096) == truth
    assert pairs(5) == truth


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert near_duplicates.expanded(near_duplicates.similar_pairs(empty)).count() == 0


def test_groups(spark):
    """A chain of texts, each like the next only, is one group; copies count as links."""
    words = [f"w{i}" for i in range(400)]
    rows = [(f"c{i}", " ".join(words[i * 12 : i * 12 + 60])) for i in range(14)]
    rows += [("copy", rows[0][1]), ("alone", " ".join(f"z{i}" for i in range(60))), ("null", None), ("c3", rows[3][1])]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: r for r in near_duplicates.groups(near_duplicates.similar_pairs(df, width=3, threshold=0.5)).collect()}
    unique = dict(r for r in rows if r[1])
    assert set(got) == set(unique)
    assert len({got[f"c{i}"].group for i in range(14)} | {got["copy"].group}) == 1 and got["alone"].group != got["c0"].group
    for i, text in unique.items():
        assert got[i].links == sum(jaccard(text, t, 3) >= 0.5 for j, t in unique.items() if j != i)


def test_an_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(200)]
    one, other = " ".join(words[:60]), " ".join(words[100:160])
    rows = [("a", one), ("a", other), ("b", " ".join(words[:58])), ("c", " ".join(words[102:160]))]
    df = spark.createDataFrame(rows, "id string, text string")
    found = near_duplicates.similar_pairs(df, width=3, threshold=0.5)
    assert {(r.id_a, r.id_b) for r in near_duplicates.expanded(found).collect()} == {("a", "b"), ("a", "c")}
