import random

import numpy as np
import pytest

from tessera.llm import hamming
from tessera.operators.graph import connected_components


def clustered(rng, n, words):
    out = set()
    while len(out) < n:
        centre = [rng.getrandbits(64) for _ in range(words)]
        for _ in range(rng.choice([1, 1, 3, 30])):
            x = list(centre)
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(words)] ^= 1 << rng.randrange(64)
            out.add(tuple(x))
    return [tuple(v - 2**64 if v >= 2**63 else v for v in x) for x in out]


def near(a, b):
    return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))


@pytest.mark.parametrize(("hot", "blocks"), [(20_000, 5), (3, 5), (3, 6)])
def test_linking_edges(spark, hot, blocks, monkeypatch):
    points = clustered(random.Random(5), 260, 1)
    df = spark.createDataFrame(points, "fp bigint")
    edges = hamming.linking_edges(df, "fp", 64, 4, blocks, hot)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = {p[0]: p[0] for p in points}
    for _ in range(20):
        for a in points:
            for b in points:
                if near(a, b) <= 4:
                    want[a[0]] = want[b[0]] = min(want[a[0]], want[b[0]])
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert got == {k: v for k, v in want.items() if sizes[v] > 1}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_neighbour_counts(spark, hot):
    rng = random.Random(6)
    points = clustered(rng, 200, 2)
    weights = {p: rng.randint(1, 4) for p in points}
    df = spark.createDataFrame([(*p, weights[p]) for p in points], "w0 bigint, w1 bigint, n bigint")
    got = {(r.w0, r.w1): r.n_near for r in hamming.neighbour_counts(df, ["w0", "w1"], "n", 7, 8, hot).collect()}
    want = {a: sum(weights[b] for b in points if b != a and near(a, b) <= 7) for a in points}
    assert got == {k: v for k, v in want.items() if v}


def test_trees_lose_no_pair(monkeypatch):
    monkeypatch.setattr(hamming, "LEAF", 16)
    x = np.array(clustered(random.Random(7), 700, 1), dtype=np.int64).view(np.uint64)
    full = hamming.distances(x[:, None], x[None]) <= 4
    want = {(i, j) for i, j in zip(*np.nonzero(full)) if i < j}
    found = [tuple(sorted(p)) for i, j in hamming.tree_pairs(x, 4, np.arange(len(x))) for p in zip(i.tolist(), j.tolist())]
    assert len(found) == len(set(found)) and set(found) == want
    together = {tuple(sorted(p)) for leaf in hamming.tree_leaves(x, 4, np.arange(len(x))) for p in zip(*(leaf[k] for k in np.nonzero(full[np.ix_(leaf, leaf)]))) if p[0] != p[1]}
    assert together == want


def test_dense_group_is_split_and_linked(spark):
    """Many distinct fingerprints around one: the trees split them, two vantage points deal them to several cells."""
    rng, centre = random.Random(11), random.Random(12).getrandbits(64)
    points = {centre}
    while len(points) < 1500:
        x = centre
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << bit
        points.add(x)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "fp bigint")
    sharded = hamming.shards(df, ["fp"], hamming.block_masks(64, 4, 6), 4, 100)
    assert sharded.filter("cell > 0").select("table", "key", "cell").distinct().count() > 50
    edges = hamming.linking_edges(df, "fp", 64, 4, 6, 100)
    assert edges.count() < 200 * len(points)
    assert connected_components(edges).select("component").distinct().count() == 1


def test_vantage_trees_alone_do_not_select():
    """The figure behind block tables as first partition: a tree over unrelated fingerprints compares most pairs."""
    x = np.array([[random.Random(i).getrandbits(64)] for i in range(6000)], dtype=np.uint64)
    compared = sum(len(leaf) * (len(leaf) - 1) // 2 for leaf in hamming.tree_leaves(x, 4, np.arange(len(x))))
    share = compared / (len(x) * (len(x) - 1) / 2)
    print(f"pairs compared by vantage trees alone: {share:.2f} of all")
    assert share > 0.2  # 15 tables of 21 bits compare 15 / 2**21 of them
