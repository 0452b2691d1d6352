import random

from tessera.operators.graph import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 130)] + [(500, 500 + i) for i in range(1, 40)]
    edges += [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(50)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges + edges[:5] + [(7, 7), (None, 3)], "src bigint, dst bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute(edges)
    assert connected_components(df.limit(0)).count() == 0
