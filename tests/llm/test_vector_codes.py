import hashlib
import math

import numpy as np
import pytest

from tessera.llm import vector_codes as vc
from tessera.llm.queries import QUERIES


def brute(rows, positions=8, entries=16, rounds=6):
    """Plain Lloyd in Python's own integers: {row number: (code, error, label_error)} and the digest."""
    kept = [(i, v, [math.floor(4096 * x) for x in e], label) for i, (v, e, label) in enumerate(rows) if e and all(x is not None and math.isfinite(x) for x in e)]
    seeds = [x for _, _, x, _ in sorted((r for r in kept if r[1] is not None), key=lambda r: (r[1], r[2]))[:entries]]
    width = len(seeds[0]) // positions
    part = lambda x, p: x[p * width : (p + 1) * width]
    books = [[part(x, p) for x in seeds] for p in range(positions)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda j: (dist(part(x, p), books[p][j]), j)) for p in range(positions)] for _, _, x, _ in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(positions):
            for j in range(len(books[p])):
                mine = [part(x, p) for (_, _, x, _), c in zip(kept, codes) if c[p] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    codes = assign()
    errors = [sum(dist(part(x, p), books[p][c[p]]) for p in range(positions)) for (_, _, x, _), c in zip(kept, codes)]
    per = {}
    for (_, _, _, label), e in zip(kept, errors):
        per[label] = per.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(v), "".join(f"{j:02x}" for j in c), e, per[label]) for (_, v, _, label), c, e in zip(kept, codes, errors)), digest


def report(spark, rows, kind="array<float>", partitions=3, **options):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}, label int").selectExpr("*", "'x' AS id", "'y' AS code", "1 AS error", "2 AS vector")
    got = vc.code_report(*vc.train_codes(frame.repartition(partitions), **options)).collect()
    assert len({r.codebooks_sha256 for r in got}) <= 1
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got), got[0].codebooks_sha256 if got else None


def test_query_equals_plain_lloyd(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = QUERIES["op13_vector_codes"](spark, sf_dir)
    assert {"vec_id", "code", "error", "label_error", "codebooks_sha256"} <= set(got.columns)
    rows = got.collect()
    want, digest = brute([(r.vec_id, r.embedding, r.label) for r in table.collect()])
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in rows) == want and {r.codebooks_sha256 for r in rows} == {digest}


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    coarse = lambda: [float(x) / 4096 for x in rng.integers(-3, 3, 16)]  # noqa: E731  many ties
    rows = [(int(i), coarse(), int(rng.integers(3))) for i in rng.permutation(300)]
    rows += [(7, rows[0][1], None), (7, rows[0][1], None), (None, coarse(), None), (None, coarse(), 1), (400, None, 1), (401, [], 1), (402, [float("nan")] * 16, 1)]
    rows += [(403, [None] + [0.0] * 15, 1), (404, [float("inf")] + [0.0] * 15, 1), (405, [1e4] * 16, 2), (-5, [-7.3] * 16, 2)]
    want, digest = brute([r if r[0] != 405 else (405, [2048.0] * 16, 2) for r in rows])
    assert report(spark, rows) == (want, digest)
    assert report(spark, rows, kind="array<double>", partitions=1) == (want, digest)


def test_few_and_no_vectors(spark):
    assert report(spark, []) == ([], None)
    assert report(spark, [(1, None, 2)]) == ([], None)
    rows = [(i, [i / 7, -i / 3] * 4, 0) for i in range(5)]
    assert report(spark, rows, positions=4, entries=16) == brute(rows, positions=4)
    assert report(spark, rows * 3 + [(9, [1.0], 0)], positions=2, entries=2, rounds=1) == brute(rows * 3, 2, 2, 1)
    with pytest.raises(ValueError):
        report(spark, rows, positions=3)


def test_heaps_pop_few_and_miss_none():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(16, size=4000)] + rng.integers(-150, 150, (4000, 8)))[:, None, :]
    books, popped = vc.Codebooks(x[:16].transpose(1, 0, 2).astype(np.int64)), []
    heaps, sums, counts = vc.first_heaps(x, books)
    for _ in range(12):
        books.move(sums, counts)
        stats = {}
        sums, counts = vc.advance(x, heaps, books, stats)
        best, _, _ = vc.measure(x[:, 0], books.entries[0])
        assert all((best[h.parts] == j).all() for j, h in enumerate(heaps[0])) and sum(len(h.parts) for h in heaps[0]) == 4000
        popped.append(stats["popped"])
    assert popped[-1] < 400 and books.counts.sum() == 4000
