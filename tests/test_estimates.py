import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import sampling, sketches, vectors
from tessera.plans.registry import QUERIES


def test_nearest_equals_all_products(spark):
    rng = np.random.default_rng(1)
    coarse = lambda: [float(x) / 4 for x in rng.integers(-2, 3, 6)]  # noqa: E731  many ties
    rows = [(i, coarse()) for i in range(150)] + [(7, coarse()), (None, coarse()), (300, None), (301, [1.0]), (302, [float("nan")] * 6), (303, [None] * 6), (304, [float("inf")] * 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS score", "3 AS query").repartition(5)
    fine = [(i, v) for i, v in rows if i is not None and i < 300]
    queries = frame.filter("vec_id % 10 = 0 OR vec_id = 7")
    for k, per_pass, fan in ((5, 2048, 32), (5, 4, 1), (400, 7, 2)):
        got = {}
        for r in vectors.nearest(frame, queries, k, per_pass=per_pass, fan=fan).collect():
            got.setdefault(r.query, []).append((r.rank, r.id, r.score))
        assert set(got) == {0, 7, *range(0, 150, 10)}
        for q, found in got.items():
            if q == 7:
                continue  # two vectors share this id; either may ask
            own = dict(fine)[q]
            want = sorted((-round(sum(a * b for a, b in zip(own, v)), 9), i) for i, v in fine if i != q)[:k]
            assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in sorted(found)] and [n for n, _, _ in sorted(found)] == list(range(1, len(want) + 1))
    assert vectors.nearest(frame, queries.limit(0)).count() == 0 and vectors.nearest(frame.limit(0), queries).count() == 0
    plan = vectors.nearest(frame, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and plan.count("WindowGroupLimit") >= 2


def test_merged_sketches_keep_their_bounds(spark):
    frame = spark.range(200_000).selectExpr("id % 40 AS day", "id % 4 AS part", "CASE WHEN id % 11 = 0 THEN NULL ELSE id * 7 % 60000 END AS v", "double(id * 7919 % 100003) AS x")
    made = sketches.distinct_sketches(frame, [F.col("day"), F.col("part")], "v")
    exact = frame.groupBy("part").agg(F.count_distinct("v").alias("n"))
    for r in sketches.merged_distinct(made, [F.col("part")]).join(exact, "part").collect():
        assert abs(r.hll - r.n) <= 4 * sketches.HLL_ERROR * r.n and abs(r.theta - r.n) <= 4 * sketches.THETA_ERROR * r.n
    a, b = (sketches.merged_distinct(made.filter(c), [F.lit(1).alias("k")]).select("k", F.col("sketch").alias(n)) for c, n in (("part < 2", "a"), ("part > 0", "b")))
    va, vb = ({r.v for r in frame.filter(c).select("v").distinct().collect() if r.v is not None} for c in ("part < 2", "part > 0"))
    union, both, only = a.join(b, "k").select(*sketches.overlap(F.col("a"), F.col("b"))).first()
    error = 4 * sketches.THETA_ERROR * len(va | vb)
    assert all(abs(x - y) <= error for x, y in ((union, len(va | vb)), (both, len(va & vb)), (only, len(va - vb))))
    quantiles = sketches.merged_quantiles(sketches.quantile_sketches(frame, [F.col("day"), F.col("part")], "x"), ["part"], [0.01, 0.5, 0.99])
    off = sketches.rank_errors(frame, quantiles, ["part"], "x").collect()
    assert len(off) == 12 and all(r.off <= sketches.KLL_ERROR for r in off)
    assert sketches.merged_distinct(sketches.distinct_sketches(frame.limit(0), [F.col("day")], "v"), [F.col("day")]).count() == 0


def test_rank_errors_are_exact(spark):
    frame = spark.createDataFrame([("a", float(x)) for x in (1, 1, 2, 2, 2, 3, 9, 9, 9, 10)] + [("a", None)], "g string, v double")
    guesses = spark.createDataFrame([("a", 0.5, 2.0), ("a", 0.9, 2.0), ("a", 0.1, 9.0)], "g string, share double, estimate double")
    got = {r.share: round(r.off, 9) for r in sketches.rank_errors(frame, guesses, ["g"], "v").collect()}
    assert got == {0.5: 0.0, 0.9: 0.4, 0.1: 0.5}


def test_frequent_items(spark):
    rng = random.Random(3)
    rows = [(i % 5, "g", int(abs(rng.gauss(0, 40)))) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "day int, g string, v int")
    found = sketches.merged_frequent(sketches.frequent_sketches(frame, [F.col("day"), F.col("g")], "v"), ["g"], 10).collect()
    counts = Counter(v for _, _, v in rows)
    assert all(abs(r["count"] - counts[r["item"]]) <= 0.01 * len(rows) for r in found) and {v for v, _ in counts.most_common(3)} <= {r["item"] for r in found}


def test_samples_depend_on_rows_alone(spark):
    frame = spark.range(3000).selectExpr("id", "id % 3 AS s", "CASE WHEN id % 50 = 0 THEN 100.0 WHEN id % 7 = 0 THEN 0.0 ELSE 1.0 END AS w")
    pick = lambda f: sorted(r.id for r in f.collect())
    small, large = pick(sampling.hash_sample(frame, "id", 0.1)), pick(sampling.hash_sample(frame.repartition(9), "id", 0.3))
    assert set(small) < set(large) and abs(len(small) - 300) < 80 and small != pick(sampling.hash_sample(frame, "id", 0.1, "other"))
    by = Counter(r.s for r in sampling.stratified_sample(frame, "id", "s", {0: 1.0, 1: 0.1}).collect())
    assert by[0] == 1000 and 50 < by[1] < 160 and by[2] == 0
    drawn = pick(sampling.weighted_sample(frame, "id", "w", 40))
    assert drawn == pick(sampling.weighted_sample(frame.repartition(11), "id", "w", 40, deals=3)) and len(drawn) == 40
    draws = {r.id: r.d for r in frame.select("id", sampling.draw(F.col("id")).alias("d")).collect()}
    weight = {r.id: float(r.w) for r in frame.collect()}
    assert drawn == sorted(sorted((i for i in weight if weight[i] > 0), key=lambda i: (-math.log(draws[i]) / weight[i], i))[:40])
    heavy = sum(i % 50 == 0 for i in drawn)
    assert heavy > 15  # 60 rows of weight 100 against 2,500 of weight 1
    per = sampling.weighted_sample(frame.withColumn("w", F.when(F.col("id") > 10, F.col("w"))), "id", "w", 5, ["s"]).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in per} == {0: 5, 1: 5, 2: 5}
    assert sampling.weighted_sample(frame.limit(0), "id", "w", 5).count() == 0 and pick(sampling.weighted_sample(frame.filter("w > 50"), "id", "w", 500)) == list(range(0, 3000, 50))


def test_estimates_hold_on_larger_tables(spark):
    for name in ("distinct_sketches", "sketch_overlap", "quantile_sketches", "frequent_sketches"):
        for r in QUERIES[name](spark, "/root/testdata/sf0.1").collect():
            assert all(v for v in r.asDict().values() if isinstance(v, bool)), (name, r)
