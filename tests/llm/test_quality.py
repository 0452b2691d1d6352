import zlib

import numpy as np

from tessera.llm import quality


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    draw = lambda n, good: rng.normal(1.5 if good else -1.5, 1, (n, 3))
    p, u = draw(3000, True), np.concatenate([draw(2400, True), draw(1600, False)])
    rng.shuffle(u)
    model = quality.fit_model(p, u)
    assert abs(model.prior - 0.6) < 0.06
    good, bad = model.score(draw(2000, True)), model.score(draw(2000, False))
    assert (good >= 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.95


def test_fit_minimises_the_risk():
    """The risk written out anew: nearby weights, each with its best bias, have no lower one."""
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (400, 2)), np.concatenate([rng.normal(1, 1, (250, 2)), rng.normal(-1, 1, (250, 2))])
    prior, penalty = 0.5, 1e-3
    model = quality.fit_model(p, u, prior, penalty, steps=1500)
    a, b = (quality._design(x, model.cuts).astype(float) for x in (p, u))
    loss = lambda z: np.logaddexp(0, -z).mean()

    def risk(w):
        def at(bias):
            fp, fu = a @ w + bias, b @ w + bias
            return prior * loss(fp) + max(0.0, loss(-fu) - prior * loss(-fp)) + penalty * (w @ w) / 2

        return min(at(x) for x in np.linspace(-4, 4, 161))

    found = risk(model.weights)
    for size in (0.02, 0.1, 0.5):
        for _ in range(8):
            assert risk(model.weights + rng.normal(0, size, len(model.weights))) >= found - 2e-3
    assert risk(np.zeros(len(model.weights))) > found + 0.05


def test_score_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train_model(docs, labels)
    odd = [(5000, None), (5001, ""), (None, "x y"), (5002, "word " * 50_000), (5002, "word " * 50_000)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string")).selectExpr("*", "1 AS value", "2 AS score")
    rows = quality.score_documents(more, model).collect()
    assert len(rows) == docs.count() + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = quality.keep_good(more, model)
    assert kept.columns == more.columns
    assert kept.count() == sum(r.predicted for r in rows)
    none = quality.train_model(docs, labels.limit(0))
    assert none is None and {r.score for r in quality.score_documents(docs.limit(5), none).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_lowest_hashes(spark):
    ids = spark.range(20_000).selectExpr("id * 7 AS id")
    want = [r.id for r in ids.orderBy(quality.F.xxhash64("id", quality.F.lit("fit"))).limit(500).collect()]
    assert sorted(r.id for r in quality.lowest_hashes(ids.union(ids).union(ids.filter("id = 7").crossJoin(spark.range(5000).select())), 500).collect()) == sorted(want)
    assert quality.lowest_hashes(ids.limit(30), 500).count() == 30 and quality.lowest_hashes(ids.limit(0), 500).count() == 0
