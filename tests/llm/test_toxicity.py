import random
import zlib

import numpy as np

from tessera.llm import toxicity as tox


def test_features():
    words = tox.Words({"bomen": 5.0, "réê": 2.0})
    at = {name: i for i, name in enumerate(tox.FEATURES)}
    f = lambda text: tox.text_features(text, words)
    assert f("") == f(" \n") == [0.0] * len(tox.FEATURES)
    plain = f("the weather was good")
    assert plain[at["insults"]] == plain[at["stem_weight"]] == plain[at["hidden_hits"]] == 0
    for text in ("you idiot there now", "you 1d10t there now", "you IDIOT!!! there now", "you id.i-ot there now", "you idiooooot there now"):
        assert f(text)[at["insults"]] == 0.25 and f(text)[at["near_you"]] == 0.25, text
    assert f("you 1d10t there now")[at["hidden_hits"]] == 0.25 and f("so i d i o t now")[at["hidden_hits"]] > 0
    assert f("far idiot " + "word " * 10 + "you")[at["near_you"]] == 0
    assert f("un bomenteco y réêou.")[at["stem_weight"]] == (5.0 + 2.0) / 4 and f("un bomenteco y réêou.")[at["strong_stems"]] == 0.25
    assert f("ABC def")[at["shouted"]] == 0.5 and f("what?! no!!")[at["piled_marks"]] == 1.0
    assert len(f("x" * 500_000 + " you " * 10_000)) == len(tox.FEATURES)


def test_stems_are_those_of_toxic_texts(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice(["", "s", "ion"]) for _ in range(30)) for _ in range(300)]
    rows = [(0, t) for t in clean[:200]] + [(1, t + " gruk" + rng.choice(["ed", "ing", "ly"])) for t in clean[200:]] + [(1, None), (0, "")]
    found = tox.learn_stems(spark.createDataFrame(rows, "toxic int, text string").repartition(3))
    assert {"gruk", "gru"} <= set(found) and all(s.startswith("gru") for s in found)
    assert found["gruk"] > 4


def test_score_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = tox.train_model(docs, labels)
    odd = [(5000, None), (5001, ""), (None, "x y"), (5002, "word " * 50_000), (5002, "word " * 50_000)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string")).selectExpr("*", "1 AS value", "2 AS score", "3 AS toxic")
    rows = tox.score_documents(more, model).collect()
    assert len(rows) == docs.count() + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth and r.doc_id < 5000]
    held += [(r.predicted, r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth and r.doc_id > 5002]
    caught, kept = np.mean([p for p, _, y in held if y]), np.mean([not p for p, _, y in held if not y])
    assert caught > 0.85 and kept > 0.98, (caught, kept)
    # calibrated: scores are probabilities
    assert abs(np.mean([s for _, s, _ in held]) - np.mean([y for _, _, y in held])) < 0.03
    again = tox.train_model(docs.repartition(7), labels.repartition(3))
    assert (again.weights, again.trees, again.corners) == (model.weights, model.trees, model.corners)
    none = tox.train_model(docs, labels.limit(0))
    assert none is None and {(r.score, r.predicted) for r in tox.score_documents(docs.limit(5), none).collect()} == {(0.0, 0)}
    assert tox.score_documents(docs.limit(0), model).count() == 0


def test_small_and_odd_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    few = tox.train_model(docs, labels.selectExpr("*", "9 AS text").union(labels.selectExpr("doc_id", "quality", "toxic", "8").limit(10)).union(spark.createDataFrame([(None, 1, 1, 1), (1, 1, None, 1), (999, 1, 1, 1)], "doc_id bigint, quality int, toxic int, text int")))
    assert few is not None and tox.score_documents(docs, few).count() == docs.count()
    assert tox.train_model(docs.limit(0), labels) is None
    assert tox.train_model(docs, labels.filter("toxic = 0")) is None
