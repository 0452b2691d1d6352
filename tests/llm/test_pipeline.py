import random
import re

import corpus_pipeline
from tessera.llm.simhash_dedup import keep_one, shingle_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, seen = None, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, sf_dir), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert sorted(docs.columns) == sorted(COLUMNS)
            assert before is None or {r.doc_id for r in seen[name]} <= before
            before = {r.doc_id for r in seen[name]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"]}
    assert sum(labels[k] for k in labels if k in kept) >= 0.95 * sum(labels.values())
    # brute force: smallest id of each group of texts linked by fingerprints or shingle sets
    rows = sorted(seen["quality"], key=lambda r: r.doc_id)
    fps, sets, root = [shingle_simhash(r.text) for r in rows], [shingles(r.text) for r in rows], list(range(len(rows)))
    for _ in range(8):
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id for r in seen["near_dedup"]} == {rows[i].doc_id for i in range(len(rows)) if root[i] == i}
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    held = lambda r: any(words(b) in words(r.text) for b in bench)
    assert {r.doc_id for r in seen["decontaminate"]} <= {r.doc_id for r in seen["near_dedup"] if not held(r)}
    assert sum(map(held, seen["near_dedup"])) > 0
    texts = {r.doc_id: r.text for r in seen["decontaminate"]}
    assert {r.doc_id for r in seen["secrets"]} == set(texts)
    assert all(r.n_chars == len(r.text) and not re.search("AKIA[A-Z0-9]{16}", r.text) for r in seen["secrets"])
    secret = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|password=[A-Za-z0-9]{6}")
    assert {r.doc_id for r in seen["secrets"] if "[SECRET]" in r.text} >= {k for k, t in texts.items() if secret.search(t)}
    assert all(r.text == texts[r.doc_id] for r in seen["secrets"] if "[SECRET]" not in r.text)
    assert {r.doc_id for r in seen["packing"]} == set(texts)


def test_run_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", None, 3), (3, "same words in this text", "en", "s", 1), (3, "same words in this text", "en", "s", 1), (4, "x " * 30_000, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, None, 3, 4}
    assert keep_one(docs).filter("doc_id = 3").count() == 1


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_drops_near_copies(spark, sf_dir):
    rng, texts = random.Random(3), []
    for n in (5, 40, 60, 90, 200, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(100)]
    for i in range(60):  # neighbours are similar, ends are not; all share one passage
        texts.append(" ".join(chain[: 100 - i] + [f"d{j}" for j in range(i)]))
    texts += [" ".join(["one common line of the house"] + [f"u{i}x{j}" for j in range(30)]) for i in range(50)] + ["", "a b", "A  b", "a b c"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    fps, sets, root = [shingle_simhash(t) for t in texts], [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    only_jaccard = 0
    for i in range(len(texts)):
        for j in range(i):
            near, alike = (fps[i] ^ fps[j]).bit_count() <= 4, 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0
            only_jaccard += alike and not near
            if near or alike:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert only_jaccard > 20
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert got == {i for i in range(len(texts)) if find(i) == i}


def test_repeated_ids_have_a_defined_outcome(spark):
    rows = [(3, "z later text", "en", {"k": 1}), (3, "a first text of two", "de", {"k": 2}), (3, "a first text of two", "aa", {"k": 3}), (4, "lonely words stand here", None, None), (None, "no id", None, None), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, m map<string,int>")
    for partitions in (1, 3):
        got = keep_one(docs.repartition(partitions)).collect()
        assert sorted((str(r.doc_id), r.text, str(r.lang)) for r in got) == [("3", "a first text of two", "aa"), ("4", "lonely words stand here", "None"), ("None", "no id", "None"), ("None", "no id", "None")]
