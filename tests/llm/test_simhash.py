import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import fingerprints as prints
from tessera.llm import shingle_links
from tessera.llm.simhash_dedup import near_duplicates, shingle_simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(5, "x"), (5, "x"), (None, "X"), (900, None), (901, ""), (902, " \n"), (903, "a b\x0bc\x85d é e" * 9000), (None, "only here, without an id")]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    both = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(both).collect())
    fps = [brute_fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for _ in range(10):
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    low = {}
    for r, (key, _) in zip(root, rows):
        low[r] = min((k for k in (key, low.get(r)) if k is not None), default=None)
    want = [(-1 if k is None else k, f"{f:016x}", low[r]) for f, r, (k, _) in zip(fps, root, rows)]
    assert got == sorted(want, key=lambda x: x[:2] + (x[2] or 0,))
    assert near_duplicates(both.limit(0)).count() == 0


def test_shingle_simhash_long():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert shingle_simhash(text) == brute_fingerprint(text)


def check_edits(rows, got):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] or ""))
    want = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own, new, nxt = map(prints.term_simhash, (text, edited, after))
        want.append((key, n, hashlib.sha256(edited.encode()).hexdigest(), own.hex(), new.hex(), prints.likeness(own, new), prints.likeness(own, nxt)))
    for _, text in (r for r in rows if r[0] is None):
        want.append((None, len(text or ""), hashlib.sha256(text[: len(text) - len(text) // 2].encode()).hexdigest()))
    key = lambda x: tuple(map(str, x[:3]))
    assert [x[:3] for x in sorted(map(tuple, got), key=key)] == [x[:3] for x in sorted(want, key=key)]
    assert sorted((tuple(x)[:7] for x in got if x[0] is not None), key=key) == sorted((x for x in want if x[0] is not None), key=key)


def test_fingerprint_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(-4, "x\U0001F600y"), (7, "same"), (7, "same"), (5000, None), (5001, ""), (None, "none here"), (None, "none here")]
    both = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS place", "'a' AS id")
    for partitions in (1, 7, 400):
        check_edits(rows, prints.fingerprint_documents(both, partitions=partitions).collect())
    one = both.filter("doc_id = 5001")
    assert [tuple(r)[5:] for r in prints.fingerprint_documents(one).collect()] == [(1.0, 1.0)]
    assert prints.fingerprint_documents(both.limit(0)).count() == 0
    assert prints.fingerprint_documents(both.filter("doc_id is null")).count() == 2


@pytest.mark.parametrize("radius", [7, 11])
def test_near_counts(spark, sf_dir, radius):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = prints.fingerprint_table(docs, radius).collect()
    fps = [int(r.fingerprint, 16) for r in got]
    assert [r.n_near for r in got] == [sum((a ^ b).bit_count() <= radius for b in fps) - 1 for a in fps]


def test_meetings_of_many_texts(spark, monkeypatch):
    """Groups of few texts give all pairs that pass, larger ones stars and each row once, also where a group is held in parts."""
    monkeypatch.setattr(shingle_links, "_FEW", 3)
    monkeypatch.setattr(shingle_links, "_HELD", 10)
    rng = random.Random(3)
    rows = {k: (rng.randint(8, 12), sorted(rng.sample(range(40), rng.randint(1, 3))) + ([99] if k < 90 else [])) for k in range(120)}
    frame = spark.createDataFrame([(k, n, hs) for k, (n, hs) in rows.items()], "key bigint, n int, shingles array<bigint>").repartition(3)
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = shingle_links._meetings(frame, 0.8).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)
    at = {(k, h): i for k, (_, hs) in rows.items() for i, h in enumerate(hs)}
    passes = lambda a, b, h: all(rows[x][0] - at[x, h] >= 4 / 9 * (rows[a][0] + rows[b][0]) - 1e-6 for x in (a, b))
    pairs, rest = set(), []
    for h in {h for _, hs in rows.values() for h in hs}:
        own = sorted((rows[k][0], k) for k, (_, hs) in rows.items() if h in hs)
        keys = [k for _, k in own]
        some = [(keys[0], k) for k in keys[1:]] if len(keys) > 3 else [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
        pairs |= {(*sorted(p),) for p in some if passes(*p, h)}
        rest += [(h, k) for k in keys] if len(keys) > 3 else []
    assert {(*sorted((r.x, r.y)),) for r in got if r.pair} == pairs
    assert sorted((r.x, r.y) for r in got if not r.pair) == sorted(rest)
    assert all(rows[r.y][0] == r.n and at[r.y, r.x] == r.at for r in got if not r.pair)


def test_parity_print_loses_no_similar_pair():
    """Sets of Jaccard similarity 0.8 or more differ in no more bits than the bound; unrelated ones of up to 2,000 elements in more."""
    rng = np.random.default_rng(5)
    bits = lambda a, b: sum((int(x) ^ int(y)).bit_count() for x, y in zip(a.view("<u8"), b.view("<u8")))
    for n in (1, 2, 9, 40, 300, 2000, 30_000):
        for _ in range(20):
            base = rng.integers(0, 2**64, 2 * n, np.uint64)
            shared = int(rng.integers(n - n // 9, n + 1))  # of n: Jaccard shared / (2 n - shared)
            a, b = base[:n], base[n - shared : 2 * n - shared]
            similar = shared / (2 * n - shared) >= 0.8
            apart = bits(shingle_links.parity_print(a), shingle_links.parity_print(b))
            assert apart <= 2 * (n - shared) and (not similar or apart <= 0.2 / 1.8 * 2 * n + 1e-6)
            if 40 <= n <= 2000:
                assert bits(shingle_links.parity_print(base[:n]), shingle_links.parity_print(base[n:])) > 0.2 / 1.8 * 2 * n
    assert len(shingle_links.parity_print(np.zeros(0, np.uint64))) == 16


def test_link_similar(spark, monkeypatch):
    """Components by shingle sets alone equal brute force, with a passage that many texts share, copies, chains of edits and short texts."""
    monkeypatch.setattr(shingle_links, "_FEW", 3)
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passage = [word() for _ in range(60)]
    texts = ["", "one two", "one two", "One two"]
    for _ in range(14):
        base = [word() for _ in range(rng.choice((12, 60, 150)))] + (passage if rng.random() < 0.8 else [])
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
    texts = list(dict.fromkeys(texts)) * 2
    frame = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) AS key", "text").repartition(3)
    nodes = frame.select("key", "key").toDF("key", "node").distinct()
    got = {r.node: r.component for r in shingle_links.link_similar(frame, nodes, nodes.filter("false").toDF("src", "dst"), sample=5).collect()}
    own = list({(r.key, r.text) for r in frame.collect()})
    sets = [set(shingle_links.shingle_set(t).tolist()) for _, t in own]
    root = [k for k, _ in own]
    for _ in range(8):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if len(x & y) >= 0.8 * len(x | y) > 0:
                    root[i] = root[j] = min(root[i], root[j])
    groups = lambda pairs: sorted(sorted(k for k, c in pairs if c == one) for one in {c for _, c in pairs})
    assert groups(got.items()) == groups([(k, r) for (k, _), r in zip(own, root)])
    assert len(set(root)) < len(root)
