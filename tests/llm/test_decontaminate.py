import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated, items_near, simhash, without_contamination


def words_of(text):
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def brute(docs, bench):
    items = {}
    for i, t in bench:
        w = words_of(t or "")
        if i is not None and w:
            k = min(5, len(w))
            items[i] = (k, [tuple(w[a : a + k]) for a in range(len(w) - k + 1)])
    having = Counter((k, s) for k, ss in items.values() for s in set(ss))
    out = []
    for key, text in docs:
        w = words_of(text or "")
        for i, (k, ss) in items.items():
            own = [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]
            need = Counter(ss)
            total = sum(n / having[k, s] for s, n in need.items())
            best = None
            starts = {max(0, min(p - a, len(own) - len(ss))) for p, s in enumerate(own) for a, x in enumerate(ss) if x == s}
            for start in starts:
                win = Counter(own[start : start + len(ss)])
                sim = round(sum(min(n, win[s]) / having[k, s] for s, n in need.items()) / total, 6)
                if sim >= 0.8 and (best is None or (sim, -start) > (best[0], -best[1])):
                    best = (sim, start)
            if best:
                out.append((str(key), i, *best))
    return sorted(out)


def test_equals_brute_force(spark, sf_dir):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    first, second = bench[0][1], bench[1][1]
    changed = first.split()
    changed[20] = "other"
    docs += [
        (900, first), (900, first), (None, "before " + first), (901, None), (902, ""), (903, second + " " + first + " " + second), (904, " ".join(changed) + " tail"),
        (905, " ".join(first.split()[:20])), (906, "two words here"), (907, ("filler " * 30_000) + first.upper().replace(" ", ",  ")), (908, "one two three four five six seven eight"),
    ]
    bench += [(500, "Two words!"), (501, None), (502, ""), (None, "alone"), (503, first + " " + "x y z w v " * 3), (504, "one two three four five six nine eight")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS key", "2 AS item_id", "3 AS h")
    b = spark.createDataFrame(bench, "item_id bigint, text string").selectExpr("*", "1 AS key")
    got = contaminated(d, b).collect()
    assert sorted((str(r.doc_id), r.item_id, r.similarity, r.start_word) for r in got) == brute(docs, bench)
    assert {r.item_id for r in got if r.doc_id == 904} == {0}
    shuffled = contaminated(d, b, broadcast_rows=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))
    bad = {str(r.doc_id) for r in got}
    kept = without_contamination(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, t in docs if str(k) not in bad)
    assert contaminated(d.limit(0), b).count() == 0
    assert contaminated(d, b.limit(0)).count() == 0


def test_items_that_share_most_of_their_wording(spark):
    stem = [f"stem{i}" for i in range(28)]
    bench = [(i, " ".join(stem + [f"own{i}x{j}" for j in range(16)])) for i in range(10)]
    # windows with an item's own words after other ones: few shared shingles, most of the weight
    docs = [(i, " ".join(f"pre{i}x{j}" for j in range(40)) + " " + " ".join(stem[24:] + [f"own{i % 10}x{j}" for j in range(16)])) for i in range(30)]
    docs += [(100 + i, " ".join(stem + [f"other{i}x{j}" for j in range(16)])) for i in range(5)]
    got = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.item_id, r.similarity, r.start_word) for r in got) == brute(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 10) for i in range(30)}


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(1)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    items = [(i, 5, i % 2, rng.getrandbits(64)) for i in range(60)]
    windows = []
    for k in range(200):
        fp = rng.choice(items)[3]
        for bit in rng.sample(range(64), rng.randint(0, 26)):
            fp ^= 1 << bit
        windows.append((k, 5, k % 2, fp))
    got = items_near(spark.createDataFrame([(*w[:3], signed(w[3])) for w in windows], "k int, width int, m int, fp bigint"), spark.createDataFrame([(*i[:3], signed(i[3])) for i in items], "item_id int, width int, m int, fp bigint"), 20)
    want = sorted((w[0], i[0]) for w in windows for i in items if w[2] == i[2] and (w[3] ^ i[3]).bit_count() <= 20)
    assert sorted((r.k, r.item_id) for r in got.collect()) == want


def test_recall_of_the_radius(spark):
    """Windows of weighted similarity 0.8 to 0.85, shingles of unequal weights: the share within 20 bits."""
    rng, rows = random.Random(9), []
    for k in range(1500):
        m = rng.randint(12, 60)
        weights = [1 / rng.choice([1, 1, 1, 2, 5, 30]) for _ in range(m)]
        total, order = sum(weights), rng.sample(range(m), m)
        left, gone = 0.2 * total, set()
        for i in order:  # leave out shingles as long as 0.8 of the weight stays
            if weights[i] <= left:
                left -= weights[i]
                gone.add(i)
        for i in range(m):
            h = rng.getrandbits(64) - 2**63
            rows.append((k, 0, h, 1, weights[i]))
            if i not in gone:
                rows.append((k, 1, h, 1, weights[i]))
    prints = simhash(spark.createDataFrame(rows, "k int, side int, h bigint, n bigint, weight double"), ["k", "side"])
    far = prints.groupBy("k").agg(F.bit_xor("fp").alias("x")).filter(F.bit_count("x") > 20).count()
    assert far <= 3
