import random
import zlib

import numpy as np

from tessera.llm import packing
from tessera.llm.queries import vocabulary
from tessera.llm.tokens import WordEncoder

ODD = ["", "Don't STOP's 12²½ ª_x", "İstanbul ΣΑΣ é é", "a\x1cb\x85c\xa0d e", "<|endoftext|> x<|ENDOFTEXT|>", "日本語 テキスト", "word " * 5000]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_encoder_equals_tokenizer(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    own = WordEncoder(vocabulary("word_bpe_49k.json"), max_words=500).encode(texts)
    for text, data in zip(texts, own):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids, text[:50]


def brute(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, free in enumerate(bins) if free >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(size - x)
    return bins


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.choice([1, 7, 30, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        bins, seen = {}, {x: set() for x in histogram}
        for length, a, b, first, offset in packing.best_fit_decreasing(histogram, size):
            for k in range(b - a + 1):
                seen[length].add(a + k)
                bins.setdefault(first + k, []).append((offset, length))
        assert all(seen[x] == set(range(n)) for x, n in histogram.items())
        for pieces in bins.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= size
        assert sorted(size - sum(x[1] for x in p) for p in bins.values()) == sorted(brute(lengths, size))


def test_free_tree():
    rng, tree, open_ = random.Random(2), packing.FreeTree(50), set()
    for _ in range(2000):
        c = rng.randint(0, 50)
        tree.mark(c, c not in open_)
        open_ ^= {c}
        least = rng.randint(0, 50)
        assert tree.tightest(least) == min((x for x in open_ if x >= least), default=None)


def test_pack_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, ODD[1]), (1, ODD[1]), (None, "a"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("length", packing.F.lit("clash"))
    out = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), size=64).toPandas()
    tok = tokenizer()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 64)):
            own = np.array(ids[start : start + 64], "<u4")
            want.append((-1 if i is None else i, k, start, len(own), zlib.crc32(own.tobytes())))
    got = out.assign(doc_id=out.doc_id.fillna(-1).astype(int))
    assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == sorted(want)
    for _, group in out.groupby("sequence_id"):
        ends = 0
        for row in group.sort_values("offset").itertuples():
            assert row.offset == ends
            ends += row.length
        assert ends <= 64
    empty = packing.pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json"))
    assert empty.count() == 0


def test_every_letter_is_encoded_as_by_the_tokenizer():
    from tessera.llm.queries import vocabulary
    from tessera.llm.tokens import WordEncoder

    path = vocabulary("word_bpe_49k.json")
    encoder = WordEncoder(path)
    marks = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [0x1F600, 0xE0001, 0x10FFFF]
    texts = [t for c in marks for t in (f"A{chr(c)}b x{chr(c)}, y", chr(c))] + ["Əliyev Ɔkomfo", "ƎƟƩ ɎɄ", "Ɓukar Ɗan Ƙasa"]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = encoder._one_by_one(part)
        wrong = [t for t, a, b in zip(part, encoder.encode(part), want) if a != b]
        assert not wrong, [ascii(t) for t in wrong[:20]]
