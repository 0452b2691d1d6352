import random

from tessera.llm.queries import vocabulary
from tessera.llm.token_counts import PieceAutomaton, count_pieces, load_pieces


def greedy(word, pieces):
    at = total = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, total = end, total + 1
    return total


def test_automaton_is_greedy_longest_match():
    rng = random.Random(3)
    for _ in range(200):
        pieces = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = PieceAutomaton(pieces)
        for _ in range(40):
            word = "".join(rng.choices("abcd" if rng.random() < 0.1 else "abc", k=rng.randint(0, 12)))
            assert automaton.count(word) == greedy(word, pieces), (pieces, word)


def test_count_pieces(spark, sf_dir):
    pieces = set(load_pieces(vocabulary("piece_bpe_32k.model")))
    texts = ["", None, "a b\tc", "Ωx 日本 \U0001F600", "word " * 20000] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    rows = [*enumerate(texts), (2, "a b\tc"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' AS n_words")
    want = []
    for key, text in rows:
        counts = [greedy("▁" + w, pieces) for w in (text or "").split()]
        want.append((key if key is not None else -1, len(counts), sum(counts) + counts.count(0), counts.count(0)))
    got = [(r[0] if r[0] is not None else -1, *r[1:]) for r in count_pieces(docs, vocabulary("piece_bpe_32k.model")).collect()]
    assert sorted(got) == sorted(want)
    assert count_pieces(docs.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0
