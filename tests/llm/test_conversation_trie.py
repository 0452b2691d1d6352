import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import conversation_trie as trie
from tessera.llm.queries import QUERIES

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id bigint, turn bigint, role string, text string, id bigint, turns int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def brute(paths):
    """Node by node from the full member lists, no trie."""
    members = defaultdict(list)
    for c, seq in paths.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def under(node):
        return [node] + [x for k in kids[node] for x in under(k)]

    out = []
    for node, own in members.items():
        below = under(node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]), sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    assert set(COLUMNS) <= set(frame.columns)
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_brute_force(spark, sf):
    at = f"/root/testdata/{sf}"
    want = brute(rebuilt([tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]))
    assert rows_of(QUERIES["op12_conversation_trie"](spark, at)) == want


def made(seed, convs=250):
    """Few texts, so openings are shared at every depth; one opening holds most conversations, many are equal."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(1500), convs):
        opening = [("user", "hot")] * rng.choice([0, 1, 1, 2, 3, 6]) + [("user", rng.choice(["a", "b", "long text é"])), ("x", rng.choice(["", "c"]))] * rng.randrange(4)
        rows += [(c, i, role, text) for i, (role, text) in enumerate(opening)]
    return [(c, t, r, x, 5, 6) for c, t, r, x in rows]


@pytest.mark.parametrize("bound,deal,broadcast_rows", [(10**6, 10**6, 10), (40, 30, 1000), (5, 3, 0)])
def test_split_subtries_equal_whole_ones(spark, bound, deal, broadcast_rows):
    for seed in (1, 2):
        data = made(seed)
        frame = spark.createDataFrame(data, SCHEMA).repartition(3)
        own = brute(defaultdict_lists(data))
        assert rows_of(trie.prefix_trie(trie.turn_lists(frame), bound, deal, broadcast_rows)) == own
        want = brute(rebuilt([r[:4] for r in data]))
        assert rows_of(trie.prefix_trie(trie.with_shared_openings(frame), bound, deal, broadcast_rows)) == want


def defaultdict_lists(data):
    own = defaultdict(list)
    for c, turn, role, text in sorted(r[:4] for r in data):
        own[c].append((role, text))
    return own


def test_odd_rows(spark):
    long = "x" * 300_000
    rows = [(None, 1, "user", "no id"), (0, None, None, None), (0, 2, "user", "b"), (0, 1, "", "a" + long), (1, 1, None, ""), (2, 5, "user", "z"), (2, 5, "user", "z"), (2, 5, None, "z"), (150, 3, "a", "only turn"), (-7, 1, "u", "negative")]
    rows += [(205, i, "u", "same") for i in range(3)] + [(206, i, "u", "same") for i in range(400)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:40]
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest(r or "", x or ""), r or "", x or ""))
    assert rows_of(trie.prefix_trie(trie.turn_lists(frame))) == brute({c: [x[3:] for x in sorted(v)] for c, v in own.items()})
    assert rows_of(trie.prefix_trie(trie.with_shared_openings(frame.filter("conv_id <> 2 AND conv_id > 0"))))
    assert rows_of(trie.prefix_trie(trie.turn_lists(frame.limit(0)))) == []
    assert rows_of(trie.prefix_trie(trie.with_shared_openings(frame.filter("conv_id is null")))) == []


def test_conversations_without_turns(spark):
    """Both conversations lose their only turn to an absent opening: the root is all there is."""
    lost = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6][:2]
    frame = spark.createDataFrame([(c, 1, "u", "t", 0, 0) for c in lost], SCHEMA)
    ends = hashlib.sha256(f"{lost[0]},{lost[1]}".encode()).hexdigest()
    assert rows_of(trie.prefix_trie(trie.with_shared_openings(frame))) == [(lost[0], 0, None, 2, 0, 1, 0, ends)]


def test_ids_of_one_sequence_stream_through(spark):
    lists = spark.range(0, 30_000, 3).selectExpr("id", "array(named_struct('turn', 1L, 'digest', 'd', 'len', 4)) AS turns").repartition(5)
    got = rows_of(trie.prefix_trie(lists))
    ends = hashlib.sha256(",".join(map(str, range(0, 30_000, 3))).encode()).hexdigest()
    assert got == sorted([(0, 0, None, 10_000, 1, 1, 9_999 * 4, hashlib.sha256(b"").hexdigest()), (0, 1, 0, 10_000, 0, 1, 9_999 * 4, ends)], key=str)
