"""Exact links between texts whose sets of word shingles have a Jaccard similarity of a threshold or more.

Prefix filter: if all sets are sorted by one order of the shingles, two sets of n and m
elements that are similar enough share one of their first n - ceil(threshold * n) + 1
elements. Any order finds all pairs; the one used puts shingles that are frequent in a
sample of the texts last, so few unrelated texts meet. Of the shared elements the first
one stands at places i and j with nothing in common before, so the overlap is at most
min(n - i, m - j): a pair that is similar passes this bound there, and unrelated texts with
a common passage don't. A print of 1,024 parity bits a set bounds the overlap from above: a
bit that differs takes an element of one set alone, so similar sets of n and m elements differ
in (1 - threshold) / (1 + threshold) * (n + m) bits at most. Only pairs within that are decided
on the whole sets; unrelated sets of up to some 2,000 elements hardly ever are.

The prefixes are dealt by shingle once. A shingle of few texts gives its pairs there and then.
Of a shingle of many texts each text is held against the shortest one, then, where they are
still in several components, against two more; only components are needed, so other pairs
are made only of texts that are in different components after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.operators.joins import counted_join
from tessera.session import bounded_batches, drop_durable, durable

_BATCH = 512
#: Bits of a set's print, a power of two and of 64 at least.
_BITS = 1024
#: A shingle of up to so many texts gives all its pairs at once, so at most half as many a row.
_FEW = 8
#: So many rows of one shingle are held at most.
_HELD = 65536


def shingle_set(text: str, words: int = 5):
    """Sorted 64-bit hashes of the distinct runs of ``words`` words (A-Z lower-cased, between ASCII white space); fewer words are one run."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    many = len(found) - width + 1
    out = np.full(many, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + many]
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


def parity_print(shingles):
    """The ``_BITS`` bits, as signed 64-bit words, that tell whether an odd number of ``shingles`` has each value of the upper bits."""
    import numpy as np

    places = (shingles >> np.uint64(65 - _BITS.bit_length())).astype(np.int64)
    odd = np.bincount(places, minlength=_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def _sets(texts: DataFrame, words: int, similarity: float | None = None, frequent=None) -> DataFrame:
    """(key, n, shingles, print) of each (key, text) with words; with ``similarity`` only the prefix, in the order of ``frequent`` (broadcast hashes and counts).

    The print is that of the whole set, and null where the whole set is there itself.
    """
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def lists(arrays):
            ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))

        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                keys, sizes, out, prints = [], [], [], []
                for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    own = shingle_set(text, words)
                    if not (n := len(own)):
                        continue
                    if similarity is not None:
                        prints.append(parity_print(own))
                        hashes, counts = frequent.value
                        rank = np.zeros(n, np.int64)
                        if len(hashes):
                            near = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                            rank = np.where(hashes[near] == own, counts[near], 0)
                        own = own[np.lexsort((own, rank))[: prefix_size(n, similarity)]]
                    keys.append(key)
                    sizes.append(n)
                    out.append(own.view(np.int64))
                if keys:
                    columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), lists(out), lists(prints) if prints else pa.nulls(len(keys), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "shingles", "print"])
        pa.default_memory_pool().release_unused()  # the worker lives on for other stages

    return texts.select("key", "text").mapInArrow(run, "key bigint, n int, shingles array<bigint>, print array<bigint>")


def _frequent(texts: DataFrame, words: int, sample: int, most: int):
    """Hashes (sorted) and counts of the shingles that several of about ``sample`` texts hold."""
    import numpy as np

    share = max(1, math.ceil(texts.count() / sample))
    some = _sets(texts.filter(F.pmod("key", F.lit(share)) == 0), words).dropDuplicates(["key"])
    counts = some.select(F.explode("shingles").alias("h")).groupBy("h").count().filter("count > 1")
    got = counts.orderBy(F.desc("count"), "h").limit(most).toArrow()
    hashes, n = (got.column(i).to_numpy() for i in range(2))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], n[order]


def _meetings(prefixes: DataFrame, similarity: float) -> DataFrame:
    """What texts that share a prefix element give: rows (pair, x, y, n, at).

    With ``pair`` x and y are the keys of two texts that pass the overlap bound at a shared
    element. Without, x is an element of more than _FEW texts and y, n, at one of them.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        share = similarity / (1 + similarity)
        names = ["pair", "x", "y", "n", "at"]

        def passing(n, at, i, j):
            least = share * (n[i] + n[j]) - 1e-6
            return (n[i] - at[i] >= least) & (n[j] - at[j] >= least)

        def work(h, n, key, at, large):
            """Pairs and rows of sorted whole groups; ``large``: the first group is one of many texts, whatever is here of it."""
            first = np.concatenate([[True], h[1:] != h[:-1]])
            group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
            many = np.diff(np.append(starts, len(h))) > _FEW
            many[:1] |= large
            some = many[group]
            pairs = []
            for d in range(1, _FEW):
                i = np.flatnonzero((h[d:] == h[:-d]) & ~some[d:])
                if not len(i):
                    break
                good = passing(n, at, i, i + d)
                pairs.append((key[i[good]], key[i[good] + d]))
            i = np.flatnonzero(some & ~first)
            j = starts[group[i]]
            good = passing(n, at, i, j)
            pairs.append((key[i[good]], key[j[good]]))
            a, b = (np.concatenate(c) for c in zip(*pairs))
            rest = np.flatnonzero(some & ~(first & large & (group == 0)))
            zero = np.zeros(len(a), np.int32)
            columns = np.repeat([True, False], [len(a), len(rest)]), np.concatenate([a, h[rest]]), np.concatenate([b, key[rest]]), np.concatenate([zero, n[rest]]), np.concatenate([zero, at[rest]])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        held, large = None, False
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield work(*(c[:cut] for c in rows), large)
                large = False
            held = [c[cut:] for c in rows]
            if len(held[0]) > _HELD:  # of a very large group only its first text is held on
                yield work(*held, large)
                held, large = [c[:1] for c in held], True
        if held is not None:
            yield work(*held, large)
        pa.default_memory_pool().release_unused()

    placed = prefixes.select("n", "key", F.posexplode("shingles").alias("at", "h")).select("h", "n", "key", "at")
    return placed.repartition("h").sortWithinPartitions("h", "n", "key").mapInArrow(run, "pair boolean, x bigint, y bigint, n int, at int")


def _similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float, broadcast_rows: int, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """The components (src, dst; a stored table) of those of ``pairs`` (a, b, src, dst; a stored table) whose whole sets are similar.

    Sets of texts with many pairs are broadcast as long as they take up to ``broadcast_bytes``; others are joined by shuffle.
    """
    keys = durable(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "candidates")
    hint = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    sets = durable(_sets(texts.join(hint, "key", "left_semi"), words).dropDuplicates(["key"]).select("key", "shingles"), "shingle-sets")

    # a star's middle is at end b
    ends = durable(pairs.groupBy("b").agg(F.count("*").alias("times")).join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b"), "ends")
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    total, largest = ends.agg(F.sum("times"), F.max(F.size("y"))).first()
    share = max(1, min(2000, broadcast_bytes // (8 * (largest or 1))))
    heavy = ends.filter(F.col("times") > (total or 0) / share).agg(F.sum(8 * F.size("y"))).first()[0] or 0
    both = counted_join(left, ends, ["b"], "times", share) if heavy <= broadcast_bytes else left.join(ends, "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = durable(both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("src", "dst"), "similar")
    for table in (keys, sets, ends):
        drop_durable(table)
    return linked


def link_similar(texts: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float = 0.8, words: int = 5, sample: int = 40_000, frequent: int = 1_000_000, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(node, component) of every node, in the graph of ``edges`` (src, dst) and of all similar texts.

    ``texts`` has (key, text), copies included; ``nodes`` (stored) the node of each key. Texts
    without words are similar to none. ``sample`` and ``frequent`` only bound the cost.
    """
    order = texts.sparkSession.sparkContext.broadcast(_frequent(texts, words, sample, frequent))
    prefixes = durable(_sets(texts, words, similarity, order).dropDuplicates(["key"]), "prefixes")
    met = durable(_meetings(prefixes, similarity), "meetings")
    prints = durable(prefixes.select("key", "n", "print"), "prints")
    drop_durable(prefixes)
    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df

    parts = durable(connected_components(edges.select("src", "dst")), "parts")
    labels = nodes.join(few(parts), "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    labels = durable(labels, "labels")

    def within(x: str, y: str) -> Column:
        apart = F.zip_with(f"{x}print", f"{y}print", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        most = (1 - similarity) / (1 + similarity) * (F.col(f"{x}n") + F.col(f"{y}n")) + 1e-6
        return F.aggregate(apart, F.lit(0), lambda a, b: a + b) <= most

    def merge(pairs: DataFrame) -> None:
        """Verify ``pairs`` (a, b) of texts in different components and merge the components that they link."""
        nonlocal labels
        part = lambda key, name: labels.select(F.col("key").alias(key), F.col("part").alias(name))
        open = durable(pairs.distinct().join(part("a", "src"), "a").join(part("b", "dst"), "b").filter("src <> dst"), "open-pairs")
        if open.isEmpty():
            drop_durable(open)
            return
        of = lambda key: prints.select(F.col("key").alias(key), F.struct("n", "print").alias(f"of_{key}"))
        near = open.join(of("a"), "a").join(of("b"), "b").filter(within("of_a.", "of_b."))
        pairs = durable(near.select("a", "b", "src", "dst"), "pairs")
        drop_durable(open)
        linked = _similar(pairs, texts, words, similarity, broadcast_rows)
        wider, before = durable(connected_components(linked), "wider"), labels
        labels = durable(labels.join(few(wider.select(F.col("node").alias("part"), "component")), "part", "left").select("key", "node", F.coalesce("component", "part").alias("part")), "labels")
        for table in (pairs, linked, wider, before):
            drop_durable(table)

    merge(met.filter("pair").select(F.col("x").alias("a"), F.col("y").alias("b")))
    # the texts of shingles of many texts that are still in several components
    rows = met.filter("NOT pair").select(F.col("x").alias("h"), F.col("y").alias("key"), "n", "at")

    def mixed() -> DataFrame:
        named = durable(rows.join(labels.select("key", "part"), "key"), "named")
        groups = durable(named.groupBy("h").agg(F.count("*").alias("many"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("h", "many"), "mixed")
        left = durable(counted_join(named, groups, ["h"], "many"), "mixed-texts")
        for table in (named, groups):
            drop_durable(table)
        return left

    def passes(x: str, y: str) -> Column:
        c = lambda t, name: F.col(f"{t}{name}")
        least = similarity / (1 + similarity) * (c(x, "n") + c(y, "n")) - 1e-6
        return (c(x, "part") != c(y, "part")) & (c(x, "n") - c(x, "at") >= least) & (c(y, "n") - c(y, "at") >= least)

    now = mixed()
    if now.isEmpty():
        return labels.groupBy("node").agg(F.min("part").alias("component"))
    rows = now.select("h", "key", "n", "at")
    drop_durable(met)
    one = lambda f: f(F.struct(F.xxhash64("key").alias("mixed"), "key", "n", "at", "part"))
    middles = durable(now.groupBy("h").agg(F.count("*").alias("many"), F.array(one(F.min), one(F.max)).alias("p")), "middles")
    star = counted_join(now.drop("many"), middles, ["h"], "many").withColumn("p", F.explode("p")).filter(passes("", "p."))
    merge(star.select(F.col("key").alias("a"), F.col("p.key").alias("b")))
    # similar sets differ in size by the threshold at most: they are in one class or in neighbours
    sized = mixed().join(prints.select("key", "print"), "key").withColumn("class", F.floor((1 - 1e-9) * F.log("n") / -math.log(similarity)))
    other = sized.withColumn("class", F.explode(F.array("class", F.col("class") + 1)))
    across = sized.alias("x").join(other.alias("y"), ["h", "class"]).filter(passes("x.", "y.") & F.expr("x.n > y.n OR (x.n = y.n AND x.key > y.key)") & within("x.", "y."))
    merge(across.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")))
    return labels.groupBy("node").agg(F.min("part").alias("component"))
