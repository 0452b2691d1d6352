"""Exact search for fingerprints within a Hamming radius.

Fingerprints are one or more bigint columns. If two differ in at most r bits, then of B > r
bit blocks at least B - r agree, so each choice of B - r blocks makes a table keyed by those
bits (the other bits masked out) and every close pair shares a key in some table. Inside a
key's shard, vantage-point trees split the fingerprints by distance; branches are pruned by
the triangle inequality and only strips within r of a boundary are searched across it. A
shard with more than ``hot`` fingerprints is first dealt to several tasks by shells of
distance around two vantage points of its own, boundary strips going to both neighbours.

Only distinct fingerprints take part, so copies cannot make a shard dense: those within r
bits of one point that also share a key differ in the other bits only, at most
sum(C(bits - key bits, i)) for i up to r of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

#: Up to so many fingerprints are compared directly at a leaf of a vantage-point tree.
LEAF = 64


def block_masks(bits: int, radius: int, blocks: int) -> list[list[int]]:
    """For each table the mask of each 64-bit word (signed), of ``blocks - radius`` agreeing blocks."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    spans = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    out = []
    for chosen in combinations(spans, blocks - radius):
        whole = sum(chosen)
        words = [(whole >> (64 * w)) & (2**64 - 1) for w in range(bits // 64)]
        out.append([w - 2**64 if w >= 2**63 else w for w in words])
    return out


def shards(fps: DataFrame, words: list[str], masks: list[list[int]], radius: int, hot: int) -> DataFrame:
    """Each fingerprint in its shard of every table: columns table, key, cell (of two shells), guest and those of ``fps``.

    The key is a hash of the agreeing bits: a collision only puts more fingerprints together.
    Bit i of ``guest`` says that the row is a guest in the i-th shell; a pair belongs to the
    one cell where no such bit is set in both.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("table"), F.xxhash64(F.lit(t), *(F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(words, mask) if m)).alias("key")) for t, mask in enumerate(masks)))
    own = fps.select(*fps.columns, F.inline(tables))
    # the key tells tables apart as well
    crowded = durable(own.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > hot).select("key"), "hot-shards")
    if crowded.isEmpty():
        return own.withColumn("cell", F.lit(0)).withColumn("guest", F.lit(0))
    pivots = own.join(crowded, "key").groupBy("key").agg(*(f(F.struct(*words)).alias(n) for f, n in ((F.min, "p0"), (F.max, "p1"))))
    joined = own.join(pivots, "key", "left")

    def shells(pivot: str, bit: int) -> Column:
        distance = reduce(lambda a, b: a + b, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"{pivot}.{c}"))) for c in words))
        near, far = F.floor(distance / (radius + 1)).cast("int"), F.floor((distance + radius) / (radius + 1)).cast("int")
        home, away = (F.struct(s.alias("shell"), F.lit(g).alias("guest")) for s, g in ((near, 0), (far, bit)))
        return F.when(near == far, F.array(home)).otherwise(F.array(home, away))

    cells = F.flatten(F.transform(shells("p0", 1), lambda x: F.transform(shells("p1", 2), lambda y: F.struct((x["shell"] * 1000 + y["shell"]).alias("cell"), (x["guest"] + y["guest"]).alias("guest")))))
    alone = F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("guest")))
    return joined.select(*fps.columns, "table", "key", F.inline(F.when(F.col("p0").isNull(), alone).otherwise(cells)))


def distances(x, at):
    """Hamming distances of the rows of x (n, words of uint64) from ``at``."""
    import numpy as np

    return np.bitwise_count(x ^ at).sum(axis=-1, dtype=np.int64)


def vantage(x, rows):
    """A vantage point's distances to ``rows``: of a few candidates the one that spreads them most."""
    step = max(1, len(rows) // 4)
    return max((distances(x[rows], x[rows[i]]) for i in range(0, len(rows), step)), key=lambda d: d.var())


def tree_leaves(x, radius: int, rows) -> Iterator:
    """Leaves of a vantage-point tree over ``rows`` such that each pair within ``radius`` is in one of them together."""
    import numpy as np

    if len(rows) <= LEAF:
        yield rows
        return
    d = vantage(x, rows)
    cut = np.median(d)
    inner, outer = rows[d <= cut], rows[d > cut - radius]
    if max(len(inner), len(outer)) > 0.9 * len(rows):
        yield rows
        return
    yield from tree_leaves(x, radius, inner)
    yield from tree_leaves(x, radius, outer)


def leaf_components(x, radius: int, rows) -> Iterator[tuple]:
    """(members, root) of each component of several fingerprints: the frontier absorbs what is in reach, so a dense group takes few passes."""
    import numpy as np

    y = x[rows]
    if len(rows) <= 128:
        close = distances(y[:, None], y[None]) <= radius
        if close.sum() == len(rows):
            return
    left = np.arange(len(rows))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        members, todo = [seed], [seed]
        while todo and len(left):
            near = distances(y[left], y[todo.pop()]) <= radius
            if near.any():
                members += (new := left[near].tolist())
                todo += new
                left = left[~near]
        if len(members) > 1:
            yield rows[members], rows[seed]


def tree_pairs(x, radius: int, a, b=None) -> Iterator[tuple]:
    """All pairs (i, j) within ``radius``, each once: inside ``a``, or between ``a`` and ``b``."""
    import numpy as np

    if b is not None and not (len(a) and len(b)):
        return
    both = a if b is None else np.concatenate([a, b])
    if len(both) > LEAF:
        d = vantage(x, both)
        cut = np.median(d)
        in_a, in_b = d[: len(a)] <= cut, d[len(a) :] <= cut
        strip = (d > cut - radius) & (d <= cut + radius)
        if max((d <= cut).sum(), (d > cut).sum()) <= 0.9 * len(both):
            strip_a, strip_b = strip[: len(a)], strip[len(a) :]

            def across(i, j):
                search = tree_pairs if len(i) + len(j) <= 0.9 * len(both) else tree_cross
                return search(x, radius, i, j)

            if b is None:
                yield from tree_pairs(x, radius, a[in_a])
                yield from tree_pairs(x, radius, a[~in_a])
                yield from across(a[in_a & strip_a], a[~in_a & strip_a])
            else:
                yield from across(a[in_a], b[in_b])
                yield from across(a[~in_a], b[~in_b])
                yield from across(a[in_a & strip_a], b[~in_b & strip_b])
                yield from across(a[~in_a & strip_a], b[in_b & strip_b])
            return
    yield from tree_cross(x, radius, a, b)


def tree_cross(x, radius: int, a, b=None) -> Iterator[tuple]:
    """Direct comparison in blocks."""
    import numpy as np

    other = a if b is None else b
    for at in range(0, len(a), 512):
        rows = a[at : at + 512]
        for to in range(at if b is None else 0, len(other), 2048):
            cols = other[to : to + 2048]
            close = distances(x[rows][:, None], x[cols][None]) <= radius
            if b is None:
                close &= np.arange(at, at + len(rows))[:, None] < np.arange(to, to + len(cols))[None]
            i, j = np.nonzero(close)
            if len(i):
                yield rows[i], cols[j]


def by_shard(sharded: DataFrame, words: list[str], extra: list[str], work: Callable, schema: str) -> DataFrame:
    """Run ``work(table, x, guest, extra arrays)`` on every cell of every shard; it returns a dict of arrays or None."""
    keys = ["table", "key", "cell"]
    columns = [*keys, "guest", *words, *extra]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def groups() -> Iterator:
            held = None
            for batch in batches:
                got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
                if held is not None:
                    got = [np.concatenate(p) for p in zip(held, got)]
                if not len(got[0]):
                    continue
                changed = np.zeros(len(got[0]) - 1, bool)
                for c in got[: len(keys)]:
                    changed |= c[1:] != c[:-1]
                cuts = [0, *(np.flatnonzero(changed) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a + 1:
                        yield [c[a:b] for c in got]
                held = [c[cuts[-1] :] for c in got]
            if held is not None and len(held[0]) > 1:
                yield held

        out, size = [], 0
        for g in groups():
            x = np.stack([c.view(np.uint64) for c in g[len(keys) + 1 : len(keys) + 1 + len(words)]], axis=1)
            found = work(int(g[0][0]), x, g[len(keys)], g[len(keys) + 1 + len(words) :])
            if found is not None:
                out.append(found)
                size += len(next(iter(found.values())))
            if size > 20_000:
                yield pa.RecordBatch.from_pydict({k: np.concatenate([f[k] for f in out]) for k in out[0]})
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({k: np.concatenate([f[k] for f in out]) for k in out[0]})

    dealt = sharded.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def linking_edges(fps: DataFrame, word: str, bits: int, radius: int, blocks: int, hot: int = 20_000) -> DataFrame:
    """Edges (src, dst) that connect exactly the components of 64-bit fingerprints linked within ``radius``.

    ``fps`` holds distinct fingerprints. Edges go from members to one root per component
    of a leaf, never over all pairs of a group.
    """

    def work(table, x, guest, extra):
        import numpy as np

        src, dst = [], []
        for leaf in tree_leaves(x, radius, np.arange(len(x))):
            for members, root in leaf_components(x, radius, leaf):
                src.append(x[members[1:], 0])
                dst.append(np.full(len(members) - 1, x[root, 0]))
        return {"src": np.concatenate(src).view(np.int64), "dst": np.concatenate(dst).view(np.int64)} if src else None

    masks = block_masks(bits, radius, blocks)
    return by_shard(shards(fps.select(word), [word], masks, radius, hot), [word], [], work, "src bigint, dst bigint")


def neighbour_counts(fps: DataFrame, words: list[str], weight: str, radius: int, blocks: int, hot: int = 20_000) -> DataFrame:
    """For distinct fingerprints (columns ``words``): n_near, the summed ``weight`` of the others within ``radius``; only rows with some."""
    masks = block_masks(64 * len(words), radius, blocks)

    def work(table, x, guest, extra):
        import numpy as np

        total = np.zeros(len(x), np.int64)
        w, (*earlier, own) = extra[0], [np.array(m, dtype=np.int64).view(np.uint64) for m in masks[: table + 1]]
        for i, j in tree_pairs(x, radius, np.arange(len(x))):
            due = ((guest[i] & guest[j]) == 0) & (((x[i] ^ x[j]) & own) == 0).all(axis=1)
            for m in earlier:  # a pair counts in the first table where it shares a key
                due &= (((x[i] ^ x[j]) & m) != 0).any(axis=1)
            np.add.at(total, i[due], w[j[due]])
            np.add.at(total, j[due], w[i[due]])
        some = np.flatnonzero(total)
        return {c: x[some, k].view(np.int64) for k, c in enumerate(words)} | {"n_near": total[some]} if len(some) else None

    schema = ", ".join(f"{c} bigint" for c in words) + ", n_near bigint"
    found = by_shard(shards(fps.select(*words, weight), words, masks, radius, hot), words, [weight], work, schema)
    return found.groupBy(*words).agg(F.sum("n_near").alias("n_near"))
