"""Prefix trie of conversations: every distinct opening sequence of turns as a node with its counts.

Conversations become sequences of turn digests (with the length of each text), equal sequences
become one path. Paths are dealt by a hash of their first turn, and each deal builds its tries in
memory as nodes with a dictionary of child pointers; children are made after their parents, so
walking the nodes backwards is a postorder without recursion. First-turn subtries of more turns
than the bound are never built whole: they are dealt anew at the first turn where their paths
part, again and again, and the nodes above that turn are summed up from the parts' tops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NAMES = [x.split()[0] for x in _NODE.split(", ")]
_NOTHING = hashlib.sha256(b"").hexdigest()
#: Ids of one list that is formed before the lists of a sequence meet: those that agree above so many bits.
_LIST_BITS = 9


def _turn(turn_col: str, role_col: str, text_col: str) -> Column:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 40)
    return F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("len"))


def turn_lists(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int | None = None) -> DataFrame:
    """(id, turns) per conversation: its turns in order as (turn, digest, len).

    Turns come by number, null first, equal ones by digest. A null role or text is an empty one; rows without an
    id are left out; repeated rows are repeated turns. One conversation's digests make one row (some 50 bytes a
    turn); its texts stay behind. With ``group``, conversations are dealt by their id less its remainder by ``group``.
    """
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), _turn(turn_col, role_col, text_col).alias("one"))
    keys = ["id"]
    if group:
        rows, keys = rows.withColumn("base", F.col("id") - F.col("id") % group).repartition("base"), ["base", "id"]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("one")).alias("turns"))


def with_shared_openings(conversations: DataFrame, group: int = 100, openings: int = 6, **columns: str) -> DataFrame:
    """(id, turns) where the first h turns come from conversation id - id % ``group``, h being the id's crc32 modulo ``openings``.

    All turns if that conversation has fewer, none if there is none; then the conversation's own turns after its
    first h. The lists are dealt by the opening conversation, at most ``group`` to each, so one shuffle does both.
    """
    lists = turn_lists(conversations, group=group, **columns)
    own, h = F.col("turns"), (F.crc32(F.col("id").cast("string")) % openings).cast("int")
    first = F.first(F.when(F.col("id") == F.col("base"), F.slice(own, 1, openings)), ignorenulls=True).over(Window.partitionBy("base"))
    lists = lists.select("id", own, first.alias("first"), h.alias("h"))
    opening = F.when(F.col("first").isNull(), F.slice(own, 1, 0)).otherwise(F.slice(F.col("first"), F.lit(1), F.col("h")))
    return lists.select("id", F.concat(opening, F.slice(own, F.col("h") + 1, F.size(own))).alias("turns"))


def _id_digests(lists: DataFrame) -> DataFrame:
    """(seq, n, low, ends): per sequence its conversations, the smallest id, and the SHA-256 of all ids in order.

    Ids are joined to short texts first, by sequence and upper bits of the id, and these are fed to the digest in
    order as they stream by: whatever share of all rows a sequence has, a task holds one batch of them.
    """
    chunk = F.shiftright("id", _LIST_BITS)
    lists = lists.groupBy("seq", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = lists.select("seq", "chunk", F.size("ids").cast("bigint").alias("n"), F.col("ids")[0].alias("low"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, names = None, ["seq", "n", "low", "ends"]
        for batch in batches:
            done = []
            for seq, n, low, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "low", "ids"))):
                if now and now[0] == seq:
                    now[1] += n
                    now[3].update(b"," + ids.encode())
                else:
                    if now:
                        done.append((*now[:3], now[3].hexdigest()))
                    now = [seq, n, low, hashlib.sha256(ids.encode())]
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done])
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*now[:3], now[3].hexdigest())))])

    return lists.repartition("seq").sortWithinPartitions("seq", "chunk").mapInArrow(fold, "seq string, n bigint, low bigint, ends string")


def _prefix(cut: Column) -> Column:
    return F.sha2(F.array_join(F.slice(F.col("digests"), F.lit(1), cut), ""), 256)


def _split(paths: DataFrame, bound: int, broadcast_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """(paths with the depth ``cut`` at which their trie starts, the groups that had to be split, by round).

    Each round looks only at what the round before split. A group (gid) goes from depth ``cut`` down to ``fork``, where
    its paths part; ``pid`` and ``parent_low`` are those of the group it was split from.
    """
    now, settled, splits = paths.filter(F.size("digests") > 0).withColumn("cut", F.lit(1)).withColumn("pid", F.lit(None).cast("string")), [], []
    while True:
        keyed = now.withColumn("gid", _prefix(F.col("cut")))
        heavy = durable(keyed.groupBy("gid").agg(F.sum(F.size("digests") - F.col("cut") + 1).alias("turns"), F.count("*").alias("paths")).filter((F.col("turns") > bound) & (F.col("paths") > 1)).select("gid"), "heavy")
        many = heavy.count()
        if not many:
            return _union([*settled, now]), splits
        small = F.broadcast if many <= broadcast_rows else (lambda x: x)
        # the ends of the order of a group's paths share what all of them share; a path that ends at the fork comes first
        a, b = F.col("first"), F.col("last")
        differs = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.element_at(a, i) != F.element_at(b, i))
        shared = F.array_position(differs, True)
        fork = F.when(shared > 0, shared - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")
        groups = keyed.join(small(heavy), "gid").groupBy("gid").agg(
            F.first("cut").alias("cut"), F.first("pid").alias("pid"), F.first("parent_low").alias("parent_low"), F.min("digests").alias("first"), F.max("digests").alias("last"),
            F.min_by("lens", "digests").alias("lens"), F.min_by("ends", "digests").alias("ends"), F.sum("n").alias("n"), F.min("low").alias("low"),
        )
        groups = groups.withColumn("fork", fork).withColumn("ends", F.when(F.size(a) == F.col("fork"), F.col("ends")).otherwise(F.lit(_NOTHING)))
        groups = durable(groups.drop("first", "last"), "split")
        splits.append(groups)
        known = small(groups.select("gid", "fork", F.col("low").alias("group_low")))
        settled.append(keyed.join(small(heavy), "gid", "left_anti").drop("gid"))
        below = keyed.join(known, "gid").filter(F.size("digests") > F.col("fork"))
        now = durable(below.select(*(c for c in now.columns if c not in ("cut", "pid", "parent_low")), F.col("group_low").alias("parent_low"), (F.col("fork") + 1).alias("cut"), F.col("gid").alias("pid")), "split-paths")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _build(frame):
    """The tries of one deal, as rows of nodes; a top row has ``top`` set and ``pid`` if it belongs to a split group."""
    import pandas as pd

    kids, up, depth, size, n, low, ends, above, tops = [], [], [], [], [], [], [], {}, {}

    def node(parent: int, at: int, length: int) -> int:
        kids.append({})
        for column, value in ((up, parent), (depth, at), (size, length), (n, 0), (low, None), (ends, _NOTHING)):
            column.append(value)
        return len(up) - 1

    columns = ("digests", "lens", "cut", "n", "low", "ends", "pid", "parent_low")
    for digests, lens, cut, many, least, ids, pid, parent_low in zip(*(frame[c] for c in columns)):
        key = "".join(digests[:cut])
        here = tops.get(key)
        if here is None:
            here = tops[key] = node(-1, cut, lens[cut - 1])
            above[here] = (pid, parent_low)
        for i in range(cut, len(digests)):
            there = kids[here].get(digests[i])
            if there is None:
                there = kids[here][digests[i]] = node(here, i + 1, lens[i])
            here = there
        n[here], low[here], ends[here] = many, least, ids
    leaves, saved = [0] * len(up), [0] * len(up)
    for i in range(len(up) - 1, -1, -1):  # children come before their parents
        leaves[i] += not kids[i]
        saved[i] += (n[i] - 1) * int(size[i])
        if (p := up[i]) >= 0:
            n[p], low[p] = n[p] + n[i], low[i] if low[p] is None else min(low[p], low[i])
            leaves[p], saved[p] = leaves[p] + leaves[i], saved[p] + saved[i]
    values = {
        "conv_id": low, "depth": depth, "parent_conv_id": [low[p] if p >= 0 else above[i][1] for i, p in enumerate(up)], "n_convs": n, "n_children": [len(k) for k in kids],
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "top": [p < 0 for p in up], "pid": [above[i][0] if p < 0 else None for i, p in enumerate(up)],
    }
    return pd.DataFrame(values)


def prefix_trie(lists: DataFrame, bound: int = 20_000, deal: int = 10_000, broadcast_rows: int = 100_000) -> DataFrame:
    """A row per node of the trie of ``lists`` (id, turns), as made by turn_lists() or with_shared_openings().

    Columns: conv_id (smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves, saved_tokens
    (code points that stand once instead of once a member, over the subtree) and ends_sha256 (SHA-256 of the ids
    that end here, in order, comma-joined). An empty conversation is a member of the root only; no conversations
    give no nodes. A subtrie of more than ``bound`` turns is split; a deal has about ``deal`` turns. What is
    split is broadcast up to ``broadcast_rows`` groups of some 150 bytes and joined by shuffle beyond.
    """
    spark = lists.sparkSession
    turns = F.col("turns")
    lists = lists.select("id", F.transform(turns, lambda t: t["digest"]).alias("digests"), F.transform(turns, lambda t: t["len"]).alias("lens"))
    lists = durable(lists.withColumn("seq", F.sha2(F.array_join("digests", ""), 256)), "sequences")
    distinct = lists.groupBy("seq").agg(F.any_value("digests").alias("digests"), F.any_value("lens").alias("lens"))
    paths = durable(distinct.join(_id_digests(lists.select("seq", "id")), "seq").drop("seq"), "paths")
    total, n, low, ends = paths.agg(F.sum(F.size("digests")), F.sum("n"), F.min("low"), F.max(F.when(F.size("digests") == 0, F.col("ends")))).first()
    if not n:
        return spark.createDataFrame([], _NODE)
    cut, splits = _split(paths.withColumn("parent_low", F.lit(low)), bound, broadcast_rows)
    deals = max(-(-total // deal), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("deal", F.pmod(F.xxhash64(_prefix(F.col("cut"))), F.lit(deals)))
    built = durable(cut.groupBy("deal").applyInPandas(lambda frame: _build(frame), f"{_NODE}, top boolean, pid string"), "nodes")
    found, tops = [built.select(*_NAMES)], built.filter("top").select("pid", "n_leaves", "saved_tokens")
    for groups in reversed(splits):
        below = tops.groupBy("pid").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("pid", "gid")
        # nodes from the fork up to the cut have the same members; each adds its own text
        at = F.explode(F.sequence(F.col("fork"), F.col("cut"))).alias("depth")
        own = lambda d: (F.col("n") - 1) * F.aggregate(F.slice("lens", d, F.col("fork") - d + 1), F.lit(0).cast("bigint"), lambda s, x: s + x)
        chain = groups.join(below, "gid").select("*", at)
        last = F.col("depth") == F.col("fork")
        chain = durable(chain.select(
            F.col("low").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.when(F.col("depth") == F.col("cut"), F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("saved") + own(F.col("depth"))).alias("saved_tokens"),
            F.when(last, F.col("ends")).otherwise(F.lit(_NOTHING)).alias("ends_sha256"), (F.col("depth") == F.col("cut")).alias("top"), "pid",
        ), "split-nodes")
        found.append(chain.select(*_NAMES))
        tops = tops.join(groups.select(F.col("gid").alias("pid")), "pid", "left_anti").select("pid", "n_leaves", "saved_tokens").union(chain.filter("top").select("pid", "n_leaves", "saved_tokens"))
    root = tops.agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).cast("bigint").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).cast("bigint").alias("saved_tokens"))
    root = root.select(F.lit(low).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(n).cast("bigint").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(ends or _NOTHING).alias("ends_sha256"))
    return _union([*found, root])
