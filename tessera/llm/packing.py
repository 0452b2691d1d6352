"""Best-fit-decreasing packing of token sequences.

Lengths are whole numbers up to the sequence size, so their histogram (at most as many
rows as the size) is all that the packing itself needs: best fit decreasing over the
histogram, with equal bins held as runs, gives the very bins that the document-by-document
algorithm gives. The plan it yields says which ranks of a length go to which bins. Ranks
are counted in the workers, so no group, task or driver ever holds the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import bounded_batches, durable

_BATCH = 512


class FreeTree:
    """Segment tree over remaining capacities 0..size; finds the tightest open one in logarithmic time."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        i = least + self.leaves
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.open[2 * i])
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Pack ``histogram`` (length -> count) into bins of ``size``.

    Returns rows (length, first rank, last rank, first bin, offset): the pieces of that
    length with these ranks go one each into consecutive bins at that offset.
    """
    tree, free, plan, bins = FreeTree(size), {}, [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            free.setdefault(capacity, []).append((first, n))
            tree.mark(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = size, bins, -(-left // (size // length))
                bins += n
            else:
                first, n = free[capacity].pop()
                if not free[capacity]:
                    tree.mark(capacity, False)
            per = capacity // length
            full = min(n, left // per)
            for k in range(per if full else 0):
                plan.append((length, rank, rank + full - 1, first, size - capacity + k * length))
                rank += full
            left -= full * per
            leave(capacity - per * length, first, full)
            if full < n and left:  # the last bin takes what is left of this length
                for k in range(left):
                    plan.append((length, rank, rank, first + full, size - capacity + k * length))
                    rank += 1
                leave(capacity - left * length, first + full, 1)
                left, full = 0, full + 1
            leave(capacity, first + full, n - full)
    return plan


def plan_buckets(plan: list[tuple[int, int, int, int, int]]) -> Iterator[tuple]:
    """Plan rows with the level (power of two) of their width and each bucket of that width that they touch, two at most.

    A length's rows don't overlap, so a bucket holds three of them at most: a rank finds its
    row by one equality per level that its length uses.
    """
    for length, first, last, bin_from, offset in plan:
        level = (last - first).bit_length()
        for bucket in range(first >> level, (last >> level) + 1):
            yield length, level, bucket, first, last, bin_from, offset


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each document: its ids and then ``end_id``, cut every ``size`` ids.

    A null text is an empty one (a single ``end_id``). Columns: the id, piece, start,
    length, ids_crc32, and part and part_rank, which count equal lengths within a task.
    Repeated documents give repeated pieces; a null id is kept as null.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.tokens import shared_encoder

        encoder, tail = shared_encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                out = [[] for _ in range(7)]
                ids = rows.column(0).to_pylist()
                for key, data in zip(ids, encoder.encode([t or "" for t in rows.column(1).to_pylist()])):
                    data += tail
                    for piece, start in enumerate(range(0, len(data) // 4, size)):
                        own = data[4 * start : 4 * (start + size)]
                        n = len(own) // 4
                        for column, value in zip(out, (key, piece, start, n, zlib.crc32(own), part, seen[n])):
                            column.append(value)
                        seen[n] += 1
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=names)

    bounded_batches(docs.sparkSession)
    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "part_rank"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, part_rank bigint"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, size: int = 4096, broadcast_rows: int = 500_000) -> DataFrame:
    """Add sequence_id and offset by best fit decreasing. ``pieces`` must be a stored table (it is read twice).

    The plan has at most some rows per pair of lengths, whatever the input; it is
    broadcast up to ``broadcast_rows`` rows and shuffled by length beyond that.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = list(plan_buckets(best_fit_decreasing(histogram, size)))
    runs = spark.createDataFrame(plan, "length bigint, level int, bucket bigint, rank_from bigint, rank_to bigint, bin_from bigint, offset bigint")
    if len(plan) <= broadcast_rows:
        runs = F.broadcast(runs)
    used = {}
    for length, level, *_ in plan:
        used.setdefault(length, set()).add(level)
    # at most a row per length, so at most ``size`` rows
    levels = spark.createDataFrame([(n, sorted(own)) for n, own in used.items()], "length bigint, levels array<int>")
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("part_rank"))
    probes = ranked.join(F.broadcast(levels), "length").withColumn("level", F.explode("levels")).withColumn("bucket", F.expr("shiftright(rank, level)"))
    placed = probes.join(runs, ["length", "level", "bucket"]).filter(F.col("rank").between(F.col("rank_from"), F.col("rank_to")))
    kept = [c for c in pieces.columns if c not in ("part", "part_rank")]
    return placed.select(*kept, (F.col("bin_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack whole documents into sequences of at most ``size`` ids (see token_pieces, pack_pieces)."""
    return pack_pieces(durable(token_pieces(docs, vocabulary, size, end_id), "pieces"), size)
