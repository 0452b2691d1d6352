"""Vector code compression: product codes whose codebooks come from an exact integer Lloyd iteration with heaps.

Every vector is cut into parts, every part becomes the index of its codebook's nearest entry. A
block of vectors keeps, for each part position and entry, a heap of the parts that the entry
holds, keyed by slack: the lower bound of the distance to any other entry less the upper bound
of the distance to its own. Moving entries eat slack, so a round adds each entry's drift and the
largest drift of the others to that entry's clock; only parts whose key the clock has reached
are popped and measured against all entries again, exactly, in integers. All others provably
keep their entry. Sums change by the moved parts alone.

Blocks of a round are a stored table that the next round reads, so a lost executor costs a
retry of its tasks; the round before is removed once the next is written. Only the codebooks,
the clocks and the sums (entries times components) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import counted_join
from tessera.session import drop_durable, durable

#: Scaled components saturate here, so that squared distances fit 64 bits up to 8,192 components a part.
LIMIT = 1 << 23
_BLOCK = 4096


class Codebooks:
    """Entries (position, entry, component), and per entry the clock of the drift that its parts' slack has lost."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.clock = entries, np.zeros(entries.shape[:2])
        self.sums, self.counts = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)

    def move(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Take the change of the entries' sums and counts and move each used entry to the floor of its mean."""
        self.sums, self.counts = self.sums + sums, self.counts + counts
        used = np.maximum(self.counts, 1)[..., None]
        new = np.where(self.counts[..., None] > 0, self.sums // used, self.entries)
        drift = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(-1))
        for p, d in enumerate(drift):
            others = np.array([np.delete(d, j).max(initial=0.0) for j in range(len(d))])
            self.clock[p] += (d + others) * (1 + 1e-12)
        self.entries = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def measure(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties: the lower index), its squared distance, and a safe lower bound of the slack."""
    d2 = ((x[:, None, :] - entries[None]) ** 2).sum(-1)
    best = d2.argmin(1)
    nearest = d2[np.arange(len(x)), best]
    if len(entries) < 2:
        return best, nearest, np.full(len(x), np.inf)
    upper, lower = np.sqrt(nearest.astype(np.float64)), np.sqrt(np.partition(d2, 1, axis=1)[:, 1].astype(np.float64))
    return best, nearest, lower - upper - 1e-9 * (lower + upper) - 1e-6


class SlackHeap:
    """The parts of one entry by key. It is kept in full order, which is a heap too, so that whatever lies below a bound is popped at once."""

    def __init__(self, keys: np.ndarray, parts: np.ndarray):
        self.keys, self.parts = keys, parts

    def pop(self, bound: float) -> np.ndarray:
        n = int(np.searchsorted(self.keys, bound, side="right"))
        popped, self.keys, self.parts = self.parts[:n], self.keys[n:], self.parts[n:]
        return popped

    def push(self, keys: np.ndarray, parts: np.ndarray) -> None:
        # stored in single precision: rounded down, a key only pops too early
        keys = np.nextafter(keys.astype(np.float32), np.float32(-np.inf))
        keys, parts = np.concatenate([self.keys, keys]), np.concatenate([self.parts, parts.astype(np.uint16)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.parts = keys[order], parts[order]


def advance(x: np.ndarray, heaps: list[list[SlackHeap]], books: Codebooks, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One assignment of a block (vector, position, component): pops and rescans what the clocks have reached, returns the change of sums and counts."""
    sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
    for p, held in enumerate(heaps):
        popped = [heap.pop(books.clock[p, j]) for j, heap in enumerate(held)]
        parts, old = np.concatenate(popped), np.repeat(np.arange(len(held)), [len(q) for q in popped])
        if stats is not None:
            stats["popped"] = stats.get("popped", 0) + len(parts)
        if not len(parts):
            continue
        new, _, slack = measure(x[parts, p].astype(np.int64), books.entries[p])
        for j, heap in enumerate(held):
            if (at := new == j).any():
                heap.push(slack[at] + books.clock[p, j], parts[at])
        moved = old != new
        values = x[parts[moved], p].astype(np.int64)
        for sign, at in ((-1, old[moved]), (1, new[moved])):
            np.add.at(sums[p], at, sign * values)
            np.add.at(counts[p], at, sign)
    return sums, counts


def first_heaps(x: np.ndarray, books: Codebooks) -> tuple[list[list[SlackHeap]], np.ndarray, np.ndarray]:
    """Heaps of a block that has none yet: every part is measured once."""
    heaps, sums, counts = [], np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
    for p in range(x.shape[1]):
        values = x[:, p].astype(np.int64)
        new, _, slack = measure(values, books.entries[p])
        heaps.append([SlackHeap(np.zeros(0, np.float32), np.zeros(0, np.uint16)) for _ in range(books.entries.shape[1])])
        for j, heap in enumerate(heaps[-1]):
            heap.push(slack[new == j] + books.clock[p, j], np.flatnonzero(new == j))
        np.add.at(sums[p], new, values)
        np.add.at(counts[p], new, 1)
    return heaps, sums, counts


def _pack(heaps: list[list[SlackHeap]]) -> dict[str, bytes]:
    flat = [h for held in heaps for h in held]
    return {
        "sizes": np.array([len(h.keys) for h in flat], np.int32).tobytes(),
        "keys": np.concatenate([h.keys for h in flat]).astype(np.float32).tobytes(),
        "parts": np.concatenate([h.parts for h in flat]).astype(np.uint16).tobytes(),
    }


def _unpack(row: dict, positions: int, k: int) -> list[list[SlackHeap]]:
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))[:-1]
    cut = lambda name, kind: np.split(np.frombuffer(row[name], kind), ends)
    flat = [SlackHeap(a, b) for a, b in zip(cut("keys", np.float32), cut("parts", np.uint16))]
    return [flat[p * k : (p + 1) * k] for p in range(positions)]


_TABLE = "ids binary, nulls binary, labels binary, unlabelled binary, wide boolean, x binary, sizes binary, keys binary, parts binary, sums binary, counts binary"


def _block(row: dict, positions: int, width: int) -> np.ndarray:
    return np.frombuffer(row["x"], np.int32 if row["wide"] else np.int16).reshape(-1, positions, width)


def _rows(batches: Iterator, each) -> Iterator:
    """Apply ``each`` to the rows of stored blocks, one at a time."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            made = each(row)
            yield made if isinstance(made, pa.RecordBatch) else pa.RecordBatch.from_pylist([made])


def _first_round(rows: DataFrame, books: Codebooks) -> DataFrame:
    positions, _, width = books.entries.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(parts: list) -> pa.RecordBatch:
            block = pa.Table.from_batches(parts)
            filled = lambda c: (block[c].fill_null(0).to_numpy(), block[c].is_null().to_numpy())
            (ids, nulls), (labels, unlabelled) = filled("id"), filled("label")
            raw = block["vector"].combine_chunks().flatten().to_numpy().reshape(-1, positions, width)
            x = np.clip(np.floor(raw * 4096), -LIMIT, LIMIT).astype(np.int32)
            wide = bool(np.abs(x).max() > 32767)
            heaps, sums, counts = first_heaps(x, books)
            row = {
                "ids": ids.astype(np.int64).tobytes(), "nulls": nulls.tobytes(), "labels": labels.astype(np.int64).tobytes(), "unlabelled": unlabelled.tobytes(),
                "wide": wide, "x": (x if wide else x.astype(np.int16)).tobytes(), **_pack(heaps), "sums": sums.tobytes(), "counts": counts.tobytes(),
            }
            return pa.RecordBatch.from_pylist([row])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, _BLOCK - n)
                held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                if n == _BLOCK:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    return rows.mapInArrow(run, _TABLE)


def _next_round(table: DataFrame, books: Codebooks) -> DataFrame:
    positions, k, width = books.entries.shape

    def each(row: dict) -> dict:
        heaps = _unpack(row, positions, k)
        sums, counts = advance(_block(row, positions, width), heaps, books)
        return row | _pack(heaps) | {"sums": sums.tobytes(), "counts": counts.tobytes()}

    return table.mapInArrow(lambda batches: _rows(batches, each), _TABLE)


def _change(table: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all blocks' changes: one row an entry and partition, added up by Spark; entries times components numbers reach the driver."""
    positions, k, width = books.entries.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, counts = np.zeros((positions * k, width), np.int64), np.zeros(positions * k, np.int64)
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums += np.frombuffer(s, np.int64).reshape(sums.shape)
                counts += np.frombuffer(c, np.int64)
        at = np.flatnonzero(np.abs(sums).sum(1) + np.abs(counts))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(counts[at]), **{f"s{i}": pa.array(sums[at, i]) for i in range(width)}})

    names = ["n", *(f"s{i}" for i in range(width))]
    rows = table.select("sums", "counts").mapInArrow(run, "at int, " + ", ".join(f"{x} bigint" for x in names))
    sums, counts = np.zeros((positions * k, width), np.int64), np.zeros(positions * k, np.int64)
    for row in rows.groupBy("at").agg(*(F.sum(x).alias(x) for x in names)).collect():
        counts[row["at"]], sums[row["at"]] = row[1], row[2:]
    return sums.reshape(books.entries.shape), counts.reshape(positions, k)


def _last_round(table: DataFrame, books: Codebooks, id_col: str) -> DataFrame:
    positions, k, width = books.entries.shape

    def each(row: dict):
        import pyarrow as pa

        x, heaps = _block(row, positions, width), _unpack(row, positions, k)
        advance(x, heaps, books)
        codes = np.zeros((len(x), positions), np.int64)
        for p, held in enumerate(heaps):
            for j, heap in enumerate(held):
                codes[heap.parts, p] = j
        error = np.zeros(len(x), np.int64)
        for p in range(positions):
            error += ((x[:, p].astype(np.int64) - books.entries[p][codes[:, p]]) ** 2).sum(-1)
        lines = codes.astype(np.uint8).tobytes().hex()
        column = lambda a, b: pa.array(np.frombuffer(row[a], np.int64), mask=np.frombuffer(row[b], bool))
        values = [column("ids", "nulls"), pa.array([lines[i : i + 2 * positions] for i in range(0, len(lines), 2 * positions)]), pa.array(error), column("labels", "unlabelled")]
        return pa.RecordBatch.from_arrays(values, names=["id", "code", "error", "label"])

    return table.mapInArrow(lambda batches: _rows(batches, each), "id bigint, code string, error bigint, label bigint").withColumnRenamed("id", id_col)


def train_codes(vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """((id, code, error, label) per kept vector, the final codebooks).

    A component x counts as floor(4096 * x), saturated at +-2^23. Vectors that are null, or hold
    null or non-finite components, are left out. Codebooks start from the ``entries`` smallest ids
    (of repeated ids the smaller vectors; rows without an id are coded but start nothing), fewer
    if there are fewer. The kept vector of the smallest id gives the length, cut down to a multiple
    of ``positions`` being an error; vectors of another length are left out too. Repeated rows
    are coded alike. Without a kept vector the result is empty and there are no codebooks.
    """
    if entries > 256:
        raise ValueError("an index is two hex digits: at most 256 entries")
    spark, v = vectors.sparkSession, F.col("vector")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & finite)
    first = rows.filter("id is not null").orderBy("id", "vector").limit(1).first()
    if first is None:
        return spark.createDataFrame([], f"{id_col} bigint, code string, error bigint, label bigint"), None
    length = len(first.vector)
    if length % positions:
        raise ValueError(f"vectors of {length} components can't be cut into {positions} equal parts")
    rows = rows.filter(F.size(v) == length)
    seeds = np.array([r.vector for r in rows.filter("id is not null").orderBy("id", "vector").limit(entries).collect()])
    start = np.clip(np.floor(seeds * 4096), -LIMIT, LIMIT).astype(np.int64).reshape(len(seeds), positions, length // positions)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    table = durable(_first_round(rows, books), "vector-blocks")
    for n in range(rounds):
        if n:
            before, table = table, durable(_next_round(table, books), "vector-blocks")
            drop_durable(before)
        books.move(*_change(table, books))
    coded = durable(_last_round(table, books, id_col), "vector-codes")
    drop_durable(table)
    return coded, books


def code_report(coded: DataFrame, books: Codebooks | None) -> DataFrame:
    """``coded`` with label_error (the errors of all vectors of the same label, nulls together) and the digest of the codebooks, without the label.

    Errors are summed per label before the join, and a label that holds a large share of the rows is joined by broadcast.
    """
    keyed = coded.withColumn("_no_label", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit(0)))
    per_label = keyed.groupBy("_no_label", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    joined = counted_join(keyed, per_label, ["_no_label", "_label"], "_n")
    digest = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    return joined.select(*(c for c in coded.columns if c != "label"), "label_error", F.lit(digest).alias("codebooks_sha256"))
