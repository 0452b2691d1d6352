"""Document fingerprints: 256-bit SimHash of weighted terms, permuted block tables for the search."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hamming import neighbour_counts
from tessera.operators.joins import counted_join
from tessera.session import durable

BITS = 256
_BATCH = 256


def term_simhash(text: str) -> bytes:
    """256-bit SimHash: lower-cased words are terms, each term's hash bits vote for or against.

    A term weighs 1 + ln(count) times its length up to 10, so short function words, which
    unrelated texts share, count for less. A text without words has only zeros.
    """
    import numpy as np
    from xxhash import xxh3_128_digest

    counts = Counter(text.lower().split())
    if not counts:
        return bytes(BITS // 8)
    terms = [t.encode("utf-8", "surrogatepass") for t in counts]
    digests = np.frombuffer(b"".join([xxh3_128_digest(t) + xxh3_128_digest(t, 1) for t in terms]), np.uint8).reshape(-1, BITS // 8)
    weights = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
    weights *= np.minimum(np.fromiter(map(len, counts), np.float32, len(counts)), 10)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(weights), 16384):
        votes += weights[at : at + 16384] @ np.unpackbits(digests[at : at + 16384], axis=1).astype(np.float32)
    return np.packbits(2 * votes > weights.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints, about 0.5 for unrelated texts, 0 for opposite ones."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def in_descending_order(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """Documents dealt by ranges of descending id: place, guest, id, text; sorted in each partition.

    A place's last document needs the next place's first one, and the very last the very
    first, so these (one per place) are also sent ahead as guests. Documents without an id
    have no place in the order and are spread over all places.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # quantiles only balance the places; any bounds give the same result
    cuts = sorted(set(rows.approxQuantile("id", [i / partitions for i in range(1, partitions)], 0.25 / partitions) if partitions > 1 else []))
    splits = [-math.inf, *cuts, math.inf]
    if cuts:
        bucket = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep")
        placed = lambda df: bucket.transform(df.withColumn("at", F.coalesce(F.col("id").cast("double"), F.lit(0.0)))).withColumn("place", F.lit(len(cuts)) - F.col("bucket").cast("int"))
    else:
        placed = lambda df: df.withColumn("place", F.lit(0))
    spark, home = rows.sparkSession, F.pmod(F.xxhash64("text"), F.lit(len(splits) - 1)).cast("int")
    firsts = sorted(placed(rows.select("id").filter("id is not null")).groupBy("place").agg(F.max("id").alias("id")).collect())
    # one row a place: the id that its predecessor needs as well
    ahead = [(b.id, a.place) for a, b in zip(firsts, firsts[1:])] + ([(firsts[0].id, firsts[-1].place)] if firsts else [])
    ahead = spark.createDataFrame(ahead, "id bigint, to int")
    known = placed(rows).join(F.broadcast(ahead), "id", "left")
    own = F.struct(F.when(F.col("id").isNull(), home).otherwise(F.col("place")).alias("place"), F.lit(False).alias("guest"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("place"), F.lit(True).alias("guest"))))
    dealt = known.select("id", "text", F.inline(places)).repartitionById(len(splits) - 1, F.col("place"))
    return dealt.select("place", "guest", "id", "text").sortWithinPartitions("place", "guest", F.col("id").desc_nulls_last(), "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text's last floor(n_chars / 2) code points come from the start of the next
    document in descending id order (after the last: the first). Of repeated ids the order
    is that of their texts; a document without an id has no next one: its half is only
    cut off and near_next is null. A null text is an empty one.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def row(key, text, own, after, after_print):
            n = len(text)
            edited = text[: n - n // 2] + after[: n // 2]
            new = own if edited == text else term_simhash(edited)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return key, n, sha, own.hex(), new.hex(), likeness(own, new), None if after_print is None else likeness(own, after_print)

        held, out = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                for place, guest, key, text in zip(*(c.to_pylist() for c in rows.columns)):
                    own = term_simhash(text)
                    if key is None:
                        out.append(row(None, text, own, "", None))
                        continue
                    if held is not None and held[0] == place:
                        out.append(row(*held[1:], text, own))
                    held = None if guest else (place, key, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []

    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_order(docs, id_col, text_col, partitions).mapInArrow(run, schema)


def count_near(prints: DataFrame, radius: int = 11, column: str = "fingerprint") -> DataFrame:
    """Add n_near: how many other rows have a fingerprint within ``radius`` bits (exact, by permuted block tables).

    ``prints`` must be a stored table. Equal fingerprints are counted as a class, not paired.
    """
    halves = [F.conv(F.substring(column, 1 + 16 * i, 16), 16, -10).cast("bigint").alias(f"w{i}") for i in range(BITS // 64)]
    words = [f"w{i}" for i in range(BITS // 64)]
    split = prints.select("*", *halves)
    classes = durable(split.groupBy(*words).agg(F.count("*").alias("n")), "print-classes")
    near = neighbour_counts(classes, words, "n", radius, radius + 1)
    totals = classes.join(near, words, "left").select(*words, "n", (F.col("n") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near"))
    return counted_join(split, durable(totals, "near-counts"), words, "n").drop(*words, "n")


def fingerprint_table(docs: DataFrame, radius: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint_documents with n_near."""
    return count_near(durable(fingerprint_documents(docs, id_col, text_col), "prints"), radius)
