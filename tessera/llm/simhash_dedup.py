"""Near-duplicate groups by SimHash fingerprints of word shingles and exact Hamming search."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hamming import linking_edges
from tessera.llm.shingle_links import link_similar
from tessera.operators.graph import connected_components
from tessera.operators.joins import counted_join
from tessera.session import bounded_batches, durable

_BATCH = 512


def shingle_simhash(text: str, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of ``text``: A-Z lower-cased, words between ASCII white space, each shingle's XXH64 votes.

    A bit is set if more than half of the shingle hashes set it. A text of fewer words is
    one shingle, one without words has fingerprint 0.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(found))
    spans = zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in spans], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        own = hashes[at : at + 65536]
        votes += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint, key bigint, the hash of the text) per document; a null text is an empty one."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                fps = np.array([shingle_simhash(t or "", words) for t in rows.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64)), rows.column(2)], names=[id_col, "fp", "key"])
        pa.default_memory_pool().release_unused()  # the worker lives on for other stages

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), F.col(text_col), key).mapInArrow(run, f"`{id_col}` {kind}, fp bigint, key bigint")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """Per document: fingerprint (16 hex digits) and component_id, the smallest id reachable over links of ``radius`` bits.

    With ``similarity``, texts whose sets of 5-word shingles have that Jaccard similarity or more are linked as well.

    Equal fingerprints are one node, so copies cost one row each and are never paired.
    Documents without words have fingerprint 0 and link like any other. A null id keeps
    its row; component_id is null only where no id of the component is known. Repeated
    rows stay repeated.
    """
    fps = durable(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = durable(fps.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "classes")
    edges = linking_edges(classes, "fp", 64, radius, radius + 2)
    if similarity is None:
        components = connected_components(edges)
    else:
        texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
        nodes = durable(fps.groupBy("key").agg(F.first("fp").alias("node")), "nodes")
        components = durable(link_similar(texts, nodes, edges, similarity), "components")
    linked = classes.join(components.withColumnRenamed("node", "fp"), "fp")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(lows, "component").select("fp", "component_id")
    names = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "n")
    named = counted_join(fps, durable(names, "names"), ["fp"], "n")
    return named.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4, broadcast_rows: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each near-duplicate group.

    Links are those of fingerprints within ``radius`` bits and those of texts of that
    ``similarity`` (Jaccard, 5-word shingles), however far their fingerprints are apart.

    Of repeated rows of a kept id the one of the smallest text (then of the smallest other
    columns) stays; an id that stands for several texts goes if one of them is dropped.
    Documents without an id cannot be named in a group's outcome and stay. A null text is an
    empty one; empty texts are copies of each other. The dropped ids are broadcast up to
    ``broadcast_rows`` and joined by shuffle beyond that.
    """
    groups = durable(near_duplicates(docs.filter(F.col(id_col).isNotNull()), words, radius, id_col, text_col, similarity), "groups")
    first = groups.filter(F.col(id_col) == F.col("component_id"))
    gone = durable(groups.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "dropped")
    repeated = durable(first.groupBy(id_col).count().filter("count > 1").select(id_col), "repeated")
    hint = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    kept = docs.join(hint(gone), id_col, "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    single = kept.join(hint(repeated), id_col, "left_anti").select(*docs.columns)
    ordered = [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    least = kept.join(hint(repeated), id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(text_col, *ordered)).alias("row"))
    return single.union(least.select("row.*"))
