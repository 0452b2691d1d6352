"""Benchmark decontamination by fingerprints of item-sized windows, in built-in functions only.

A window that shares no shingle with the benchmark has similarity 0, so windows are laid where
a benchmark shingle stands, in the sizes and at the offsets at which items have it. Each
window and each item get a SimHash of their benchmark shingles; block tables find for a
window all items of its size within the Hamming radius, and only those are verified by exact
weighted-shingle similarity.

Similarity of a window to an item: the weight of the item's shingles that the window
holds (counted with repeats) over the weight of all of them; a shingle weighs
1 / (number of items that have it), so wording common to many items says little.

A shingle votes with the square root of its weight, and words outside the benchmark don't
vote: the angle between a window of similarity s and the item then is arccos(sqrt(s)) whatever
the weights, which is 9.5 of 64 bits at 0.8 (standard deviation 2.8). The radius of 20 bits
lies 3.9 deviations above that. Only a window that mixes an item with another item's words is
farther away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.hamming import block_masks
from tessera.llm.spans import fresh, let
from tessera.session import durable


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: Column, width: int) -> Column:
    """Hashes of ``width`` consecutive words, by position."""
    at = lambda h, i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))
    return let(hashes, lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: at(h, i))).otherwise(F.array().cast("array<bigint>")))


def benchmark_index(bench: DataFrame, words: int, item_col: str, text_col: str) -> DataFrame:
    """Per item: width (``words``, or all of a shorter item) and shingles. Items without words are left out."""
    hashed = bench.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), _word_hashes(F.coalesce(F.col(text_col), F.lit(""))).alias("hashes")).filter(F.size("hashes") > 0)
    width = F.least(F.size("hashes"), F.lit(words))
    shingles = reduce(lambda rest, w: F.when(width == w, _shingles(F.col("hashes"), w)).otherwise(rest), range(1, words + 1), F.array().cast("array<bigint>"))
    return hashed.select("item_id", width.alias("width"), shingles.alias("item")).dropDuplicates(["item_id"])


def simhash(rows: DataFrame, by: list[str]) -> DataFrame:
    """64-bit SimHash (column fp) per group ``by`` of rows (h, n, weight): each shingle hash votes n times with the root of its weight.

    Two bits' votes are counted in the halves of one long, so a group costs 32 sums.
    """
    vote = F.col("n") * F.round(1000 * F.sqrt("weight")).cast("bigint")
    bit = lambda k: F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1).cast("bigint"))
    lanes = [F.sum(vote * (bit(k) + F.shiftleft(bit(k + 1), 32))).alias(f"lane{k}") for k in range(0, 64, 2)]
    votes = rows.groupBy(*by).agg(F.sum(vote).alias("all"), *lanes)
    count = lambda k: F.col(f"lane{k}").bitwiseAND(F.lit(2**32 - 1)) if k % 2 == 0 else F.shiftrightunsigned(f"lane{k - 1}", 32)
    bits = (F.when(2 * count(k) > F.col("all"), F.lit((1 << k) - (2**64 if k == 63 else 0))).otherwise(F.lit(0)).cast("bigint") for k in range(64))
    return votes.select(*by, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def items_near(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Pairs of ``windows`` (with width, m and fp) and ``items`` (item_id, width, m, fp) of equal size within ``radius`` bits.

    If two fingerprints differ in at most ``radius`` bits, one of radius + 1 blocks agrees: a
    table per block finds every pair. A pair is taken from the first table that holds it.
    """
    masks = [m for (m,) in block_masks(64, radius, radius + 1)]
    tables = lambda: F.inline(F.array(*(F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for t, m in enumerate(masks))))
    known = items.select("item_id", "width", "m", F.col("fp").alias("item_fp"), tables())
    found = windows.select("*", tables()).join(F.broadcast(known) if items.count() <= 1_000_000 else known, ["width", "m", "table", "block"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)))
    return found.filter((F.bit_count(apart) <= radius) & (first == F.col("table"))).drop("table", "block", "item_fp")


def contaminated(docs: DataFrame, bench: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 20, broadcast_rows: int = 5_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and benchmark item that it holds: id, item_id, similarity, start_word, n_words (of the window).

    Of several windows the most similar, then the first is reported. A null text or item is
    an empty one and matches nothing; items of fewer than ``words`` words are one shingle; of
    repeated item ids one is used; a null item id is left out; a null document id is kept.
    Repeated documents give repeated rows; copies of a text are merged by its MD5 once their
    windows are found. Up to ``broadcast_rows`` benchmark shingles (16 bytes each) or found
    texts are broadcast, more are joined by shuffle.
    """
    items = durable(benchmark_index(bench, words, item_col, text_col), "items")
    placed = items.select("item_id", "width", F.size("item").alias("m"), F.posexplode("item").alias("at", "h"))
    weights = placed.groupBy("width", "h").agg((1 / F.count_distinct("item_id")).alias("weight"))
    spread = durable(placed.join(weights, ["width", "h"]), "item-shingles")
    totals = spread.groupBy("item_id").agg(F.sum("weight").alias("total"))
    per_item = spread.groupBy("item_id", "width", "m", "h").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    hint = F.broadcast if spread.count() <= broadcast_rows else (lambda df: df)
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [words]

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.md5(text).alias("key"), _word_hashes(text).alias("hashes"))
    hits = None
    for width in widths:
        own = texts.select("key", F.lit(width).alias("width"), F.size("hashes").alias("n_words"), F.posexplode(_shingles(F.col("hashes"), width)).alias("pos", "h"))
        found = own.join(hint(spread), ["width", "h"])
        hits = found if hits is None else hits.union(found)
    last = F.greatest(F.col("n_words") - F.col("width") + 1 - F.col("m"), F.lit(0))
    start = F.greatest(F.least(F.col("pos") - F.col("at"), last), F.lit(0))
    laid = durable(hits.groupBy("key", "item_id", "width", "m", start.alias("start")).agg(F.sum("weight").alias("hits")), "windows")

    # a window can't hold more of an item than the whole text does, which the hits of all
    # windows bound from above (copies only raise them): a text that holds too little of
    # every item has no window to look up
    enough = laid.groupBy("key", "item_id").agg(F.sum("hits").alias("hits")).join(totals, "item_id")
    enough = enough.filter(F.col("hits") >= 0.999 * similarity * F.col("total")).select("key", "item_id")
    chosen = laid.join(enough, ["key", "item_id"]).groupBy("key").agg(F.collect_set(F.struct("width", "m", "start")).alias("w"))
    chosen = durable(chosen, "chosen")
    few = lambda df, most: F.broadcast(df) if df.count() <= most else df
    # few texts hold much of an item; only their words are cut into windows
    held_in = docs.select(F.md5(text).alias("key"), text.alias("text")).join(few(chosen, broadcast_rows // 8), "key")
    part = lambda h, w: F.slice(h, w["start"] + 1, w["m"] + w["width"] - 1)
    cuts = let(_word_hashes(F.col("text")), lambda h: F.transform("w", lambda w: F.struct(*(w[c].alias(c) for c in ("width", "m", "start")), part(h, w).alias("words"))))
    window = ["key", "width", "m", "start"]
    cut = held_in.select("key", F.inline(cuts)).dropDuplicates(window)
    shingles = reduce(lambda rest, w: F.when(F.col("width") == w, _shingles(F.col("words"), w)).otherwise(rest), widths, F.array().cast("array<bigint>"))
    shingled = cut.select(*window, shingles.alias("window"))
    held = shingled.select(*window, F.size("window").alias("size"), F.explode("window").alias("h")).groupBy(*window, "size", "h").agg(F.count("*").alias("n_window"))
    known = durable(held.join(hint(weights), ["width", "h"]), "held")

    prints = simhash(known.withColumnRenamed("n_window", "n"), window)
    candidates = items_near(prints, simhash(per_item, ["item_id", "width", "m"]), radius)
    shared = known.select(*window, "size", "h", "n_window").join(candidates.select(*window, "item_id"), window).join(hint(per_item.drop("width", "m")), ["item_id", "h"])
    scored = shared.groupBy(*window, "item_id", "size").agg(F.sum(F.least("n", "n_window") * F.col("weight")).alias("shared")).join(totals, "item_id")
    alike = scored.withColumn("similarity", F.round(F.col("shared") / F.col("total"), 6)).filter(F.col("similarity") >= similarity)
    best = alike.groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("first"), (F.col("size") + F.col("width") - 1).alias("n_words"))).alias("b"))
    result = docs.select(F.col(id_col), F.md5(text).alias("key")).join(few(durable(best, "best"), broadcast_rows), "key")
    return result.select(id_col, "item_id", "b.similarity", (-F.col("b.first")).cast("bigint").alias("start_word"), F.col("b.n_words").cast("bigint").alias("n_words"))


def without_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = 2_000_000, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; texts decide, so ids may be null or repeated. All columns stay.

    The keys of contaminated texts are broadcast up to ``broadcast_keys``.
    """
    own = fresh("_key", docs.columns)
    numbered = docs.withColumn(own, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    found = contaminated(numbered.select(F.col(own).alias("doc_id"), F.col(text_col).alias("text")), bench, **options)
    keys = durable(found.select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    keys = F.broadcast(keys) if keys.count() <= broadcast_keys else keys
    return numbered.join(keys, own, "left_anti").select(*docs.columns)
