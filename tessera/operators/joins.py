"""Joins that Spark has no operator for, as rewrites without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], prefix: str = "r_", slice_seconds: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time; nulls where there is none.

    Both sides are united and the last right row is carried forward in (key, time) order:
    one shuffle by key, no pairs. Of right rows at the same time the largest by ``values``
    is taken. Rows whose key or time is null match nothing. For hot keys give
    ``slice_seconds``: a key is then dealt by slices of time, each slice starting from the
    last right row before it.
    """
    mark = F.struct(F.col(at).alias("at"), *values)
    l = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("_right"))
    r = right.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), mark.alias("_right"))
    both = l.union(r)
    group = ["_k"]
    if slice_seconds:
        piece = F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (slice_seconds * 1_000_000))
        both = both.withColumn("_slice", piece)
        # per key and slice its last right row, then the last of all earlier slices
        ends = both.groupBy("_k", "_slice").agg(F.max("_right").alias("_end"))
        earlier = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.select("_k", "_slice", F.max("_end").over(earlier).alias("_start"))
        both = both.join(starts, both._k.eqNullSafe(starts._k) & both._slice.eqNullSafe(starts._slice)).drop(starts._k).drop(starts._slice)
        group = ["_k", "_slice"]
    order = Window.partitionBy(*group).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_right", ignorenulls=True).over(order)
    if slice_seconds:
        last = F.coalesce(last, F.col("_start"))
    found = both.select("_side", "_row", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), last).alias("_found"))
    return found.filter("_side = 1").select("_row.*", F.col("_found.at").alias(prefix + at), *(F.col(f"_found.{v}").alias(prefix + v) for v in values))


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, seconds: int, prefix: str = "r_") -> DataFrame:
    """Pairs of equal key whose right time lies in [left time, left time + ``seconds``].

    Time is cut into buckets of that length; a left row looks in its own and the next
    bucket, so the join is an equi-join on (key, bucket) and the bound is rechecked.
    Null keys and times match nothing.
    """
    bucket = lambda: F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))
    l = left.withColumn("_b", F.explode(F.array(bucket(), bucket() + 1)))
    r = right.withColumn("_b", bucket()).select(F.col(key).alias("_k"), "_b", F.col(at).alias("_t"), *(F.col(c).alias(prefix + c) for c in right.columns))
    joined = l.join(r, (F.col(key) == F.col("_k")) & (l._b == r._b))
    within = (F.col("_t") >= F.col(at)) & (F.col("_t") <= F.col(at) + F.expr(f"INTERVAL {seconds} SECONDS"))
    return joined.filter(within).select(*left.columns, *(prefix + c for c in right.columns))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= value < high for numeric columns, an equi-join on buckets.

    Buckets come in levels, each twice as wide as the one before, the first ``width`` wide. A
    range is listed at the level of its own length, in at most three buckets however wide it
    is; a point is listed once for each level that some range has. Null bounds and values match nothing.
    """
    at = lambda c, level: F.floor(c / (F.lit(float(width)) * F.pow(F.lit(2.0), level)))
    length = (F.col(high) - F.col(low)) / F.lit(float(width))
    level = F.greatest(F.ceil(F.log2(length)), F.lit(0)).cast("int")
    r = ranges.filter(F.col(low) < F.col(high)).withColumn("_level", level)
    r = r.withColumn("_b", F.explode(F.sequence(at(F.col(low), F.col("_level")), at(F.col(high), F.col("_level")))))
    levels = sorted(x[0] for x in r.select("_level").distinct().collect())  # at most one a power of two
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    joined = p.withColumn("_b", at(F.col(value), F.col("_level"))).join(r, ["_level", "_b"])
    return joined.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_level", "_b")


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join of a large side with hot keys: its rows are dealt over ``salts`` copies of the other side's.

    The salt is a hash of the row, so a task that runs again deals it alike; equal rows share
    a salt. ``how``: inner, left, left_semi or left_anti (the large side is the left one).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}: the copies of the small side would be matched one by one")
    hashed = [f.name for f in large.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def counted_join(large: DataFrame, small: DataFrame, keys: list[str], count: str, share: int = 100_000, how: str = "inner") -> DataFrame:
    """Equi-join (inner or left) with one row per key that says, in ``count``, how many rows of the large side have the key.

    Keys with more than one of ``share`` of all rows are at most ``share``, whatever the
    tables' size: they are broadcast, so no hot key lands in one task. The other keys are
    joined by shuffle. ``large`` and ``small`` are read twice; store them first.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = small.filter(F.col(count) > total / share)
    cold = small.filter(F.col(count) <= total / share)
    near = large.join(F.broadcast(hot), keys)
    return near.union(large.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how).select(*near.columns))


def not_in(left: DataFrame, key: str, listed: DataFrame, value: str) -> DataFrame:
    """SQL's ``key NOT IN (SELECT value FROM listed)`` as an equi-join.

    A null in the list leaves no row; a null key stays only if the list is empty. Spark's own plan
    broadcasts the list whole; here it is shuffled without repeats, and only its two counts (rows, nulls) are broadcast.
    """
    v = F.col(value)
    counts = listed.agg(F.count("*").alias("_listed"), F.count_if(v.isNull()).alias("_nulls"))
    kept = left.crossJoin(F.broadcast(counts)).filter((F.col("_listed") == 0) | (F.col("_nulls") == 0) & F.col(key).isNotNull())
    keys = listed.select(v.alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    return kept.join(keys, F.col(key) == F.col("_v"), "left_anti").select(*left.columns)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
