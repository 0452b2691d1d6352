"""Exact nearest vectors by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def _pass(rows: DataFrame, ids, matrix, k: int, digits: int) -> DataFrame:
    """Per task and query of one pass the best ``k`` rows it has seen: (query, id, score, part)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        none = np.zeros(0)
        best_q, best_s, best_i, floor = none.astype(np.int64), none, none.astype(np.int64), np.full(len(ids), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                values = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                rows_i = part.column(0).to_numpy()
                s = np.round(matrix @ values.T, digits)
                s[ids[:, None] == rows_i[None]] = -np.inf
                # what can still be among the best: not below the block's own k-th, nor below the k-th so far (ties stay in)
                own = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(ids), -np.inf)
                q, c = np.nonzero((s >= np.maximum(own, floor)[:, None]) & (s > -np.inf))
                best_q, best_s, best_i = np.concatenate([best_q, q]), np.concatenate([best_s, s[q, c]]), np.concatenate([best_i, rows_i[c]])
                order = np.lexsort((best_i, -best_s, best_q))
                best_q, best_s, best_i = best_q[order], best_s[order], best_i[order]
                first = np.searchsorted(best_q, best_q, side="left")
                keep = np.arange(len(best_q)) - first < k
                best_q, best_s, best_i = best_q[keep], best_s[keep], best_i[keep]
                starts, counts = np.unique(best_q, return_index=True)[1], np.unique(best_q, return_counts=True)[1]
                full = counts == k
                floor[best_q[starts[full]]] = best_s[starts[full] + k - 1]
        yield pa.RecordBatch.from_pydict({"query": pa.array(ids[best_q]), "id": pa.array(best_i), "score": pa.array(best_s)})

    return rows.mapInArrow(run, "query bigint, id bigint, score double").withColumn("part", F.spark_partition_id())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", per_pass: int = 2048, fan: int = 32, digits: int = 9) -> DataFrame:
    """(query, rank, id, score): for each query the ``k`` other vectors of the largest dot products, exactly; no index, no pairs.

    Scores count to ``digits`` decimals, ties go to the lower id; a vector is never its own neighbour (nor is
    another row of its id). Null and non-finite vectors, rows without an id, and vectors of another length than
    the queries' are left out. About ``per_pass`` queries (some 1 MB) are held by every task at a time, as many passes over
    the vectors are made as that takes; a task holds k rows a query, and tasks' rows are merged ``fan`` ways before they meet.
    """
    import numpy as np

    spark = vectors.sparkSession
    q, rows = _usable(queries, id_col, vector_col).dropDuplicates(["id"]), _usable(vectors, id_col, vector_col)
    many, length = q.agg(F.count("*"), F.max(F.size("v"))).first()
    if not many:
        return spark.createDataFrame([], "query bigint, rank int, id bigint, score double")
    q, rows = q.filter(F.size("v") == length), rows.filter(F.size("v") == length)
    passes = -(-many // per_pass)
    found = None
    for n in range(passes):
        block = q.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == n).orderBy("id").collect()
        if block:
            part = _pass(rows, np.array([r.id for r in block]), np.array([r.v for r in block]), k, digits)
            found = part if found is None else found.union(part)
    order = [F.desc("score"), "id"]
    rank = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    near = rank(found.withColumn("part", F.col("part") % fan), "query", "part").drop("rank", "part")
    return rank(near, "query").select("query", "rank", "id", "score")
