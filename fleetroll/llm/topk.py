"""Exact top-k inner products by norm buckets.

Vectors are dealt into buckets by length. Queries first meet the bucket of the longest vectors, which gives each a lower bound
for its k-th best score. That bound rules out whole buckets of shorter vectors; against the others it becomes a cosine
threshold for every run of vectors of similar length. Where the threshold is high, only vectors whose coordinates lie close
enough to the query's largest ones are candidates (coordinate pruning); where it is low, all vectors long enough are (length
pruning). Candidates are then multiplied out, and the bound rises with what is found.

Queries and buckets meet in cells (bucket, block of queries), so a task holds one bucket and one block at most.

Vectors that are null, empty or hold null or non-finite components take no part. Rows that repeat id and vector count once; a
query never meets a row with its own id. Vectors of different lengths are compared as if filled up with zeros. Components
beyond a long are cut to the nearest long, as are scores. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

BUCKET_ROWS, BLOCK_ROWS, RUN = 8192, 1024, 1024
#: From this cosine threshold on, a few coordinates tell most vectors apart.
COORDINATES, FOCUS = 0.75, 4
SLACK = 1e-9
FOUND = "query_id bigint, vec_id bigint, score bigint"
LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), norm."""
    whole = (F.col("embedding").isNotNull()) & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    )
    rows = vectors.where(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"),
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.dropDuplicates(["vec_id", "v"]).withColumn("norm", F.sqrt(square))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as doubles, or as Python integers where doubles may not hold them; short ones are filled up with zeros."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    big = len(flat) and max(abs(int(flat.max())), abs(int(flat.min()))) >= 1 << 22
    out = np.zeros((len(sizes), width), object if big else np.float64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(object) if big else flat
    return out


def _width(table: pa.Table) -> int:
    lists = table.column("v").combine_chunks()
    return int(np.diff(lists.offsets.to_numpy()).max(initial=0))


class _Best:
    """The k best of every query of a block, and the scores that the next ones have to reach."""

    def __init__(self, ids: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.k, self.bound = ids, k, bound.astype(float)
        self.rows = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def add(self, q: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        other = self.ids[q] != vec_id
        new = (q[other], vec_id[other], score[other])
        q, vec_id, score = (np.concatenate([a, b]) for a, b in zip(self.rows, new))
        order = np.lexsort((vec_id, -score, q))
        q, vec_id, score = q[order], vec_id[order], score[order]
        first = np.searchsorted(q, q, "left")
        place = np.arange(len(q)) - first
        keep = place < self.k
        last = place == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], score[last])
        self.rows = (q[keep], vec_id[keep], score[keep])


def _scores(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return np.array([min(max(int(s), LONG.min), LONG.max) for s in x.reshape(-1)], np.int64).reshape(x.shape)
    return x.astype(np.int64)


def search_cell(queries: pa.Table, vectors: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best vectors of one bucket for one block: positions of queries, vector ids, scores. Results below bounds may lack."""
    width = max(_width(queries), _width(vectors))
    q, p = _matrix(queries.column("v"), width), _matrix(vectors.column("v"), width)
    q_norm, p_norm = queries.column("norm").to_numpy(), vectors.column("norm").to_numpy()
    ids = vectors.column("vec_id").to_numpy()
    order = np.lexsort((ids, -p_norm))
    p, p_norm, ids = p[order], p_norm[order], ids[order]
    best = _Best(queries.column("vec_id").to_numpy(), queries.column("bound").to_numpy(), k)
    unit_q = q.astype(float) / np.maximum(q_norm, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    for at in range(0, len(p), RUN):
        run, norms, names = p[at : at + RUN], p_norm[at : at + RUN], ids[at : at + RUN]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(best.bound > 0, best.bound / (q_norm * norms[0]), -np.inf)  # cosine threshold of this run
        local = np.nan_to_num(local, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        near = np.flatnonzero((local >= COORDINATES) & (local <= 1 + SLACK))
        far = np.flatnonzero(local < COORDINATES)
        if len(near):
            unit = run.astype(float) / np.maximum(norms, 1e-300)[:, None]
            for i in near:
                t = min(local[i], 1.0)
                f = focus[i]
                c = unit_q[i, f]
                spread = np.sqrt(np.maximum((1 - t * t) * (1 - c * c), 0)) + SLACK
                # a cosine of t or more keeps the other's coordinate within t * c +- spread, or beyond it towards c
                upper = np.where(c > t, 2.0, c * t + spread)
                lower = np.where(c < -t, -2.0, c * t - spread)
                x = unit[:, f]
                cand = np.flatnonzero(((x <= upper) & (x >= lower)).all(axis=1))
                if len(cand):
                    score = _scores(run[cand] @ q[i])
                    best.add(np.full(len(cand), i), names[cand], score)
        if len(far):
            longest = np.searchsorted(-norms, -np.min(local[far]) * norms[0] * (1 - SLACK) + SLACK, "right")
            some = run[: len(run) if not np.isfinite(np.min(local[far])) or np.min(local[far]) <= 0 else max(longest, 1)]
            score = _scores(q[far] @ some.T)
            least = best.bound[far]
            if score.shape[1] > k + 1:  # one more, for the query's own row
                least = np.maximum(least, -np.partition(-score, k, axis=1)[:, k].astype(float))
            a, b = np.nonzero(score.astype(float) >= least[:, None])
            best.add(far[a], names[b], score[a, b])
    return best.rows


def _found(cells: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, vec_id, score = search_cell(left, right, k)
            columns = [left.column("vec_id").to_numpy()[q], vec_id, score]
        else:
            columns = [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    keys = ("bucket", "block")
    vectors = vectors.toDF(*vectors.columns)  # both sides come from one table: names of their own
    return cells.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(search, FOUND)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows, ties to the smaller vec_id."""
    rows = saved(quantised(vectors, scale), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    buckets, blocks = max(1, -(-n // bucket_rows)), max(1, -(-n_queries // BLOCK_ROWS))
    # Buckets by length; vec_id parts rows of equal length. Partition numbers rise with length.
    rows = rows.repartitionByRange(buckets, "norm", "vec_id").withColumn("bucket", F.spark_partition_id())
    rows = saved(rows, "buckets")
    longest = {r["bucket"]: r["norm"] for r in rows.groupBy("bucket").agg(F.max("norm").alias("norm")).collect()}  # a row per bucket
    order = sorted(longest)
    top = order[-1] if order else 0
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    queries = rows.where(is_query).select("vec_id", "v", "norm", block)
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def place(bucket: int) -> Column:
        return F.lit(bucket).alias("bucket")

    none = F.lit(float("-inf")).alias("bound")
    first = saved(
        _found(
            queries.select("vec_id", "v", "norm", "block", none, place(top)),
            rows.where(F.col("bucket") == top).select("vec_id", "v", "norm", "bucket", each_block), k,
        ),
        "first",
    )
    # The k-th best so far bounds the rest; with fewer than k there is no bound.
    bounds = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bounds = bounds.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("least").cast("double").alias("bound"))
    bounded = queries.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", none))
    reach = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(float(longest[b])).alias("l")) for b in order[:-1]])
    if len(order) > 1:
        open_buckets = F.filter(
            reach, lambda x: (F.col("bound") <= 0) | (x["l"] * F.col("norm") * (1 + SLACK) + SLACK >= F.col("bound"))
        )
        cells = bounded.select("vec_id", "v", "norm", "block", "bound", F.explode(open_buckets).alias("x"))
        cells = cells.select("vec_id", "v", "norm", "block", "bound", F.col("x.b").alias("bucket"))
        others = rows.where(F.col("bucket") != top).select("vec_id", "v", "norm", "bucket", each_block)
        first = first.unionByName(_found(cells, others, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
