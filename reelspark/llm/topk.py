"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. Queries and candidates are packed into blocks, each a row
of bounded size, and every block of queries meets every block of candidates in some task: neither
side is ever whole in one place. There the candidates form postings by term (dimension), and the
queries are worked through term by term: each query's weight scatters the term's weighted postings
into a dense array of scores, one row for each query. Then a partition selection keeps each query's
best, which are merged over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import materialise, read_table

#: Rows in a block on average, of queries and of candidates: this bounds a task's input and its array of scores.
BLOCK = 2048

FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs; null where the vector is null or holds null, NaN or an infinity."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(vector.isNotNull() & usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _block(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a block; shorter vectors are padded with zeros."""
    ids, vectors = rows.values.flatten()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return ids.to_numpy(), out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores and their ids, ties to smaller ids. Partition selection, then order within."""
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        # all above the k-th score, then as many of those equal to it as there is room for, smaller ids first
        above = scores > least
        room = k - above.sum(axis=1, keepdims=True)
        tied = scores == least
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= room))
        at = np.nonzero(chosen)[1].reshape(len(scores), k)
    else:
        at = np.broadcast_to(np.arange(n), (len(scores), n))
    return np.take_along_axis(scores, at, axis=1), ids[at]


def _accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores, queries x candidates, term at a time."""
    scores = np.zeros((len(queries), len(candidates)), dtype=np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        asks = np.flatnonzero(queries[:, term])
        postings = np.flatnonzero(candidates[:, term])
        if not len(asks) or not len(postings):
            continue
        weighted = np.outer(queries[asks, term], candidates[postings, term])
        if len(asks) == len(queries) and len(postings) == len(candidates):
            scores += weighted
        else:
            scores[np.ix_(asks, postings)] += weighted
    return scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row, the k highest inner products with all other rows.

    Scores are exact integer inner products of floor(scale * x); ties go to the smaller id. A query
    with fewer other rows gets them all. Vectors that are null or hold a null, a NaN or an infinity
    take no part, nor do rows without an id; shorter vectors count as padded with zeros, so that an
    empty one scores 0. Rows with the query's own id are no candidates for it; of other repeated
    ids, each row counts, and a query id that repeats is answered for the smallest of its vectors.
    Products must fit 64 bits. An empty table gives none; other columns are ignored.

    The work is queries times rows. A pair of blocks sends k rows for each of its queries.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), quantised(F.col(vector_column), scale).alias("v"), is_query.alias("q"))
    rows = materialise(rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("n", F.monotonically_increasing_id()))
    asked = rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"), F.min("n").alias("n"))

    def packed(side: DataFrame, name: str) -> DataFrame:
        blocks = max(1, -(-side.count() // block))
        of = F.pmod(F.xxhash64("n"), F.lit(blocks))
        return side.groupBy(of.alias("b")).agg(F.collect_list(F.struct("vec_id", "v")).alias(name)).drop("b")

    # one row for each pair of blocks
    tiles = materialise(packed(asked, "asks")).crossJoin(materialise(packed(rows, "rows")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asks, these in zip(*batch.columns, strict=True):
                (ids, queries), (own, candidates) = _block(asks), _block(these)
                # some more, as the query itself may be among them
                s, i = _best(_accumulate(queries, candidates), own, k + int(_repeats(own, ids)))
                i, s = _others(s, i, ids, k)
                some = i != _NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, some.sum(axis=1))), pa.array(i[some]), pa.array(s[some])], names=["query_id", "vec_id", "score"])

    found = tiles.mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_NONE = np.iinfo(np.int64).min


def _repeats(own: np.ndarray, ids: np.ndarray) -> int:
    """How often at most one of ``ids`` stands among ``own``."""
    found, counts = np.unique(own[np.isin(own, ids)], return_counts=True)
    return counts.max(initial=0)


def _others(scores: np.ndarray, found: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best (ids, scores), ties to smaller ids, without the query's own id; _NONE fills up rows that have fewer."""
    gone = found == own[:, None]
    order = np.lexsort((found, -scores, gone), axis=1)[:, :k]
    out = np.take_along_axis(found, order, axis=1)
    out = np.where(np.take_along_axis(gone, order, axis=1), _NONE, out)
    return out, np.take_along_axis(scores, order, axis=1)


# ---- queries ----


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every fiftieth vector among all others, by integer inner product."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op1_topk": op1_topk}
ORACLES = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, 1 + len(q.v)), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
