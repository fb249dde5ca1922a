"""Vectors: norms, combinations, user vectors, nearest neighbours, text vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.operators.ranking import top_per_group


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, eps: float = 1e-9) -> Column:
    """The vector at length 1; one of no length stays as it is."""
    n = norm(v)
    return F.when(n < eps, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


#: Ids that are broadcast, so that what has no vector isn't moved; longer lists are joined as Spark likes.
IDS = 1_000_000


def ids_of(items: DataFrame) -> DataFrame:
    """(item_id): each id once, to be broadcast if there are few."""
    ids = items.select("item_id").distinct()
    return F.broadcast(ids) if items.count() <= IDS else ids


def known_views(watches: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, item_id, w): who watched which of the items with a vector, and the sum of the completions over 0, null without any.

    Views of items without a vector are left out before anything is grouped.
    """
    known = watches.select("user_id", "item_id", "completion").join(ids_of(vectors), "item_id", "left_semi")
    return known.groupBy("user_id", "item_id").agg(F.sum(F.when(F.col("completion") > 0, F.col("completion"))).alias("w"))


def user_vectors(watches: DataFrame, vectors: DataFrame, vector: str) -> DataFrame:
    """(user_id, vector, items): the mean of a user's item vectors, weighted by completion, at length 1."""
    return mean_vectors(known_views(watches, vectors), vectors, vector)


def mean_vectors(known: DataFrame, vectors: DataFrame, vector: str) -> DataFrame:
    """(user_id, vector, items) from ``known_views``: the weighted mean of a user's item vectors, at length 1.

    A block of users has its views as one row, which meets blocks of vectors where they are: a view is
    shuffled as two ids and a weight, and neither with its vector nor as a row for each component.
    """
    views = known.filter("w IS NOT NULL")
    n = views.count()
    asks, rows = max(1, -(-n // VIEWS)), max(1, -(-vectors.count() // HELD_ROWS))
    packed = vectors.select("item_id", vector).filter(F.col(vector).isNotNull()).withColumn("_of", _block_of("item_id", rows)).repartition(max(1, -(-rows // HELD)), "_of").groupBy("_of").agg(F.collect_list(F.struct("item_id", vector)).alias("rows"))
    packed = _matrices(packed, "rows", unit=False)
    views = views.withColumn("_block", _block_of("user_id", asks)).repartition(asks, "_block").groupBy("_block").agg(F.collect_list(F.struct("user_id", "item_id", "w")).alias("views"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, users, total = None, np.zeros(0, np.int64), None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch["_block"][i].as_py() != block:
                    if total is not None:
                        yield _sums(block, users, total)
                    block, total = batch["_block"][i].as_py(), None
                    u, item, w = _columns(batch["views"][i])
                    order = np.argsort(u, kind="stable")
                    (users, at), item, w = np.unique(u[order], return_inverse=True), item[order], w[order]
                ids, x = _read(batch["rows"][i])
                order = np.argsort(ids, kind="stable")
                place = np.searchsorted(ids[order], item)
                times = np.searchsorted(ids[order], item, side="right") - place
                there = np.repeat(np.arange(len(item)), times)  # a view counts for each vector of its item
                place = order[np.arange(len(there)) - np.repeat(np.cumsum(times) - times, times) + place[there]]
                if total is None:  # of each user the sum of weighted vectors, of the weights, and the items
                    total = np.zeros((len(users), x.shape[1] + 2))
                for k in range(0, len(there), PART):
                    some = there[k : k + PART]
                    first = np.flatnonzero(np.r_[True, at[some][1:] != at[some][:-1]])
                    of = w[some][:, None]
                    total[at[some][first]] += np.add.reduceat(np.hstack([x[place[k : k + PART]] * of, of, np.ones_like(of)]), first, axis=0)
        if total is not None:
            yield _sums(block, users, total)

    sums = views.crossJoin(packed).select("_block", "views", "rows").mapInArrow(run, "_block long, ids binary, sums binary")
    if rows > HELD:  # else each block has met all vectors in one task
        sums = sums.groupBy("_block").applyInArrow(_added, sums.schema)
    return sums.mapInArrow(_means, "user_id long, vector array<double>, items long")


#: Views of a block of users and vectors of a block that it meets, on average, and views whose vectors are looked at at a time.
VIEWS, HELD_ROWS, PART = 100_000, 16_384, 50_000


def _sums(block: int, users: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([users.astype(np.int64).tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["_block", "ids", "sums"])


def _added(parts: pa.Table) -> pa.Table:
    """The sums of one block, whose users are the same and in the same order in all parts."""
    ids = np.frombuffer(parts["ids"][0].as_buffer(), np.int64)
    return pa.Table.from_batches([_sums(parts["_block"][0].as_py(), ids, sum(np.frombuffer(s.as_buffer()).reshape(len(ids), -1) for s in parts["sums"]))])


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, raw in zip(batch["ids"], batch["sums"], strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            total = np.frombuffer(raw.as_buffer()).reshape(len(ids), -1)
            some = total[:, -1] > 0
            mean, items = total[some, :-2] / total[some, -2:-1], total[some, -1].astype(np.int64)
            length = np.sqrt(np.einsum("ij,ij->i", mean, mean))[:, None]
            mean = mean / np.where(length < 1e-9, 1.0, length)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mean) + 1) * mean.shape[1], pa.int32()), pa.array(mean.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), lists, pa.array(items)], names=["user_id", "vector", "items"])


#: Rows of one side that are held against the other at a time, on average.
BLOCK = 2048


def top_positions(vector: Column, n: int) -> Column:
    """The (position, value) of the ``n`` highest components of each row's vector, highest first, ties to the smaller position."""
    ordered = F.array_sort(F.transform(vector, lambda x, i: F.struct((-x).alias("o"), i.alias("position"), x.alias("value"))))
    return F.transform(F.slice(ordered, 1, n), lambda s: F.struct(s.position.alias("position"), s.value.alias("value")))


def partial_top(scores: np.ndarray, n: int) -> np.ndarray:
    """Of each row the positions of the ``n`` highest scores, highest first, ties to the smaller position. Selects by partition and sorts only what is left."""
    if scores.shape[1] > n:
        least = np.partition(scores, -n, axis=1)[:, -n, None]
        tied = scores == least
        above = scores > least
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= n - above.sum(axis=1, keepdims=True)))
        at = np.nonzero(chosen)[1].reshape(len(scores), n)
    else:
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    order = np.argsort(-np.take_along_axis(scores, at, axis=1), axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1)


def _packed(rows: DataFrame, key: str, name: str, blocks: int, parts: int = 0) -> DataFrame:
    """Blocks of about BLOCK rows (key first, then vectors), dealt by a hash of the key: (block, name). They lie in ``parts`` partitions, as many as there are blocks if 0."""
    return _matrices(_grouped(rows, key, name, blocks, parts), name)


def _grouped(rows: DataFrame, key: str, name: str, blocks: int, parts: int = 0) -> DataFrame:
    """As ``_packed``, as lists of rows. They are shuffled once."""
    dealt = rows.withColumn(f"{name}_block", _block_of(key, blocks)).repartition(parts or blocks, f"{name}_block")
    return dealt.groupBy(f"{name}_block").agg(F.collect_list(F.struct(*rows.columns)).alias(name))


def _packed_by(rows: DataFrame, key: str, name: str, block: int, by: str) -> DataFrame:
    """As ``_packed`` within each value of ``by``, which gets as many blocks as its own rows ask for."""
    rest = [c for c in rows.columns if c != by]
    counts = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    return _matrices(rows.join(counts, by).groupBy(by, F.pmod(F.xxhash64(key), F.col("_blocks")).alias(f"{name}_block")).agg(F.collect_list(F.struct(*rest)).alias(name)), name)


def _matrices(grouped: DataFrame, name: str, unit: bool = True) -> DataFrame:
    """Lists of ids and vectors as raw ids and matrices of vectors at length 1 (with ``unit``), which cost the same to read each time they meet a block."""
    at = grouped.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *some = _columns(batch[name][i])
                raw = [ids.astype(np.int64).tobytes()]
                for x in some:
                    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                    raw.append((x / np.where(length < 1e-9, 1.0, length) if unit else x).tobytes())
                columns = [batch.column(k).slice(i, 1) for k in range(batch.num_columns)]
                columns[at] = pa.array([raw], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.BinaryType())) if f.name == name else f for f in grouped.schema])
    return grouped.mapInArrow(run, schema)


#: Blocks of candidates that one task holds against a block of asking rows, and tasks that a product is cut into at least, if it has so many blocks.
HELD, TASKS = 64, 64


def _crossed(asks: DataFrame, asking: str, rows: DataFrame, key: str, block: int) -> DataFrame:
    """Every block of ``asks`` with every block of ``rows``. A task has one block that asks and meets it with a part of the others."""
    a, b = _blocks(asks, block), _blocks(rows, block)
    return _packed(asks, asking, "asks", a).crossJoin(_packed(rows, key, "rows", b, min(b, max(-(-b // HELD), -(-TASKS // a)))))


def _block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _blocks(rows: DataFrame, block: int) -> int:
    return max(1, -(-rows.count() // block))


def _columns(rows: pa.ListScalar) -> list[np.ndarray]:
    """The fields of a packed block: ids as they are, vectors as matrices."""
    n = len(rows.values)
    fields = rows.values.flatten()
    return [f.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if pa.types.is_list(f.type) else f.to_numpy(zero_copy_only=False) for f in fields]


#: Asking rows that are scored at a time, columns that share a maximum, and blocks of asking rows whose best are kept within a task.
ROWS, GROUPS, KEPT = 32, 64, 64


def _candidates(scores: np.ndarray, least: np.ndarray, n: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of all that may be among the ``n`` best rounded scores of a row and may reach ``least`` there, and few others.

    The n-th of the maxima of a row's groups of columns is a bound that n scores reach, so only a few have to
    be rounded and ordered. Rows of too many equal scores are selected by partition, ties to the smaller column.
    """
    k, width = scores.shape
    whole, slack = width // GROUPS, 2.0 * 10.0**-digits
    if whole and n <= GROUPS // 2:
        maxima = scores[:, : whole * GROUPS].reshape(k, whole, GROUPS).max(axis=1)
        bound = (np.maximum(np.partition(maxima, -n, axis=1)[:, -n], least) - slack).astype(scores.dtype)
        at = np.flatnonzero(scores >= bound[:, None])
        if len(at) <= 16 * n * k:
            row, column = np.divmod(at, width)
            return row, column, np.round(scores[row, column].astype(np.float64), digits)
    rounded = np.round(scores.astype(np.float64), digits)
    column = partial_top(rounded, n)
    row = np.repeat(np.arange(k), column.shape[1])
    return row, column.ravel(), rounded[row, column.ravel()]


def _first_of_each(row: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` highest scores of each row, ties to the smaller item."""
    order = np.lexsort((item, -score, row))
    row, item, score = row[order], item[order], score[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    keep = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) < n
    return row[keep], item[keep], score[keep]


def _read(block: pa.ListScalar) -> list[np.ndarray]:
    """The ids and matrices of a block."""
    ids, *some = (x.as_buffer() for x in block.values)
    ids = np.frombuffer(ids, np.int64)
    return [ids, *(np.frombuffer(x, np.float64).reshape(len(ids), -1) for x in some)]


def _best_in_tiles(tiles: DataFrame, names: list[str], scores: Callable[..., np.ndarray], n: int, least: float, digits: int) -> DataFrame:
    """The ``n`` best of each asking row over all tiles (asks, rows and, optionally, pairs to leave out): names[0], names[1], score, rank.

    Blocks are read from Arrow as matrices: no row of them becomes a Python object. A task keeps the best
    of the blocks that ask, and sends them on once for all tiles of theirs that it has seen in a row; what the
    next tile has to reach is known from them. ``scores`` are rounded to ``digits`` here.
    """
    floor = max(least, -9.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for qi, row, item, score in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(item), pa.array(score)], names=[*names, "score"])
            best.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                (qi, *q), (ci, *c) = _read(batch["asks"][i]), _read(batch["rows"][i])
                order = np.argsort(ci, kind="stable")
                ci, c = ci[order], [x[order] for x in c]
                if "out" in batch.schema.names:
                    a, b = _columns(batch["out"][i]) if batch["out"][i].is_valid else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    known = np.isin(a, qi) & np.isin(b, ci)
                    at = np.argsort(qi, kind="stable")
                    gone = at[np.searchsorted(qi[at], a[known])], np.searchsorted(ci, b[known])
                else:  # a row isn't its own neighbour
                    first = np.searchsorted(ci, qi)
                    times = np.searchsorted(ci, qi, side="right") - first
                    asking = np.repeat(np.arange(len(qi)), times)
                    gone = asking, np.arange(len(asking)) - np.repeat(np.cumsum(times) - times, times) + first[asking]
                key = qi.tobytes()
                if key not in best and len(best) >= KEPT:
                    yield from sent()
                none = np.zeros(0, np.int64)
                _, *old = best.get(key, (qi, none, none, np.zeros(0)))
                reach = np.full(len(qi), floor)
                full = np.flatnonzero(np.bincount(old[0], minlength=len(qi)) >= n)
                if len(full):
                    last = np.full(len(qi), np.inf)
                    np.minimum.at(last, old[0], old[2])
                    reach[full] = last[full]
                parts = [tuple(old)]
                for k in range(0, len(qi), ROWS):
                    found = scores([x[k : k + ROWS] for x in q], c)
                    mine = (gone[0] >= k) & (gone[0] < k + ROWS)
                    found[gone[0][mine] - k, gone[1][mine]] = -9.0
                    row, column, score = _candidates(found, reach[k : k + ROWS], n, digits)
                    keep = score > floor
                    parts.append((row[keep] + k, ci[column[keep]], score[keep]))
                best[key] = (qi, *_first_of_each(*(np.concatenate(x) for x in zip(*parts, strict=True)), n))
        yield from sent()

    columns = [c for c in ("asks", "rows", "out") if c in tiles.columns]
    found = tiles.select(*columns).mapInArrow(run, f"{names[0]} long, {names[1]} long, score double")
    return top_per_group(found, [names[0]], [F.desc("score"), F.col(names[1])], n)


def nearest(queries: DataFrame, candidates: DataFrame, n: int, least: float = -2.0, block: int = BLOCK, by: str | None = None, digits: int = 6) -> DataFrame:
    """(query_id, item_id, score, rank): the ``n`` candidates of highest cosine (over ``least``) for each query, itself left out.

    ``queries``: query_id, vector; ``candidates``: item_id, vector; with ``by``, a column of both,
    only rows of equal values meet. Both sides are packed into blocks of about ``block`` rows, each
    one row of the wire, and every two blocks are multiplied: a blocked matrix product in which
    neither side is ever whole in one place.
    """
    scores = lambda q, c: q[0] @ c[0].T
    if by:
        tiles = _packed_by(queries.select("query_id", "vector", by), "query_id", "asks", block, by).join(_packed_by(candidates.select("item_id", "vector", by), "item_id", "rows", block, by), by)
    else:
        tiles = _crossed(queries.select("query_id", "vector"), "query_id", candidates.select("item_id", "vector"), "item_id", block)
    return _best_in_tiles(tiles, ["query_id", "item_id"], scores, n, least, digits)


def late_fusion(visual: DataFrame, content: DataFrame, alpha: float = 0.4) -> DataFrame:
    """(item_id, score) of two result lists: alpha counts only where there is a positive visual score."""
    rows = visual.select("item_id", F.col("score").alias("_v")).join(content.select("item_id", F.col("score").alias("_c")), "item_id", "full_outer")
    v, c = F.coalesce("_v", F.lit(0.0)), F.coalesce("_c", F.lit(0.0))
    return rows.select("item_id", F.when(v > 0, alpha * v + (1 - alpha) * c).otherwise(c).alias("score"))


def ingest(raw: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a frame with item_id and vector: the right size, no nulls, length over 0; accepted ones at length 1 with their magnitude."""
    ok = F.coalesce((F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull()) & (norm(F.col("vector")) > 0), F.lit(False))
    marked = raw.withColumn("_ok", ok)
    accepted = marked.filter("_ok").select("item_id", norm(F.col("vector")).alias("magnitude"), normalised(F.col("vector")).alias("vector"))
    return accepted, marked.filter("NOT _ok").drop("_ok")


def ensemble(sources: DataFrame, items: DataFrame, n: int, alpha: float = 0.4) -> DataFrame:
    """(source_id, item_id, score, rank): neighbours by alpha * visual + (1 - alpha) * meta cosine; a visual cosine of 0 or less, or 1 or more, doesn't count.

    Both sides meet in blocks, as in ``nearest``.
    """
    def scores(q: list[np.ndarray], c: list[np.ndarray]) -> np.ndarray:
        visual, meta = q[0] @ c[0].T, q[1] @ c[1].T
        counts = (visual > 0) & (visual < 1)
        visual *= alpha
        visual += (1 - alpha) * meta
        np.copyto(meta, visual, where=counts)
        return meta

    tiles = _crossed(sources.select("item_id", "visual", "meta"), "item_id", items.select("item_id", "visual", "meta"), "item_id", BLOCK)
    return _best_in_tiles(tiles, ["source_id", "item_id"], scores, n, -9.0, 5)


def user_neighbours(users: DataFrame, items: DataFrame, watched: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """(user_id, item_id, score, rank): for each user the unwatched items of highest positive cosine.

    ``users``: user_id, vector; ``items``: item_id, vector. What the users of a block have watched of the items
    that are to be ranked lies beside the block, so the products of blocks are made where they are used and never shuffled.
    """
    ub, ib = _blocks(users, BLOCK), _blocks(items, BLOCK)
    seen = watched.select("user_id", "item_id").join(ids_of(items), "item_id", "left_semi").distinct()
    seen = _grouped(seen.select("user_id", "item_id"), "user_id", "asks", ub).withColumnRenamed("asks", "out")
    asked = _matrices(_grouped(users.select("user_id", "vector"), "user_id", "asks", ub).join(seen.hint("merge"), "asks_block", "left"), "asks")
    packed = _packed(items.select("item_id", "vector"), "item_id", "rows", ib, min(ib, max(-(-ib // HELD), -(-TASKS // ub))))
    return _best_in_tiles(asked.crossJoin(packed), ["user_id", "item_id"], lambda q, c: q[0] @ c[0].T, n, 0.0, digits)


def attributed(recommended: DataFrame, watches: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, item_id, source_id): the other item of the same class in a user's own history that is most like a recommended one.

    ``recommended``: user_id, item_id; ``vectors``: item_id, vector, ct_cl. A user's few recommendations
    meet their own history only.
    """
    side = lambda rows, name: rows.join(vectors.select("item_id", "ct_cl", normalised(F.col("vector")).alias(f"_{name}")), "item_id")
    mine = side(watches.select("user_id", "item_id").distinct(), "w").withColumnRenamed("item_id", "source_id")
    pairs = side(recommended, "r").join(mine, ["user_id", "ct_cl"]).filter("item_id <> source_id").withColumn("_s", F.round(dot(F.col("_r"), F.col("_w")), 5))
    return top_per_group(pairs, ["user_id", "item_id"], [F.desc("_s"), F.col("source_id")], 1, "_n").select("user_id", "item_id", "source_id")
