"""Implicit-feedback factors by alternating least squares, solved by conjugate gradients over blocks.

Users and items are dealt to blocks by a hash; a block's factors are one row (ids and a matrix). The
pairs lie in tiles, one for each two blocks that share any. In half an iteration each tile meets the
other side's block and takes the factors that it needs to its own side's block, which is solved in
one task: a few products for each pair in place of a dense system for each row. A hot row, whose
factors to read would grow with the data, gets its normal matrix instead, summed up where its pairs lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ranking import top_per_group
from reelspark.operators.vectors import HELD, TASKS, _candidates, _first_of_each

#: Rows and pairs of a block on average, pairs of a row from which it is hot, and steps of a solution.
BLOCK, PAIRS, HOT, STEPS = 2048, 100_000, 100_000, 3
#: Pairs whose factors are on their way at a time: about 3 GB of disk at rank 128. A half iteration over more goes in slices of blocks.
AT_ONCE = 6_000_000
#: Tasks that sum up the blocks' Gram matrices; each sends one matrix to the driver.
GRAM_TASKS = 32
#: Classes of items by the length of their factors: later ones are only looked at by users whom they may still serve.
CLASSES = 8


@dataclass
class Factors:
    """(block, ids, f) of users and of items: ids ascending, f their factors as 32-bit floats row by row."""

    users: DataFrame
    items: DataFrame
    rank: int


def _block_of(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


#: Spark removes what a query has shuffled when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BLOCKS = "block int, ids array<long>, raw_ids binary, f binary, gram binary"


def _started(ids: DataFrame, column: str, blocks: int, rank: int, seed: int) -> DataFrame:
    """(block, ids, f, gram) with small random factors, the same for the same ids and seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, some in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = np.sort(some.values.to_numpy())
                yield _row(block, mine, np.random.default_rng([seed, block]).standard_normal((len(mine), rank), np.float32) * np.float32(0.01))

    return ids.groupBy(_block_of(column, blocks).alias("block")).agg(F.collect_list(column).alias("ids")).mapInArrow(run, _BLOCKS)


def _row(block: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    x = np.ascontiguousarray(x, np.float32)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([(x.T @ x).astype(np.float64).tobytes()], pa.binary())], names=["block", "ids", "raw_ids", "f", "gram"])


def _gram(factors: DataFrame, rank: int) -> np.ndarray:
    """The sum of all blocks' Gram matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(rank * rank)
        for batch in batches:
            for g in batch.column(0).to_pylist():
                out += np.frombuffer(g)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["gram"])

    return sum(np.frombuffer(r["gram"]) for r in factors.select("gram").coalesce(GRAM_TASKS).mapInArrow(run, "gram binary").collect()).reshape(rank, rank)


_PARTS = "block int, kind int, rows binary, at binary, weight binary, f binary"


def _part(block: int, kind: int, rows: np.ndarray, at: np.ndarray, weight: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    raw = [pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in ((rows, np.int32), (at, np.int32), (weight, np.float32), (f, np.float32))]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kind], pa.int32()), *raw], names=["block", "kind", "rows", "at", "weight", "f"])


_TILES = "user_id_block int, item_id_block int, user_id binary, item_id binary, confidence binary, user_id_hot binary, item_id_hot binary"


def _tiled(pairs: DataFrame, blocks: dict[str, int], sides: dict[str, DataFrame]) -> DataFrame:
    """Tiles of pairs whose ids are places in their blocks, once for all iterations."""
    tiles = pairs.groupBy(*[_block_of(c, n).alias(f"{c}_block") for c, n in blocks.items()]).agg(F.collect_list(F.struct("user_id", "item_id", "confidence", "user_id_hot", "item_id_hot")).alias("pairs"))
    for c, side in sides.items():
        tiles = tiles.join(side.select(F.col("block").alias(f"{c}_block"), F.col("ids").alias(f"{c}_ids")), f"{c}_block")
    names = [x.split()[0] for x in _TILES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                some = batch["pairs"][k].values
                of = {c: some.field(c).to_numpy(zero_copy_only=False) for c in ("user_id", "item_id", "confidence", "user_id_hot", "item_id_hot")}
                for c in ("user_id", "item_id"):
                    of[c] = np.searchsorted(batch[f"{c}_ids"][k].values.to_numpy(), of[c]).astype(np.int32)
                of["confidence"] = of["confidence"].astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch[names[0]].slice(k, 1), batch[names[1]].slice(k, 1), *[pa.array([of[c].tobytes()], pa.binary()) for c in names[2:]]], names=names)

    return tiles.select(*names[:2], "pairs", "user_id_ids", "item_id_ids").mapInArrow(run, _TILES)


def _gathered(tiles: DataFrame, mine: str, other: str, factors: DataFrame, rank: int) -> DataFrame:
    """What each block of ``mine`` needs to be solved: pairs with the factors of ``other``, and sums for hot rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            raw = lambda name, k, t: np.frombuffer(batch[name][k].as_buffer(), t)  # noqa: B023, E731
            for k in range(batch.num_rows):
                block, m, at, c, hot = batch["_block"][k].as_py(), raw(mine, k, np.int32), raw(other, k, np.int32), raw("confidence", k, np.float32), raw(f"{mine}_hot", k, np.bool_)
                f = raw("f", k, np.float32).reshape(-1, rank)
                for i in np.unique(m[hot]).tolist():
                    y, w = f[at[hot & (m == i)]], c[hot & (m == i)]
                    new = np.vstack([(y * (w - 1)[:, None]).T @ y, w @ y])
                    sums[block, i] = sums[block, i] + new if (block, i) in sums else new
                need, places = np.unique(at[~hot], return_inverse=True)
                if len(need):
                    yield _part(block, 1, m[~hot], places, c[~hot], f[need])
        for (block, i), s in sums.items():
            yield _part(block, 2, np.array([i]), np.zeros(0), np.zeros(0), s)

    met = tiles.withColumnsRenamed({f"{mine}_block": "_block", f"{other}_block": "block"}).join(factors.select("block", "f"), "block")
    return met.select("_block", mine, other, "confidence", f"{mine}_hot", "f").mapInArrow(run, _PARTS)


def _by_degree(rows: np.ndarray, at: np.ndarray, w: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with up to 1, 2, 4, ... pairs together: (rows, their pairs' factors, confidences, and those less 1), filled up with zeros to the most pairs of any."""
    order = np.argsort(rows, kind="stable")
    rows, at, w = rows[order], at[order], w[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    degree = np.diff(np.r_[first, len(rows)])
    size = np.ceil(np.log2(degree)).astype(int)
    for k in np.unique(size):
        these = np.flatnonzero(size == k)
        at_most = degree[these].max()
        places = first[these][:, None] + np.arange(at_most)
        there = np.arange(at_most) < degree[these][:, None]
        places = np.where(there, places, 0)
        c = np.where(there, w[places], 0).astype(np.float32)
        y = f[at[places]]
        y[~there] = 0
        yield rows[first[these]], y, c, np.where(there, c - 1, 0).astype(np.float32)


def _solve(parts: pa.Table, gram: np.ndarray, steps: int) -> np.ndarray:
    """The factors of a block from those that it has, and what ``_gathered`` sent."""
    rank = len(gram)
    kinds = parts["kind"].to_numpy()
    raw = lambda name, k, t: np.frombuffer(parts[name][int(k)].as_buffer(), t)
    x = raw("f", np.flatnonzero(kinds == 0)[0], np.float32).reshape(-1, rank).copy()
    some = np.flatnonzero(kinds == 1)
    matrices = [raw("f", k, np.float32).reshape(-1, rank) for k in some]
    starts = np.cumsum([0, *map(len, matrices)])
    rows = np.concatenate([raw("rows", k, np.int32) for k in some] or [np.zeros(0, np.int32)])
    at = np.concatenate([raw("at", k, np.int32) + s for k, s in zip(some, starts)] or [np.zeros(0, np.int64)])
    w = np.concatenate([raw("weight", k, np.float32) for k in some] or [np.zeros(0, np.float32)])
    f = np.concatenate(matrices or [np.zeros((0, rank), np.float32)])
    hot = [(int(raw("rows", k, np.int32)[0]), raw("f", k, np.float32).reshape(-1, rank)) for k in np.flatnonzero(kinds == 2)]
    like = list(_by_degree(rows, at, w, f))

    def product(p: np.ndarray, start: bool = False) -> np.ndarray:
        """The normal matrix of each row times that row of p; at the start what is missing from it to the right side."""
        out = p @ gram
        if start:
            out = -out
        for of, y, c, less in like:
            s = np.matmul(y, p[of][:, :, None])[:, :, 0] * less
            out[of] += np.matmul((c - s if start else s)[:, None, :], y)[:, 0, :]
        for h, m in hot:
            out[h] += m[rank] - p[h] @ m[:rank] if start else p[h] @ m[:rank]
        return out

    r = product(x, start=True)
    p, rs = r.copy(), np.einsum("ij,ij->i", r, r)
    for _ in range(steps):
        ap = product(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.nan_to_num(rs / np.einsum("ij,ij->i", p, ap), nan=0.0, posinf=0.0, neginf=0.0)
            a[rs < 1e-20] = 0
            x += a[:, None] * p
            r -= a[:, None] * ap
            new = np.einsum("ij,ij->i", r, r)
            p = r + np.nan_to_num(new / rs, nan=0.0, posinf=0.0)[:, None] * p
        rs = new
    return x


def _half(tiles: DataFrame, mine: str, other: str, own: DataFrame, factors: DataFrame, gram: np.ndarray, steps: int) -> DataFrame:
    """(block, ids, f, gram) of one side, solved for the factors of the other. ``gram``: theirs, with the regularisation."""
    rank = len(gram)

    def solve(parts: pa.Table) -> pa.Table:
        own = np.flatnonzero(parts["kind"].to_numpy() == 0)[0]
        return pa.Table.from_batches([_row(parts["block"][0].as_py(), np.frombuffer(parts["rows"][int(own)].as_buffer(), np.int64), _solve(parts, gram, steps))])

    none = F.lit(None).cast("binary")
    mine_now = own.select("block", F.lit(0).alias("kind"), F.col("raw_ids").alias("rows"), none.alias("at"), none.alias("weight"), "f")
    return mine_now.unionByName(_gathered(tiles, mine, other, factors, rank)).groupBy("block").applyInArrow(solve, _BLOCKS)


def _hot(pairs: DataFrame, column: str, most: int) -> DataFrame:
    return pairs.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(column, F.lit(True).alias(f"{column}_hot"))


def fit(pairs: DataFrame, write: Callable[[DataFrame], DataFrame], rank: int = 128, iterations: int = 20, reg: float = 0.01, seed: int = 42, steps: int = STEPS, hot: int = HOT, drop: Callable[[DataFrame], None] = lambda _: None, at_once: int = AT_ONCE) -> Factors:
    """Factors of ``pairs`` (user_id, item_id, confidence; each pair once, ids any longs).

    Minimises the squared error of all pairs, weighted by confidence where there is one (target 1)
    and by 1 elsewhere (target 0), with ``reg`` on the factors' squares. ``write`` writes a frame to
    shared storage and reads it back: so lineage ends with each half iteration. Pairs with a null
    are left out. A block is solved in one task's memory: about BLOCK rows or PAIRS pairs, with the factors
    that they meet, of which a row brings ``hot`` at most. What is shuffled for a slice of blocks (``at_once``
    pairs) goes when the slice is solved, and ``drop`` removes a frame that ``write`` gave and that is no longer
    read: so the disk holds one slice and the factors now, however many iterations there are.
    """
    pairs = write(pairs.select("user_id", "item_id", F.col("confidence").cast("double").alias("confidence")).dropna())
    size = pairs.agg(F.count_distinct("user_id").alias("user_id"), F.count_distinct("item_id").alias("item_id"), F.count(F.lit(1)).alias("pairs")).first()
    blocks = {c: max(1, -(-size[c] // BLOCK), -(-size["pairs"] // PAIRS)) for c in ("user_id", "item_id")}
    marked = pairs
    for c in blocks:
        rows = write(_hot(pairs, c, hot))
        marked = marked.withColumn(f"{c}_hot", F.lit(False)) if rows.isEmpty() else marked.join(rows, c, "left").fillna(False, [f"{c}_hot"])
    now = {c: write(_started(pairs.select(c).distinct(), c, n, rank, seed + k)) for k, (c, n) in enumerate(blocks.items())}
    tiles = write(_tiled(marked, blocks, now))
    slices, conf = max(1, -(-size["pairs"] // at_once)), pairs.sparkSession.conf
    kept, held = conf.get(_CLEANUP, None), {c: [f] for c, f in now.items()}
    conf.set(_CLEANUP, "true")
    try:
        for _ in range(iterations):
            for mine, other in (("user_id", "item_id"), ("item_id", "user_id")):
                gram = (_gram(now[other], rank) + reg * np.eye(rank)).astype(np.float32)
                of = lambda rows, column, k: rows if slices == 1 else rows.filter(F.col(column) % slices == k)
                new = [write(_half(of(tiles, f"{mine}_block", k), mine, other, of(now[mine], "block", k), now[other], gram, steps)) for k in range(slices)]
                for f in held[mine]:
                    drop(f)
                now[mine], held[mine] = reduce(DataFrame.unionByName, new), new
        drop(tiles)
        drop(pairs)
    finally:
        conf.set(_CLEANUP, kept) if kept is not None else conf.unset(_CLEANUP)
    return Factors(*[now[c].select("block", "ids", "f") for c in ("user_id", "item_id")], rank)


def factor_rows(blocks: DataFrame, rank: int) -> DataFrame:
    """(id, vector, length): a row for each of the ids in blocks of factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, f in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(f.as_buffer(), np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, rank), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([ids.values, vectors, pa.array(np.linalg.norm(x.reshape(-1, rank).astype(np.float64), axis=1))], names=["id", "vector", "length"])

    return blocks.select("ids", "f").mapInArrow(run, "id long, vector array<float>, length double")


_ASKED = "block int, ids array<long>, f binary, at binary, seen binary"


def _beside(users: DataFrame, watched: DataFrame) -> DataFrame:
    """Blocks of users with what these have watched: the places of users in the block (``at``) and the items (``seen``), by item."""
    of = watched.select("user_id", "item_id").distinct().join(users.select("block", F.explode("ids").alias("user_id")), "user_id")
    of = of.groupBy("block").agg(F.collect_list(F.struct("user_id", "item_id")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if batch["pairs"][k].is_valid:
                    pairs = batch["pairs"][k].values
                    pairs = pairs.filter(pairs.field("item_id").is_valid())
                    a, b = np.searchsorted(batch["ids"][k].values.to_numpy(), pairs.field("user_id").to_numpy()), pairs.field("item_id").to_numpy()
                order = np.argsort(b, kind="stable")
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (a[order].astype(np.int32), b[order])]
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(k, 1) for c in ("block", "ids", "f")], *raw], names=["block", "ids", "f", "at", "seen"])

    return users.join(of, "block", "left").select("block", "ids", "f", "pairs").mapInArrow(run, _ASKED)


#: Users whose scores of a block of items are looked at at a time.
ROWS = 64


def _in_tiles(tiles: DataFrame, rank: int, n: int) -> DataFrame:
    """(user_id, item_id, score): the ``n`` best of each user over tiles (block, ids, f, least, at, seen, rows, longest), where they may reach ``least``.

    A task keeps the best of a block of users over all blocks of items that it meets in a row, and sends them once;
    what the next block has to reach follows from them. Only scores that a bound lets through are rounded and ordered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, none = None, None, np.zeros(0, np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["user_id", "item_id", "score"])

        for batch in batches:
            for k in range(batch.num_rows):
                if batch["block"][k].as_py() != block:
                    if best is not None and len(best[0]):
                        yield sent()
                    block, best = batch["block"][k].as_py(), (none, none, np.zeros(0))
                    ids, x = batch["ids"][k].values.to_numpy(), np.frombuffer(batch["f"][k].as_buffer(), np.float32).reshape(-1, rank)
                    at, seen = np.frombuffer(batch["at"][k].as_buffer(), np.int32), np.frombuffer(batch["seen"][k].as_buffer(), np.int64)
                    least = batch["least"][k].values.to_numpy() if batch["least"][k].is_valid else np.full(len(ids), -np.inf)
                    reach, length = np.maximum(least, -1e300), np.linalg.norm(x, axis=1)
                able = np.flatnonzero(length * batch["longest"][k].as_py() * (1 + 1e-5) + 1e-6 >= reach)
                if not len(able):
                    continue
                rows = batch["rows"][k].values
                items = rows.field("item_id").to_numpy()
                order = np.argsort(items)
                items, v = items[order], rows.field("vector").flatten().to_numpy().reshape(-1, rank)[order]
                start = np.searchsorted(seen, items)
                times = np.searchsorted(seen, items, side="right") - start
                column = np.repeat(np.arange(len(items)), times)
                place = np.full(len(ids), -1)
                place[able] = np.arange(len(able))
                row = place[at[np.arange(len(column)) - np.repeat(np.cumsum(times) - times, times) + start[column]]]
                row, column = row[row >= 0], column[row >= 0]
                parts = [best]
                for i in range(0, len(able), ROWS):
                    mine = able[i : i + ROWS]
                    found = x[mine] @ v.T
                    gone = (row >= i) & (row < i + ROWS)
                    found[row[gone] - i, column[gone]] = -np.inf
                    r, c, score = _candidates(found, reach[mine], n, 6)
                    keep = score >= reach[mine][r]
                    parts.append((mine[r[keep]], items[c[keep]], score[keep]))
                best = _first_of_each(*(np.concatenate(p) for p in zip(*parts, strict=True)), n)
                full = np.bincount(best[0], minlength=len(ids)) >= n
                last = np.full(len(ids), np.inf)
                np.minimum.at(last, best[0], best[2])
                reach = np.where(full, np.maximum(reach, last), reach)
        if best is not None and len(best[0]):
            yield sent()

    return tiles.select("block", "ids", "f", "least", "at", "seen", "rows", "longest").mapInArrow(run, "user_id long, item_id long, score double")


def _with_least(users: DataFrame, found: DataFrame, n: int, rank: int) -> DataFrame:
    """Blocks of users with the score that a further item must reach (-inf while a user has fewer than ``n``), and the least length of factors that serves any of them."""
    last = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least")).filter(F.col("c") == n)
    of = last.join(users.select("block", F.explode("ids").alias("user_id")), "user_id").groupBy("block").agg(F.collect_list(F.struct("user_id", "least")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch["ids"][k].values.to_numpy()
                least = np.full(len(ids), -np.inf)
                if batch["known"][k].is_valid:
                    known = batch["known"][k].values
                    least[np.searchsorted(ids, known.field("user_id").to_numpy())] = known.field("least").to_numpy()
                length = np.linalg.norm(np.frombuffer(batch["f"][k].as_buffer(), np.float32).reshape(-1, rank), axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    needs = np.where(least <= 0, -np.inf, least / length).min()
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(k, 1) for c in ("block", "ids", "f", "at", "seen")], pa.array([least], pa.list_(pa.float64())), pa.array([needs])], names=["block", "ids", "f", "at", "seen", "least", "needs"])

    return users.join(of, "block", "left").select("block", "ids", "f", "at", "seen", "known").mapInArrow(run, f"{_ASKED}, least array<double>, needs double")


def recommend(factors: Factors, watched: DataFrame, n: int, write: Callable[[DataFrame], DataFrame], classes: int = CLASSES) -> DataFrame:
    """(user_id, item_id, score, rank): the ``n`` items of highest product for every user, without those that they have watched.

    Exact: blocks of users meet blocks of items as matrices. Items lie in classes by the length of
    their factors. All users meet the longest ones first; a block of the others is met only by
    blocks of users of whom it may still serve one, as no product exceeds the product of lengths. What
    has been watched lies beside its block of users and is left out there, so no list is fetched longer for it, and
    pairs of blocks meet where they are used and are never shuffled.
    """
    items = write(factor_rows(factors.items, factors.rank).select(F.col("id").alias("item_id"), "vector", "length"))
    edges = sorted(items.approxQuantile("length", [k / classes for k in range(1, classes)], 0.01), reverse=True) if classes > 1 else []
    kind = sum((F.when(F.col("length") < e, 1).otherwise(0) for e in edges), F.lit(0))
    parts = max(1, -(-items.count() // (BLOCK * classes)))
    packed = write(items.withColumn("kind", kind).groupBy("kind", _block_of("item_id", parts).alias("part")).agg(F.collect_list(F.struct("item_id", "vector")).alias("rows"), F.max("length").alias("longest")))
    users = write(_beside(factors.users, watched))
    asking = users.count()
    by_block = lambda rows: rows.repartition(max(1, asking), "block")
    held = lambda rows, blocks: rows.repartition(min(blocks, max(-(-blocks // HELD), -(-TASKS // max(1, asking)))), "kind", "part")
    first = by_block(users).crossJoin(held(packed.filter("kind = 0"), parts)).withColumn("least", F.lit(None).cast("array<double>"))
    order = [F.desc("score"), F.col("item_id")]
    found = write(top_per_group(_in_tiles(first, factors.rank, n), ["user_id"], order, n).drop("rank"))
    asked = write(_with_least(users, found, n, factors.rank))
    rest = by_block(asked).join(held(packed.filter("kind > 0"), parts * max(1, classes - 1)), F.col("longest") * (1 + 1e-5) + 1e-6 >= F.col("needs"))
    return top_per_group(found.unionByName(_in_tiles(rest, factors.rank, n)), ["user_id"], order, n)
