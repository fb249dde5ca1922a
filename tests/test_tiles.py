"""Neighbours by blocks against brute force: ties, copies, several blocks; few scores are ordered, and few rows leave a task."""

import numpy as np

from reelspark.operators import factors, vectors


def wanted(v, n, digits=6):
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(unit @ unit.T, digits)
    return {(i, int(j), r + 1) for i in range(len(v)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(v)), -s[i])) if j != i][:n])}


def frame(spark, v, key):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"{key} long, vector array<double>")


def test_neighbours_of_several_blocks_with_copies(spark):
    v = np.random.default_rng(3).standard_normal((400, 8))
    v[200:] = v[:200]
    v[:30] = v[0]
    for block in (97, 2048):
        got = vectors.nearest(frame(spark, v, "query_id"), frame(spark, v, "item_id"), 3, block=block).collect()
        assert {(r.query_id, r.item_id, r["rank"]) for r in got} == wanted(v, 3)


def test_few_scores_are_ordered():
    s = np.random.default_rng(4).standard_normal((50, 2048))
    least = np.full(50, -9.0)
    row, column, score = vectors._candidates(s, least, 5, 6)
    assert len(row) < 50 * 20
    got = vectors._first_of_each(row, column, score, 5)
    assert (got[1].reshape(50, 5) == vectors.partial_top(np.round(s, 6), 5)).all()
    least[:] = 9.0
    assert not len(vectors._candidates(s, least, 5, 6)[0])
    equal = vectors._candidates(np.zeros((50, 2048)), np.full(50, -9.0), 5, 6)
    assert len(equal[0]) == 250 and set(equal[1].tolist()) == set(range(5))


def test_best_of_all_blocks_leave_a_task_once(spark):
    v = np.random.default_rng(5).standard_normal((300, 8))
    tiles = vectors._crossed(frame(spark, v, "query_id"), "query_id", frame(spark, v, "item_id"), "item_id", 30).coalesce(1)
    sent = []
    top, vectors.top_per_group = vectors.top_per_group, lambda rows, *_: sent.append(rows) or rows
    try:
        vectors._best_in_tiles(tiles, ["query_id", "item_id"], lambda q, c: q[0] @ c[0].T, 3, -2.0, 6)
    finally:
        vectors.top_per_group = top
    assert sent[0].count() == 900


def test_lists_of_a_vector_without_length(spark):
    v = np.random.default_rng(6).standard_normal((40, 4))
    v[7] = 0
    f = frame(spark, v, "item_id")
    index, model = factors.inverted_lists(f, 2)
    got = factors.probe(index, model, f.filter("item_id = 7").withColumnRenamed("item_id", "query_id"), 3, 2).collect()
    assert [(r.query_id, r.item_id, r.score) for r in got] == [(7, 0, 0.0), (7, 1, 0.0), (7, 2, 0.0)]


def test_lists_are_met_as_blocks(spark):
    v = np.random.default_rng(7).standard_normal((60, 4))
    f = frame(spark, v, "item_id")
    index, model = factors.inverted_lists(f, 2)
    found = factors.probe(index, model, f.withColumnRenamed("item_id", "query_id"), 3, 2)
    assert {(r.query_id, r.item_id, r["rank"]) for r in found.collect()} == wanted(v, 3)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
