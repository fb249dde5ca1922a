"""Users' vectors and the items nearest to them, against brute force, with several blocks of each side."""

import numpy as np
import pytest

from reelspark.operators import vectors


def tables(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 4))
    watched = [(int(u), int(i), float(c)) for u, i, c in zip(rng.integers(0, 50, 600), rng.integers(0, 80, 600), rng.integers(0, 4, 600) / 3, strict=True)]  # items from 60 on have no vector
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vector array<double>")
    return v, watched, spark.createDataFrame(watched, "user_id long, item_id long, completion double"), items


def means(v, watched):
    out = {}
    for u, i, c in watched:
        if c > 0 and i < len(v):
            total, items = out.setdefault(u, (np.zeros(v.shape[1]), set()))
            total += c * v[i]
            items.add(i)
    return {u: (t / np.linalg.norm(t), len(items)) for u, (t, items) in out.items()}


@pytest.mark.parametrize("sizes", [(100_000, 16_384, 64), (70, 16, 64), (70, 8, 2)])
def test_user_vectors_of_several_blocks(spark, monkeypatch, sizes):
    for name, n in zip(("VIEWS", "HELD_ROWS", "HELD"), sizes, strict=True):
        monkeypatch.setattr(vectors, name, n)
    monkeypatch.setattr(vectors, "PART", 7)
    v, watched, views, items = tables(spark)
    got = {r.user_id: (np.array(r.vector), r["items"]) for r in vectors.user_vectors(views, items, "vector").collect()}
    want = means(v, watched)
    assert got.keys() == want.keys()
    assert all(got[u][1] == n and np.allclose(got[u][0], x) for u, (x, n) in want.items())


def test_views_become_no_rows_of_components(spark):
    _, _, views, items = tables(spark)
    assert "posexplode" not in vectors.user_vectors(views, items, "vector")._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [9, 2048])
def test_products_of_blocks_are_not_shuffled(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    v, watched, views, items = tables(spark)
    users = vectors.user_vectors(views, items, "vector").select("user_id", "vector")
    found = vectors.user_neighbours(users, items, views, 3, 5)
    below = found._jdf.queryExecution().sparkPlan().toString().split("CartesianProduct")
    assert len(below) > 1 and "Join" not in below[0]
    gone, unit = {(u, i) for u, i, _ in watched}, v / np.linalg.norm(v, axis=1)[:, None]
    want = set()
    for u, (x, _) in means(v, watched).items():
        s = np.round(unit @ x, 5)
        order = [i for i in np.lexsort((np.arange(60), -s)) if s[i] > 0 and (u, i) not in gone][:3]
        want |= {(u, int(i), r + 1) for r, i in enumerate(order)}
    assert {(r.user_id, r.item_id, r["rank"]) for r in found.collect()} == want
