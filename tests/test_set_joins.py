"""De-duplication by two keys and nearest sets against brute force, with hot keys."""

import random
import time

import pytest

from reelspark.operators import joins, ranking
from reelspark.plans import views as V

CANDIDATE = "user_id long, item_id long, score double, type string, source_id long"


def fold(rows):
    """The plain greedy pass over each user's rows by falling score."""
    out, items, sources = [], set(), set()
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for u, i, x, t, s in sorted(rows, key=lambda r: (r[0], -r[2], r[3], none_first(r[1]), none_first(r[4]))):
        limited = t == "VS" and s is not None
        if (i is None or (u, i) not in items) and not (limited and (u, s) in sources):
            out.append((u, i, x, t, s))
            items.add((u, i))
            if limited:
                sources.add((u, s))
    return sorted(out, key=repr)


def taken(spark, rows, **more):
    return sorted(map(tuple, ranking.greedy_distinct(spark.createDataFrame(rows, CANDIDATE).repartition(5), ("VS",), V.written, **more).collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 24])
def test_greedy_distinct_is_the_fold(spark, rounds):
    rnd = random.Random(2)
    rows = [(rnd.randrange(4), rnd.choice([None, *range(12)]), rnd.randrange(8) / 8, rnd.choice(["VS", "CF"]), rnd.choice([None, *range(6)])) for _ in range(600)]
    assert taken(spark, rows, rounds=rounds) == fold(rows)
    assert taken(spark, rows[:0], rounds=rounds) == []


def test_greedy_distinct_of_a_chain(spark):
    """Each row clashes with the next one only: more links than rounds."""
    rows = [(1, k // 2, 1 - k / 1000, "VS", (k + 1) // 2) for k in range(200)]
    assert taken(spark, rows, rounds=3) == fold(rows) and len(fold(rows)) == 100


def test_greedy_distinct_of_one_long_list(spark):
    """A user of 100,000 candidates, half of them of one source."""
    rnd = random.Random(3)
    rows = [(1, rnd.randrange(60_000), rnd.random(), rnd.choice(["VS", "CF"]), rnd.choice([0, rnd.randrange(20_000)])) for _ in range(100_000)]
    began = time.time()
    assert taken(spark, rows) == fold(rows)
    assert time.time() - began < 120


def test_greedy_distinct_writes_each_row_about_once(spark):
    """Few clashes: rows are marked once, and written again only where they have a source of their own."""
    written = []
    rnd = random.Random(4)
    rows = [(rnd.randrange(60), rnd.randrange(4000), rnd.random(), *rnd.choice([("VS", rnd.randrange(4)), ("CF", None), ("CF", 1)])) for _ in range(3000)]

    def write(df):
        out = V.written(df)
        written.append(out.count())
        return out

    got = ranking.greedy_distinct(spark.createDataFrame(rows, CANDIDATE), ("VS",), write)
    assert sorted(map(tuple, got.collect()), key=repr) == fold(rows)
    assert sum(written) < 1.3 * len(rows), written


@pytest.mark.parametrize("rounds", [1, 2, 24])
@pytest.mark.parametrize("seed", range(3))
def test_greedy_distinct_of_equal_and_null_rows(spark, rounds, seed):
    """Few users, items, sources and scores, so rows clash in every way and many are equal; either type may lack a source or an item."""
    rnd = random.Random(seed)
    rows = [(rnd.randrange(40), rnd.choice([None, *range(5)]), rnd.randrange(3) / 2, rnd.choice(["VS", "CF", "AB"]), rnd.choice([None, *range(4)])) for _ in range(1200)]
    assert taken(spark, rows, rounds=rounds) == fold(rows)


def nearest(sets):
    out = []
    for a, x in sets.items():
        best = max(((len(x & y) / len(x | y), -b) for b, y in sets.items() if b != a and x & y), default=None)
        if best:
            out.append((a, -best[1], round(best[0], 9)))
    return sorted(out)


@pytest.mark.parametrize("case", ["few", "many", "hot", "only hot", "one", "equal"])
def test_most_similar_set(spark, case):
    rnd = random.Random(case)
    sets = {
        "few": {a: {rnd.randrange(30) for _ in range(rnd.randrange(1, 6))} for a in range(80)},
        "many": {a: {rnd.randrange(300) for _ in range(rnd.randrange(1, 60))} for a in range(150)},
        "hot": {a: {0, 1, *(rnd.randrange(2, 400) for _ in range(rnd.randrange(12)))} for a in range(200)},
        "only hot": {a: {0, *range(1000 * a, 1000 * a + rnd.randrange(1, 5))} for a in range(1, 120)},
        "one": {1: {5, 6}},
        "equal": {a: {1, 2, 3} for a in range(40)} | {99: {1, 4}},
    }[case]
    rows = [(a, m) for a, x in sets.items() for m in x] * 2 + [(None, 1), (1, None)]
    got = joins.most_similar_set(spark.createDataFrame(rows, "a long, m long").repartition(3), "a", "m", V.written)
    assert sorted((r["a"], r["nearest"], round(r["jaccard"], 9)) for r in got.collect()) == nearest(sets)


def test_owners_do_not_meet_over_what_all_have(spark, monkeypatch):
    """With one member that all 2,000 owners have, the pairs that are counted to the end stay near the owners' number."""
    written = []
    rnd = random.Random(7)
    rows = [(a, m) for a in range(2000) for m in {0, *(rnd.randrange(1, 3000) for _ in range(8))}]

    def write(df):
        out = V.written(df)
        written.append(out.count())
        return out

    got = joins.most_similar_set(spark.createDataFrame(rows, "a long, m long"), "a", "m", write).collect()
    print(written)
    assert len(got) == 2000 and max(written) < 10 * len(rows)  # 4,000,000 pairs share the common one


def test_pairs_that_share_one_member_are_not_written(spark):
    """Owners who share a single member are some 140 for each owner here; the few pairs that share two are written."""
    written = []
    rnd = random.Random(8)
    rows = [(a, m) for a in range(3000) for m in rnd.sample(range(2000), 10)]

    def write(df):
        out = V.written(df)
        written.append(out.count())
        return out

    got = joins.most_similar_set(spark.createDataFrame(rows, "a long, m long"), "a", "m", write).collect()
    assert len(got) == 3000 and max(written) < len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_most_similar_set_leaves_out_several_ways(spark, monkeypatch, seed):
    """Owners who leave out common members, or none, or nearly all, beside each other; lists of three owners."""
    monkeypatch.setattr(joins, "LIST_OWNERS", 3)
    monkeypatch.setattr(joins, "TASK_PAIRS", 2000)
    rnd = random.Random(seed)
    sets = {a: {m for m in range(3) if rnd.random() < 0.8} | {rnd.randrange(3, 60 if a % 2 else 600) for _ in range(rnd.choice([0, 1, 3, 9]))} | ({*range(1000, 1020)} if a % 7 == 0 else set()) for a in range(160)}
    sets = {a: s for a, s in sets.items() if s}
    rows = [(a, m) for a, x in sets.items() for m in x]
    got = joins.most_similar_set(spark.createDataFrame(rows, "a long, m long"), "a", "m", V.written)
    assert sorted((r["a"], r["nearest"], round(r["jaccard"], 9)) for r in got.collect()) == nearest(sets)
