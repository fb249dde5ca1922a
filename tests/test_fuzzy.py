"""Fuzzy matches between catalogues against brute force over all pairs."""

import random

import pytest

from reelspark.operators import search
from reelspark.plans import views as V

LEFT, RIGHT = "item_id long, name string, type string", "match_id long, match_name string, match_type string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    return round(1 - distance(a, b) / max(len(a), len(b)), 6) if a or b else 1.0


def brute(left, right, least=0.3):
    best = {}
    for i, a, t in left:
        for m, b, u in right:
            if i is None or m is None or a is None or b is None or i == m:
                continue
            s = similarity(a, b)
            if s > least:
                best[i] = min(best.get(i, (2, 0, 0)), (t != u, -s, m))
    return sorted((i, v[2]) for i, v in best.items())


def matched(spark, left, right, least=0.3):
    return sorted(map(tuple, search.fuzzy_match(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), V.written, least).collect()))


def names(rnd, n, letters="abcdefghij가나다라마바사아", types=("film", "show", None)):
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14))) for _ in range(n // 3)]
    edited = []
    for _ in range(n - len(made)):
        w = list(rnd.choice(made))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(letters)
        edited.append("".join(w))
    return [(i, w, rnd.choice(types)) for i, w in enumerate(made + edited)]


@pytest.mark.parametrize("seed,least", [(1, 0.3), (2, 0.3), (3, 0.7)])
def test_equal_to_all_pairs(spark, seed, least):
    rnd = random.Random(seed)
    left, right = names(rnd, 150), names(rnd, 150)
    assert matched(spark, left, right, least) == brute(left, right, least)


def test_within_one_catalogue(spark):
    """Items don't match themselves; equal names, and a type of which there is one, do."""
    rnd = random.Random(5)
    rows = names(rnd, 120, "abcd") + [(500, "abcd", "lone"), (501, "abcd", "film"), (502, "abcd", "film"), (503, "abcd", None)]
    assert matched(spark, rows, rows) == brute(rows, rows)


def test_nulls_empty_names_and_tables(spark):
    rows = [(1, None, "film"), (2, "", "film"), (3, "", None), (None, "ab", "film"), (4, "ab", "film"), (4, "zz", "film"), (5, "zy", "show"), (6, "x" * 3000, None), (7, "x" * 2000 + "y" * 900, "show")]
    expected = brute([r for r in rows if r[0] not in (6, 7)], [r for r in rows if r[0] not in (6, 7)])
    assert matched(spark, rows, rows) == [*expected, (6, 7), (7, 6)]
    assert matched(spark, rows, []) == matched(spark, [], rows) == []


def test_pairs_far_below_the_square(spark, small):
    """Every third row of one type and one name, all names with a common part: few pairs are looked at."""
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) + rnd.choice(["", " season", " special"]), "film") for i in range(0, 2000, 2)]
    rows += [(i + 1, w[:5] + "#" + w[6:], "film") for i, w, _ in rows]  # each has one near name
    left = spark.createDataFrame([("", w, 1 - 1 / len(w)) for _, w, _ in rows], "k string, a string, bound double").distinct()
    pairs = search.similar_name_pairs(left, left.select("k", left.a.alias("b")), 0.3, V.written).count()
    assert 2000 <= pairs < 2000 * 2000 / 100
    hot = [(10_000 + i, "one name of a third of all", "film") for i in range(1000)]
    got = dict(matched(spark, rows + hot, rows + hot))
    assert all(got[i] == i + 1 and got[i + 1] == i for i, _, _ in rows[:1000]) and got[10_000] == 10_001 and got[10_500] == 10_000
