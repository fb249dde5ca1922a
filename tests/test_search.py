"""Search by posting lists against a look at every row."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import search, vectors

WORDS = ["Red", "blue", "무한", "도전", "런닝", "맨", "a", "Star", "starfish", "별", "ring", "RING", "이상한", "나라"]


def shelf(spark, n=150):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        series = None if i % 11 == 0 else " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 4)))
        rows.append((i, series, f"{series or 'lone ' + str(i)} {i % 13}회", f"P{i % 4}", rnd.choice(["drama", "예능"]), rnd.choice([None, "Kim, Lee"]), None if i % 5 == 0 else f"p{i}"))
    return spark.createDataFrame(rows, "item_id long, series_nm string, title string, provider string, genre string, director string, poster_url string")


def trigrams(text):
    out = set()
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        padded = f"  {word} "
        out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return out


def similarity(a, b):
    x, y = trigrams(a), trigrams(b)
    return round(len(x & y) / len(x | y), 6) if x | y else 0.0


def test_search_finds_what_a_scan_finds(spark):
    """1,000 queries of one letter and more, in either case, and by initial consonants: the same series in the same order."""
    index = search.search_index(shelf(spark)).cache()
    rows = index.collect()
    rnd = random.Random(5)
    queries = {"", "ㅁㅎ", "ㄹㄴㅁ", "ㅂ", "ㅇㅅㅎ ㄴ", "zzz", " ", "%", "r"}
    while len(queries) < 1000:
        text = rnd.choice(rows)["search_text"]
        at = rnd.randrange(len(text))
        queries.add(rnd.choice([str.upper, str.lower, str])(text[at : at + rnd.randrange(1, 9)]))
    got = {}
    found = search.search(index, search.postings(index), spark.createDataFrame([(q,) for q in queries] + [(None,)], "query string"), 8)
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["series"])
    initial = lambda q: any("ㄱ" <= c <= "ㅎ" for c in q) and all(c == " " or c.isascii() or "ㄱ" <= c <= "ㅎ" for c in q)
    for q in queries:
        if initial(q):
            want = sorted(r["series"] for r in rows if r["initials"].startswith(q))
        else:
            want = [s for _, s in sorted((-similarity(r["search_text"], q), r["series"]) for r in rows if q and q.lower() in r["search_text"].lower())]
        assert got.get(q, []) == want[:8], q
    assert len(got) > 900


def test_a_query_meets_few_texts(spark):
    """Under its rarest stretch a query meets hardly more texts than hold it."""
    index = spark.createDataFrame([(f"common words everywhere {i}", f"common words everywhere {i}", "") for i in range(500)], "series string, search_text string, initials string").withColumn("item_id", F.lit(1))
    queries = spark.createDataFrame([(f"where {i}",) for i in range(100, 200)], "query string")
    posted = search.postings(index)
    sizes = {r["gram"]: r["n"] for r in posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    met = sum(min(sizes[q[k : k + 3]] for k in range(len(q) - 2)) for q in (r["query"] for r in queries.collect()))
    assert met < 2000 and search.search(index, posted, queries, 5).count() == 100


@pytest.mark.parametrize("query, titles", [("무한 도전 3회", None), ("no such series 3", []), ("Red", None)])
def test_episodes_of_one_query(spark, query, titles):
    items = shelf(spark)
    index = search.search_index(items)
    got = search.search_episodes(index, search.postings(index), items, spark.createDataFrame([(query,)], "query string"), ("P2", "P1"), 8).collect()
    if titles is not None:
        assert got == titles
    assert all((r["title"] is None) == (query == "Red") or "3회" not in (r["title"] or "3회") for r in got) or all(r["title"] is None for r in got)


def test_episodes_by_provider(spark):
    """The episode of the first provider in order stands for those of equal title; without one the series are the answer; ``07`` is 7."""
    rows = [(1, "Show", "Show 7회", "P1"), (2, "Show", "Show 7회", "P2"), (3, "Show", "Show 7회", "P9"), (4, "Show", "Show 17회", "P9"), (5, "Show", "Show 8화", "P1"), (6, "Other Show", "Other Show 7회", "P1"), (7, "None", "None", "P1")]
    items = spark.createDataFrame(rows, "item_id long, series_nm string, title string, provider string").withColumns({"genre": F.lit("g"), "director": F.lit(None).cast("string"), "poster_url": F.lit("p")})
    index = search.search_index(items)
    queries = spark.createDataFrame([("show 07회",), ("Show 8 화",), ("show 9",), ("None 1",), ("7",)], "query string")
    got = {}
    for r in search.search_episodes(index, search.postings(index), items, queries, ("P2", "P1")).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["series"], r["title"], r["item_id"]))
    assert got == {
        "show 07회": [("Other Show", "Other Show 7회", 6), ("Show", "Show 17회", 4), ("Show", "Show 7회", 2)], "Show 8 화": [("Show", "Show 8화", 5)],
        "show 9": [("Show", None, 1), ("Other Show", None, 6)], "None 1": [("None", None, 7)],
    }


def test_nearest_within_classes_of_all_sizes(spark):
    """A class of many blocks beside classes of one row: each row's nearest within its own class."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist(), "big" if i < 200 else f"c{i % 60}") for i in range(320)]
    v = spark.createDataFrame(rows, "item_id long, vector array<double>, kind string")
    got = {r["query_id"]: r["item_id"] for r in vectors.nearest(v.withColumnRenamed("item_id", "query_id"), v, 1, block=16, by="kind").collect()}
    unit = {i: (np.array(x) / np.linalg.norm(x), k) for i, x, k in rows}
    for i, (x, k) in unit.items():
        best = max(((round(float(x @ y), 6), -j) for j, (y, of) in unit.items() if of == k and j != i), default=None)
        assert got.get(i) == (-best[1] if best else None)
