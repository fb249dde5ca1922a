"""Doubtful links between catalogues: each reason, their order, nulls."""

from reelspark.operators.catalogue import match_conflict

CLASSES = {"children": ["kids"], "shows": ["fun"], "television": ["kids", "fun", "drama"]}
CASES = [
    (("kids", None, 0.9, ["x"], "tv", "ko"), "missing"), (("kids", 1, 0.39, ["crime"], "tv", "ko"), "title"), (("kids", 1, None, [], "tv", "ko"), "title"),
    (("kids", 1, 0.4, ["x", "crime"], "movie", "en"), "genre"), (("fun", 1, 0.9, ["crime"], "tv", "ko"), "genre"), (("drama", 1, 0.9, ["crime"], "tv", "ko"), "ok"),
    (("kids", 1, 0.9, ["x"], "movie", "ko"), "kind"), (("kids", 1, 0.9, ["family"], "movie", "ko"), "ok"), (("kids", 1, 0.9, None, "movie", "ko"), "kind"), (("kids", 1, 0.9, [None], "tv", "ko"), "ok"),
    (("drama", 1, 0.69, [], "tv", "en"), "language"), (("drama", 1, 0.7, [], "tv", "en"), "ok"), (("drama", 1, 0.5, [], "tv", None), "language"), (("film", 1, 0.5, ["crime"], "movie", "en"), "ok"), ((None, 1, 0.5, [], None, None), "ok"),
]


def test_reasons(spark):
    rows = [(i, *case) for i, (case, _) in enumerate(CASES)]
    links = spark.createDataFrame(rows, "id int, ct_cl string, match_id long, similarity double, genres array<string>, kind string, match_language string")
    got = {r.id: r.v for r in links.select("id", match_conflict(CLASSES, ["crime"], ["family"], "ko").alias("v")).collect()}
    assert [got[i] for i in range(len(CASES))] == [v for _, v in CASES]
