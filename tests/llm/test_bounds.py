"""Work that has to stay in proportion to the input."""

import dataclasses
import math
import random
import time

from pyspark.sql import functions as F

from reelspark.llm import secrets, simhash, urls


def test_chain_of_false_candidates(spark, monkeypatch):
    """Texts of which each shares much, but too little, with the next ones: what is verified together doesn't grow with the chain."""
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400 * 24)]
    chain = [" ".join(words[24 * i : 24 * i + 160]) for i in range(400 - 7)]  # neighbours: (156 - 24) / (156 + 24) = 0.73
    copies = [c + " end" for c in chain[::50]]
    monkeypatch.setattr(simhash, "PART_ROWS", 8)
    seen, real = [], simhash._verify
    monkeypatch.setattr(simhash, "_verify", lambda members, *a: seen.append(members.groupBy("root").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()) or real(members, *a))
    docs = spark.createDataFrame(list(enumerate(chain + copies)), "doc_id long, text string")
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert of == {i: i for i in range(len(chain))} | {len(chain) + k: 50 * k for k in range(len(copies))}
    print(seen)
    assert seen[0]["all"] > 200 and seen[0]["most"] <= 20  # there is a chain, and it is cut up


def test_card_keywords_take_linear_time():
    """Keywords by the hundred thousand, with and without numbers; a search of no bounded reach finds the same."""
    scanner = secrets.Scanner()
    for text in ("card " * 200_000, "card 1234567890123" * 60_000, "card " + "1 " * 500_000):
        began = time.process_time()
        scanner.spans(text)
        assert time.process_time() - began < 4
    free = secrets.Scanner(tuple(dataclasses.replace(k, most=10**9) if k.after else k for k in secrets.KINDS))
    rnd = random.Random(3)
    parts = ["card ", "visa", "mastercard", "4111 1111 1111 1111", "4111111111111111", "1", "2 ", "3-", "x", "-", " ", "12345678901234567890", "5500-0000-0000-0004", "0" * 13, " " * 30, "y" * 60]
    found = 0
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        spans = scanner.spans(text)
        assert spans == free.spans(text)
        found += len(spans)
    assert found > 1000


def test_entropy_of_many_letters(spark):
    """32,000 different letters, and texts of few."""
    many = "".join(chr(0x4E00 + i) if i < 20_000 else chr(0x10000 + i) for i in range(32_000))
    rows = [(many, math.log2(32_000)), ("aabb", 1.0), ("a", 0.0), ("", 0.0), ("abca", 1.5)]
    frame = spark.createDataFrame(rows, "u string, want double").select("want", urls._entropy(F.col("u")).alias("got"))
    began = time.time()
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in frame.collect())
    assert time.time() - began < 20
