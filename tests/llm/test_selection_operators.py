"""Resampling, manifests and line dedup against brute force, and on the cases that break things."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import lines, manifest, resampling
from reelspark.llm.common import in_order, materialise

LONG = "Lorem ipsum dolor\n" * 20_000
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 57), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "la", "a", len(LONG)), (5, "one two", "en", "b", 50), (5, "one two", "en", "b", 50),
    (None, "Ärger ÉTÉ x1-y2 " * 12, None, "b", 1), (7, "İstanbul K token: 'zzzzzz' é—… " * 9, "tr", "b", 3), (2**60 + 1, " \t\n\x0b ", "xx", "c", 5), (8, "w" * 5000 + " " + "é" * 300, "en", None, 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["rank", "score", "weight", "_id", "_h", "_r", "_at", "_part", "own", "node", "g", "n", "siblings", "leaf", "root", "n_lines", "n_dropped", "_in", "lines", "digest", "chunk", "__text", "text_hash", "_lines", "_n"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({c: F.lit("mine") for c in CLASHES})


# ---- places in an order ----


def test_in_order(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(100), i) for i in range(2000)]
    got = in_order(spark.createDataFrame(rows, "g string, k long, i long").repartition(7), F.col("g").asc_nulls_first(), F.col("k").asc(), F.col("i").asc()).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert [(r["g"], r["k"], r["i"]) for r in sorted(got, key=lambda r: r["_at"])] == want and {r["_at"] for r in got} == set(range(2000))
    assert in_order(spark.range(0), F.col("id").asc()).count() == 0


# ---- 11: resampling ----


def runs_of(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(docs, bench, percent=5):
    corpus, target = Counter(), Counter()
    for _, t in docs:
        corpus.update(runs_of(t)[1])
    for t in bench:
        target.update(runs_of(t)[1])
    s_all, t_all = sum(corpus.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))
    rows, able = [], []
    for k, (i, t) in enumerate(docs):
        words, runs = runs_of(t)
        weight = sum(map(gain, runs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            able.append((-rows[-1][3], i is None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        rows[k][4] = rank
    return sorted(map(tuple, rows), key=repr)


def texts_of(rnd, n):
    word = lambda: rnd.choice(["Ab", "c1", "é", "zz", "Q", "über", "x" * rnd.choice([1, 70, 300])])
    return [" ".join(word() + rnd.choice(["", ",", "\n", " - "]) for _ in range(rnd.choice([0, 1, 2, 19, 20, 21, 60]))) for _ in range(n)]


def test_resampling_brute_force(spark):
    rnd = random.Random(11)
    docs = list(enumerate(texts_of(rnd, 600))) + [(None, "a b c d e f g h i j k l m n o p q r s t u v"), (9000, None), (9001, "")]
    bench = texts_of(rnd, 20) + [None]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in bench], "text string"), percent=30)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute_resample(docs, bench, 30)


def test_resampling_in_parts(monkeypatch):
    """Texts that are hashed in many parts give the runs of whole texts."""
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(resampling, "BYTES_AT_ONCE", 5)
    rnd = random.Random(1)
    for n in range(60):
        texts = texts_of(rnd, rnd.randrange(1, 6))
        found = [Counter() for _ in texts]
        for buckets, of, _ in resampling.word_runs(texts, resampling.RunHasher()):
            for b, i in zip(buckets.tolist(), of.tolist(), strict=True):
                found[i][b] += 1
        assert found == [Counter(runs_of(t)[1]) for t in texts]


def test_resampling_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([("the quick brown",)], "text string")
    got = resampling.resample(odd, bench, percent=50)
    assert got.count() == len(DOCS)
    want = brute_resample([d[:2] for d in DOCS], ["the quick brown"], 50)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == want
    drawn = resampling.drawn_documents(odd, got)
    assert drawn.columns == odd.columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in want if r[4]}
    assert resampling.resample(odd.limit(0), bench).count() == 0
    assert resampling.resample(odd, bench.limit(0)).filter("rank IS NOT NULL").count() == 0  # 5 % of four, rounded down


def test_resampling_of_a_hot_row(spark):
    """A third of the rows alike, id and all: as many are drawn as should be, with ranks of their own."""
    frame = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c d e " * 5).alias("text"))
    for percent in (1, 20, 50, 100):
        ranks = sorted(r["rank"] for r in resampling.resample(frame, frame.limit(1), percent=percent).filter("rank IS NOT NULL").collect())
        assert ranks == list(range(1, 9 * percent + 1))


@pytest.mark.parametrize("n, spread", [(1, 1), (40, 3), (3000, 10**9), (300, 4), (300, 1)])
def test_kth_key(spark, n, spread):
    rnd = random.Random(n + spread)
    rows = [(rnd.randrange(spread), rnd.choice([None, *range(min(spread, 50))])) for _ in range(n)]
    frame = materialise(spark.createDataFrame(rows, "a long, b long").repartition(4))
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    for k in {1, n // 7 + 1, n // 2 + 1, n}:
        assert resampling.kth_key(frame, ["a", "b"], k, n, pivots=16) == order[k - 1]
    assert resampling.kth_key(frame, ["a", "b"], 0, n) is None and resampling.kth_key(frame, ["a", "b"], n + 1, n) is None


# ---- 12: manifests ----


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def climb(nodes):
    """(the last node, for each node the siblings on each level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], paths


def brute_manifest(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = [(d[0], d[2], sha("".join(map(field, (d[0], d[3], d[2], d[4], d[1]))))) for d in docs]
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    tops, found = [], []
    for g in groups:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        top, paths = climb([r[2] for r in mine])
        tops.append(top)
        found.append([(*r, p, top) for r, p in zip(mine, paths, strict=True)])
    root, above = climb(tops)
    return sorted(((i, g, leaf, tuple(p + above[k]), top, root) for k, of in enumerate(found) for i, g, leaf, p, top in of), key=repr)


def as_rows(frame):
    return sorted(((r["doc_id"], r["lang"], r["leaf"], tuple((s["left"], s["right"]) for s in r["siblings"]), r["subroot"], r["root"]) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [64, 65], [513, 1], [4097, 3, 512], [2] * 9, [1] * 600])
def test_manifest_brute_force(spark, sizes):
    rnd = random.Random(sum(sizes))
    docs = [(1000 * k + i, f"text {i}", None if k == 1 else f"l{rnd.random()}{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    name = {k: docs[sum(sizes[:k])][2] for k in range(len(sizes))}
    docs = [(i, t, name[i // 1000] if len(sizes) != 3 else ("a" if i < 1000 or i // 1000 < 5 and sizes[0] > 4000 and i < 4097 else "é"), s, n) for i, t, _, s, n in docs]
    rnd.shuffle(docs)
    assert as_rows(manifest.manifest(spark.createDataFrame(docs, SCHEMA).repartition(6))) == brute_manifest(docs)


def test_manifest_of_odd_rows(spark, odd):
    assert as_rows(manifest.manifest(odd)) == brute_manifest(DOCS)
    assert manifest.manifest(odd.limit(0)).count() == 0


def test_manifest_verifies(spark, odd):
    """A row leads to the root with its own leaf, and not with another one."""
    rows = manifest.manifest(odd, carried={"own": manifest.digest_of([F.col(c) for c in manifest.FIELDS]), "other": F.sha2(F.lit("x").cast("binary"), 256)})
    assert all(r["verified"] for r in manifest.verified(rows, "own").collect())
    assert not any(r["verified"] for r in manifest.verified(rows, "other").collect())


# ---- 13: lines ----


def brute_lines(docs, least_chars=40, least_documents=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    out = []
    for i, t in docs:
        split = (t or "").split("\n")
        kept = []
        for x in split:
            of = held[key(x)]
            last = max((j for j in of if j is not None), default=None)
            if len(key(x)) < least_chars or len(of) < least_documents or last is None or i == last:
                kept.append(x)
        out.append((i, len(split), len(split) - len(kept), t if len(kept) == len(split) else "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_brute_force(spark):
    rnd = random.Random(13)
    pool = ["a" * 39, "b" * 40, "é" * 39, "é" * 40, " \tSome Line That is Repeated over and over again\r", "some line that is repeated OVER and over again", "", "x", "İ" * 40, "\xa0" + "n" * 39, "K" * 45, "line of its own kind, number one, in all texts", "c" * 3000]
    docs = [(i, "\n".join(rnd.choice([*pool, f"a line that stands in one document only, number {rnd.random()}"]) for _ in range(rnd.randrange(12)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "\n"), (None, "b" * 40), (None, "d" * 50), *[(None, "e" * 50)] * 6]
    got = lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr) == brute_lines(docs)


def test_lines_of_odd_rows(spark, odd):
    hot = DOCS + [(i, f"The Same Line in a third of all rows, or even more of them\nown {i}", "en", "a", 1) for i in range(100, 400)]
    frame = spark.createDataFrame(hot, SCHEMA).withColumns({c: F.lit("mine") for c in CLASHES})
    got = lines.drop_repeated_lines(frame)
    assert got.columns == [c for c in frame.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    rows = got.collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows), key=repr) == brute_lines([d[:2] for d in hot]) and {r["_in"] for r in rows} == {"mine"}
    assert lines.drop_repeated_lines(odd.limit(0)).count() == 0


def test_line_filters_miss_nothing(spark, monkeypatch):
    """Merged filters hold every hash that was added twice, however full they are, and few others while they are not."""
    rnd = np.random.default_rng(3)
    for bits in (1 << 16, 1 << 10):
        parts, counts = [], Counter()
        for _ in range(6):
            filters = lines.Filters(bits)
            for _ in range(3):
                some = rnd.integers(0, 2**63, 100, np.uint64)
                some[:30] = rnd.integers(0, 40, 30).astype(np.uint64)
                filters.add(some)
                counts.update(some.tolist())
            parts.append(filters)
        once, twice = parts[0].once.copy(), parts[0].twice.copy()
        for p in parts[1:]:
            twice |= p.twice | (once & p.once)
            once |= p.once
        held = {h: bool(f) for h, f in zip(counts, lines.holds(twice, np.array(list(counts), np.uint64)), strict=True)}
        assert all(held[h] for h, n in counts.items() if n > 1)
        if bits == 1 << 16:
            assert sum(held[h] for h, n in counts.items() if n == 1) < 10


def test_lines_with_a_full_filter(spark, monkeypatch):
    """A filter that is far too small makes every line a suspect, and changes no result."""
    monkeypatch.setattr(lines, "BITS_LEAST", 64)
    monkeypatch.setattr(lines, "BITS_MOST", 64)
    docs = [(i, "\n".join(f"line number {j} of some that are shared by many texts" for j in range(i % 9))) for i in range(120)]
    got = lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr) == brute_lines(docs)
