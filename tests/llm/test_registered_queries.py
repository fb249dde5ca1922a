"""The registered queries themselves, columns and digests as their contracts name them, against brute force over a whole small table."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import pytest
from test_corpus_operators import brute_groups, brute_secrets

from reelspark.llm import registry

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def run(spark, small, name, *first):
    frame = registry.QUERIES[name](spark, small)
    assert frame.columns[: len(first)] == list(first)
    return frame.collect()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op2(spark, small):
    """Host, path and rule of every address, and a verdict that is the rule's where there is one."""
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = run(spark, small, "op2_urls", "page_id", "host", "path", "rule", "verdict")
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        rest = (urls[r["page_id"]] or "").partition("://")
        host, path = re.match("([^/?#]*)([^?#]*)", rest[2], re.S).groups() if rest[1] else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (low(host) == h or low(host).endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (low(host), path)
        assert r["rule"] == (max(fits)[1] if fits else None) and r["verdict"] in ([max(fits)[2]] if fits else ["allow", "block"])


def test_op3(spark, small, texts):
    """Every document that holds an item as it is comes out with it at distance 0, and no row goes beyond its budget."""
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    rows = run(spark, small, "op3_decontamination", "doc_id", "item_id", "distance", "place", "places")
    held = {(d, i) for d, t in texts.items() for i, b in bench.items() if b and b in (t or "")}
    assert held and held <= {(r["doc_id"], r["item_id"]) for r in rows if r["distance"] == 0}
    assert all(0 <= r["distance"] <= 0.1 * len(bench[r["item_id"]]) and r["places"] >= 1 for r in rows)
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})


def test_op4(spark, small, texts):
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    rows = run(spark, small, "op4_licenses", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        words = WORD.findall(low(texts[r["doc_id"]]))
        places = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        base = sorted({label for _, label in places})
        labels = r["labels"].split(",") if r["labels"] else []
        assert r["base_labels"] == ",".join(base) and set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r["score"] <= 1


def test_op5(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = run(spark, small, "op5_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    total = 0
    for doc, of in pieces.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(of, key=lambda r: r["piece"])):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"], len(part)) == (k, at, r["length"]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += len(part)
        assert at == len(ids) and (len(ids) > 2048 or len(of) == 1) and all(r["length"] == 2048 for r in of if r["piece"] > 0)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 2


def test_op7(spark, small, texts):
    ids = sorted(texts)
    prints, roots = brute_groups([texts[i] for i in ids], 4, 4)
    rows = run(spark, small, "op7_simhash", "doc_id", "fingerprint", "component_id")
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots, strict=True)} and len(rows) == len(ids)


def test_op9(spark, small, texts):
    rows = run(spark, small, "op9_sharding", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all({r["slot"] for r in rows if r["shard"] == s} == set(range(n)) for s, n in counts.items())


def test_op10(spark, small, texts):
    rows = run(spark, small, "op10_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        base = brute_secrets(texts[r["doc_id"]] or "")
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds[k] for k in ("assign", "access", "hex")) and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(filter(None, base.split(","))) <= set(spans) and [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op6(spark, small, texts):
    """A row for each document; the held-out fifth as its rule says; a score does not depend on what else is in the row."""
    rows = run(spark, small, "op6_toxicity", "doc_id", "held_out", "score", "predicted")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["score"])
    assert all(len(scores) == 1 for scores in by_text.values())
