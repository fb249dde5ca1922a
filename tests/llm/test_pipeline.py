"""The pipeline against a plain version of its stages, and the SQL of the corpus queries."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import connect, differences

from reelspark.llm import registry, secrets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, small, name):
    assert not differences(registry.QUERIES[name](spark, small), connect(small), registry.ORACLES[name])


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = dict(before)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, small))
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= kept.keys()
        if name == "simhash":
            ids = sorted(kept)
            sets = {}
            for i in ids:
                w = kept[i].encode().lower().split()
                sets[i] = {tuple(w[k : k + corpus_pipeline.SHINGLE]) for k in range(max(1, len(w) - corpus_pipeline.SHINGLE + 1))} if w else set()
            root = {i: i for i in ids}
            for k, i in enumerate(ids):
                for j in ids[:k]:
                    a, b = sets[i], sets[j]
                    if root[i] != root[j] and len(a & b) >= corpus_pipeline.SIMILARITY * len(a | b):
                        old, new = max(root[i], root[j]), min(root[i], root[j])
                        root = {x: new if r == old else r for x, r in root.items()}
            firsts = {i for i, r in root.items() if r == i}
            assert firsts <= after.keys() and len(after.keys() - firsts) <= 0.02 * len(kept)
        if name == "decontamination":
            assert after.keys() <= {i for i, t in kept.items() if not any(b in t for b in bench)}
            assert len(after) >= 0.9 * len(kept)
        if name == "secrets":
            scanner = secrets.Scanner()
            assert after.keys() == kept.keys() and all(after[i] == kept[i] for i in kept if not scanner.spans(kept[i])) and not any(scanner.spans(t) for t in after.values())
        if name == "toxicity":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 1").collect()}
            assert len(kept.keys() - after.keys() - toxic) <= 0.1 * len(kept)
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == kept.keys()
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, small).count() == len(packed)


def test_rest_stands_alone():
    """Nothing outside the corpus folders imports them, but for the entry point."""
    root = Path(__file__).parents[2]
    for path in (root / "reelspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "reelspark.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_session_stays_as_it_was(spark, small):
    """Building and running corpus queries leaves no setting behind."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for name in ("op1_topk", "op6_toxicity", "op8_warc"):
        registry.QUERIES[name](spark, small).count()
        assert spark.conf.get(key) == before


def test_stages_of_odd_rows(spark, small):
    """Nulls in any column, empty and repeated rows, columns with clashing names, and no rows: no stage fails or changes a column."""
    from pyspark.sql import functions as F

    long = "lorem ipsum dolor sit amet " * 5000
    rows = [(1, "plain text of some words here", "en", "a", 29), (1, "plain text of some words here", "en", "a", 29), (None, "another text of some words", None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (5, long, "la", "b", len(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in ("_id", "_h", "_in", "__text", "__new", "fp", "spans", "piece", "toxicity", "component_id")})
    for frame, kept in ((docs, {1, None, 3, 5}), (docs.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, small)
            assert out.columns == docs.columns
            frame = corpus_pipeline.materialise(out)
            assert {r["_in"] for r in frame.collect()} <= {"mine"}
        assert {r["doc_id"] for r in frame.collect()} == kept and frame.count() == len(kept)
        assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, frame, small).collect()} == kept
