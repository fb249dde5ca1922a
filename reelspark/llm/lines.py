"""Line dedup with two Bloom filters.

One filter holds the hashes of lines seen once, the other those seen twice. Each task fills its own
pair; pairs are merged by chunks of their bits: what either has seen once is seen once, and what both
have seen once is seen twice. A line that the second filter does not hold stands in one document only.
All others are suspects, and they alone move: grouped by their digest, with exact counts of documents
and the document that keeps the line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import fold_texts, map_texts, materialise, maybe_listed, nonnull_text, read_table

#: Code points of a line that counts, and documents that it must be found in.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
#: Bits of a filter for each line, at least and at most (32 MB), and those set for a line. Beyond the most, more lines are suspects, and results stay exact.
BITS_A_LINE, BITS_LEAST, BITS_MOST, HASHES = 16, 1 << 16, 1 << 28, 4
#: Bytes of a filter that travel as one row.
CHUNK = 1 << 16
#: Hashes that are put into a filter at once.
AT_ONCE = 1 << 18

_SPACE = b" \t\n\x0b\x0c\r"


def keys_of(text: str, least_chars: int) -> dict[bytes, list[int]]:
    """The keys of a text's lines (ASCII white space stripped, A-Z lower-cased) of so many code points at least, and the lines that have them."""
    out: dict[bytes, list[int]] = {}
    for n, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(_SPACE).lower()
        if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
            out.setdefault(key, []).append(n)
    return out


class Filters:
    """Once-seen and twice-seen Bloom filters of 64-bit hashes; ``bits`` is a power of two."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        hashes, n = np.unique(hashes, return_counts=True)
        held = holds(self.once, hashes)
        _set(self.twice, hashes[held | (n > 1)])
        _set(self.once, hashes)

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for at in range(0, len(self.once), CHUNK):
            if self.once[at : at + CHUNK].any():
                yield at // CHUNK, self.once[at : at + CHUNK].tobytes(), self.twice[at : at + CHUNK].tobytes()


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    a, b = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return np.concatenate([(a + np.uint64(k) * b) & np.uint64(bits - 1) for k in range(HASHES)])


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> None:
    at = _places(hashes, 8 * len(bitmap))
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash; false only where it does not."""
    at = _places(hashes, 8 * len(bitmap))
    found = bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return found.reshape(HASHES, -1).all(axis=0)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _filled(documents: DataFrame, bits: int, least_chars: int) -> DataFrame:
    """(chunk, once, twice): the filters of each task, in chunks."""

    def make():
        filters, held = Filters(bits), []

        def put() -> None:
            filters.add(np.concatenate(held))
            held.clear()

        def add(texts: list[str]) -> None:
            for text in texts:  # a line that a document repeats is seen once
                if keys := list(keys_of(text, least_chars)):
                    held.append(_hashes(keys))
            if sum(map(len, held)) >= AT_ONCE:
                put()

        def gathered() -> Iterator[list[list]]:
            if held:
                put()
            for chunk, once, twice in filters.chunks():
                yield [[chunk], [once], [twice]]

        return add, gathered

    return fold_texts(documents, T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())]), make)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's twice-seen bits, of all tasks together."""
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for chunk, once, twice in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            o, t = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
            if chunk in seen:
                of, tf = seen[chunk]
                tf |= t | (of & o)
                of |= o
            else:
                seen[chunk] = o.copy(), t.copy()
    for chunk, (_, t) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["chunk", "twice"])


def twice_seen(documents: DataFrame, least_chars: int = LEAST_CHARS) -> Broadcast:
    """A Bloom filter (bytes, BITS_MOST bits at most) of all lines that may stand in two documents or more.

    Sized by the count of line breaks, so that some 1 in 1,000 of the other lines are suspects too,
    until the bound is met.
    """
    text = nonnull_text()
    n = documents.agg(F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1), F.lit(0)).alias("n")).first()["n"]
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_A_LINE * n - 1).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    merged = _filled(documents, bits, least_chars).repartition("chunk").mapInArrow(_merged, "chunk int, twice binary")
    for chunk, twice in merged.toLocalIterator():
        out[chunk * CHUNK : chunk * CHUNK + len(twice)] = np.frombuffer(twice, np.uint8)
    return documents.sparkSession.sparkContext.broadcast(out.tobytes())


def _suspects(documents: DataFrame, seen: Broadcast, keep: list[str], least_chars: int) -> DataFrame:
    """(``keep``, digest, lines): each document's keys that the filter holds, and the numbers of their lines."""
    added = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])

    def make():
        bitmap = np.frombuffer(seen.value, np.uint8)

        def work(texts: list[str]):
            at, digests, lines = [], [], []
            for n, text in enumerate(texts):
                if keys := keys_of(text, least_chars):
                    for (key, numbers), may in zip(keys.items(), holds(bitmap, _hashes(list(keys))), strict=True):
                        if may:
                            at.append(n)
                            digests.append(hashlib.sha256(key).digest())
                            lines.append(numbers)
            return at, [digests, lines]

        return work

    return map_texts(documents, keep, added, make)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_in, _lines, text) in; (_in, text without those lines) out."""
    for batch in batches:
        texts = []
        for dropped, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            gone = set(dropped or ())
            texts.append("\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or ()) for x in batch.column(1).to_pylist()], pa.int64()), pa.array(texts, pa.string())], names=["_in", "_n", "_text"])


def drop_repeated_lines(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, id_column: str = "doc_id") -> DataFrame:
    """``documents`` without lines that many documents hold, with n_lines (before) and n_dropped.

    Lines are what stands between line breaks; null and empty texts are one empty line. Lines are
    equal when their keys are: ASCII white space stripped at both ends, A-Z lower-cased. A key of at
    least ``least_chars`` code points that is found in at least ``least_documents`` documents loses all
    its lines but those in the largest id that holds it (a null id is smaller than any; if all ids
    are null, they all stay). Every row is a document, repeated ones too. A text that loses nothing
    stays as it is, null ones too; one that loses every line becomes empty. Other columns come back untouched, whatever their
    names; columns named like the added ones are replaced. An empty table stays empty.

    Keys are confirmed by their SHA-256. Texts are read four times: to count lines, to fill the filters, to
    list suspects, and for the result; only texts that (may) lose a line move.
    """
    taken = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    seen = twice_seen(documents, least_chars)
    slim = documents.select(F.col(f"`{id_column}`").alias("_id"), F.xxhash64("text").alias("_h"), "text")
    suspects = materialise(_suspects(slim, seen, ["_id", "_h"], least_chars))
    # a hot line's rows are counted where they are before they meet
    common = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last")).filter((F.col("_n") >= least_documents) & F.col("_last").isNotNull())
    common = materialise(common.select("digest", "_last"))
    goes = F.col("_id").isNull() | (F.col("_id") < F.col("_last"))
    lost = suspects.join(common, "digest").filter(goes).groupBy("_id", "_h").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("_lines"))
    lost = materialise(lost.withColumnsRenamed({"_id": "_i", "_h": "_g"}))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in taken]).alias("_in"), F.col(f"`{id_column}`").alias("_id"), F.xxhash64("text").alias("_h"))
    packed = maybe_listed(packed, lost, [("_id", "_i"), ("_h", "_g")])
    stay = packed.filter("NOT _maybe").select("_in", F.lit(0).cast("long").alias("_n"), F.col("_in.text").alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))
    moved = packed.filter("_maybe").join(lost, same, "left").select("_in", "_lines", F.col("_in.text").alias("_text"))
    moved = moved.mapInArrow(_without, T.StructType([*stay.schema.fields[:1], T.StructField("_n", T.LongType()), T.StructField("_text", T.StringType())]))
    return stay.unionByName(moved).select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_in.`{c}`") for c in taken], _line_count(F.col("_in.text")).alias("n_lines"), F.col("_n").alias("n_dropped"))


def _line_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


# ---- queries ----


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document has and loses, and a digest of the rest."""
    out = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(nonnull_text().cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op13_lines": op13_lines}
ORACLES: dict[str, str] = {
    "op13_lines": """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM split),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, i, line, last IS NULL OR k.doc_id = last AS stays FROM keyed k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""
}
