"""Importance resampling towards a target distribution.

Runs of one to three words are hashed into buckets. What a bucket is worth is the logarithm of its
share in the target over its share in the corpus; a document's weight is the sum over its runs, taken
from one dense array of all buckets' gains. Weights with Gumbel noise make a sample without
replacement of the highest scores. The score of the last one drawn is found by a distributed
quickselect: a few random pivot keys a round, exact three-way counts around each, and on with the
rows between the two pivots that the wanted place lies between. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import fold_texts, in_order, map_texts, materialise, read_table, remove, shared_folder

BUCKETS, RUN = 10_000, 3
#: The share drawn in percent, the words that a document must have, and the seed.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Random pivot keys of a round of the selection.
PIVOTS = 64
#: Words that are hashed at once, and bytes of a text that are split into words at once.
WORDS_AT_ONCE, BYTES_AT_ONCE = 200_000, 1 << 20
#: Bytes by which a checksum is moved on in one look-up.
STEP = 64

#: What bytes become before a text is split at blanks: digits, letters and all beyond ASCII stay, A-Z are lower-cased.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class RunHasher:
    """CRC-32 of all runs of words, worked out from the words' own. Built once in each task.

    CRC-32 is linear: that of a text and what follows it is the first one's, moved on by as many zero
    bytes, XORed with that of what follows. ``moved[n, k, b]`` is byte b at place k moved on by n.
    """

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
        self.moved = np.empty((STEP + 1, 4, 256), np.uint32)
        self.moved[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(STEP):
            x = self.moved[n]
            self.moved[n + 1] = one[x & 255] ^ (x >> 8)

    def on(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Checksums moved on by so many zero bytes."""
        n, moved = np.minimum(by, STEP), self.moved
        out = moved[n, 0, crc & 255] ^ moved[n, 1, crc >> 8 & 255] ^ moved[n, 2, crc >> 16 & 255] ^ moved[n, 3, crc >> 24]
        long = np.flatnonzero(by > STEP)
        if len(long):
            out[long] = self.on(out[long], by[long] - STEP)
        return out

    def ending(self, words: list[bytes], texts: np.ndarray, old: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1, 2 and 3 words: the buckets of those that end at each word, and the words' places.

        ``texts`` tells which text each word belongs to; the first ``old`` words are only there for runs to begin in.
        """
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        spaced = self.on(np.full(len(words), zlib.crc32(b" "), np.uint32), size) ^ crc
        run = crc
        for k in range(min(RUN, len(words))):
            if k:
                run = self.on(run[:-1], size[k:] + 1) ^ spaced[k:]
            at = np.arange(k, len(words))
            fits = (texts[k:] == texts[: len(words) - k]) & (at >= old)
            yield (run[fits] % np.uint32(self.buckets)).astype(np.int64), at[fits]


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch at a time."""
    at = 0
    while at < len(text):
        to = text.find(b" ", at + BYTES_AT_ONCE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def word_runs(texts: list[str], hasher: RunHasher) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets of runs, the text that each belongs to, words in a run) of some texts, in parts of bounded size."""
    words: list[bytes] = []
    of: list[tuple[int, int]] = []
    old = 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        which = np.repeat([i for i, _ in of], [n for _, n in of]).astype(np.int64)
        for k, (buckets, at) in enumerate(hasher.ending(words, which, old)):
            yield buckets, which[at], k + 1

    for i, text in enumerate(texts):
        for piece in _pieces(text.encode("utf-8", "surrogatepass").translate(_PLAIN)):
            words += piece
            of.append((i, len(piece)))
            if len(words) >= WORDS_AT_ONCE:
                yield from flush()
                old = min(RUN - 1, sum(n for j, n in of if j == i))  # runs to come may begin in the last words of this text
                words, of = words[len(words) - old :], [(i, old)]
    if len(words) > old:
        yield from flush()


def bucket_counts(texts: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of one to three words of all texts fall into each bucket. A task sends a row for each bucket at most, and so does the sum."""

    def make():
        hasher, sums = RunHasher(buckets), np.zeros(buckets, np.int64)

        def add(some: list[str]) -> None:
            for found, _, _ in word_runs(some, hasher):
                sums.__iadd__(np.bincount(found, minlength=buckets))

        def gathered() -> Iterator[list[list]]:
            there = np.flatnonzero(sums)
            yield [there, sums[there]]

        return add, gathered

    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    out = np.zeros(buckets, np.int64)
    for bucket, n in fold_texts(texts, schema, make, text_column).groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a run in each bucket adds to a weight, in thousandths: the smoothed shares' logarithm, rounded down."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(documents: DataFrame, gains: np.ndarray, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, n_features (runs, repeats counted) and weight (the sum of their gains)."""
    added = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    shared = documents.sparkSession.sparkContext.broadcast(gains)

    def make():
        values = shared.value
        hasher = RunHasher(len(values))

        def work(texts: list[str]):
            words, runs, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for found, of, size in word_runs(texts, hasher):
                runs += np.bincount(of, minlength=len(texts))
                if size == 1:
                    words += np.bincount(of, minlength=len(texts))
                if len(of):  # texts come in order
                    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    weight[of[first]] += np.add.reduceat(values[found], first)
            return None, [words, runs, weight]

        return work

    return map_texts(documents, keep, added, make, text_column)


def noise(id_text: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, fields: list[str], k: int, n: int, seed: int = SEED, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest (from 1) of the keys (``fields``, compared in order, nulls first) of ``rows``, which has n rows; None if there is none.

    Each round takes some rows by a hash as pivots, counts the rows below, at and between them, and
    goes on with the rows between two pivots (or below the first, above the last), which are written
    to shared storage: some 1 in 64 of those before. Equal keys are counted, not listed.
    """
    if not 1 <= k <= n:
        return None
    schema = rows.select(*fields).schema
    spark, key, active, path = rows.sparkSession, F.struct(*fields), rows.select(*fields), None
    for turn in range(1000):
        h = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), *fields), F.lit(1 << 40))
        drawn = active if n <= pivots else active.filter(h < F.lit(max(1, int((1 << 40) * pivots / n))))
        some = sorted({tuple(r) for r in drawn.limit(8 * pivots).collect()}, key=lambda r: [(x is not None, x) for x in r])
        if not some:
            continue
        given = F.array(*[F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(p, schema, strict=True)]) for p in some])
        below = active.withColumn("_below", F.size(F.filter(given, lambda p: p < key))).withColumn("_upto", F.size(F.filter(given, lambda p: p <= key)))
        for r in sorted(below.groupBy("_below", "_upto").count().collect()):
            if k > r["count"]:
                k -= r["count"]
            elif r["_below"] < r["_upto"]:
                return some[r["_below"]]
            else:
                n = r["count"]
                before, path = path, shared_folder(spark)
                active = materialise(below.filter((F.col("_below") == r["_below"]) & (F.col("_upto") == r["_upto"])).select(*fields), path)
                if before:
                    remove(spark, before)
                break
    raise RuntimeError("no pivots could be drawn")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, n_words, n_features, weight, score, rank) of every row of ``documents``; rank (from 1) is null for those that are not drawn.

    Drawn are the highest scores among the documents with at least ``least_words`` words: ``percent``
    of them, rounded down; ties to the smaller id (null last), then in the order in which the scores
    were written. Every row counts, repeated ones too, which may be drawn each. Null and empty texts
    have no words, weight 0 and are never drawn; a null id makes its noise from the empty text. An
    empty target gives every bucket its smoothed share; an empty table stays empty. Other columns are
    ignored, whatever their names.

    Texts are read twice: for the counts, and for the weights.
    """
    gains = gains_of(bucket_counts(documents, text_column, buckets), bucket_counts(target, text_column, buckets))
    id_text = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    slim = documents.select(F.col(f"`{id_column}`").alias("_id"), F.xxhash64(f"`{text_column}`").alias("text_hash"), F.col(f"`{text_column}`").alias("text"))
    scored = weighed(slim, gains, ["_id", "text_hash"]).withColumn("score", F.col("weight") + noise(id_text, seed))
    # the key: highest score first, then smaller ids, nulls last; the row's own number tells equal rows apart
    scored = scored.withColumns({"_low": -F.col("score"), "_none": F.col("_id").isNull(), "_r": F.monotonically_increasing_id()})
    scored = materialise(scored)
    fields = ["_low", "_none", "_id", "_r"]
    able = F.col("n_words") >= least_words
    n = scored.filter(able).count()
    k = percent * n // 100
    last = kth_key(scored.filter(able), fields, k, n, seed)
    taken = ["_id", "text_hash", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        out = scored.select(*taken, none)
    else:
        types = {f.name: f.dataType for f in scored.schema}
        wins = able & (F.struct(*fields) <= F.struct(*[F.lit(x).cast(types[c]).alias(c) for x, c in zip(last, fields, strict=True)]))
        ranked = in_order(scored.filter(wins), *[F.col(c).asc() for c in fields]).select(*taken, (F.col("_at") + 1).alias("rank"))
        out = scored.filter(~wins).select(*taken, none).unionByName(ranked)
    return out.withColumnRenamed("_id", id_column)


def drawn_documents(documents: DataFrame, resampled: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that ``resample`` drew, as they were. Rows equal in id and text come together if one of them was drawn."""
    few = resampled.filter("rank IS NOT NULL").select(F.col(f"`{id_column}`").alias("_i"), F.col("text_hash").alias("_t")).distinct()
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_in"), F.col(f"`{id_column}`").alias("_id"), F.xxhash64(f"`{text_column}`").alias("_h"))
    return packed.join(few, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_t")), "left_semi").select("_in.*")


# ---- queries ----


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards ``benchmark``."""
    out = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_resampling": op11_resampling}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES: dict[str, str] = {
    "op11_resampling": f"""
WITH RECURSIVE bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT 'd' AS kind, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 'b', item_id, {_WORDS} FROM benchmark),
places AS (SELECT kind, id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
runs AS (SELECT kind, id, w[i] AS f FROM places UNION ALL SELECT kind, id, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w) UNION ALL SELECT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
counted AS (SELECT kind, id, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(0, strlen(f)), lambda k: ('0x' || substr(hex(encode(f)), 2 * k + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), tab),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (SELECT t.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || t.id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM texts t LEFT JOIN weights USING (id) WHERE kind = 'd'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)"""
}
