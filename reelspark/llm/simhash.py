"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within a few bits of each other agree in whole blocks of bits (pigeonhole), so the
distinct fingerprints meet by every pair of six blocks. Within such a bucket, distances are taken
bit-sliced: 64 fingerprints lie across the bits of 64 plane words, one plane for each bit position,
and one fingerprint is compared with all 64 at once by adding the differing planes into carry-save
counters. A word of 64 is abandoned once all its distances exceed the radius. Buckets yield no
pairs but a star for each group they connect.

Texts of a given similarity (0.8) differ in far more bits than blocks can look up. Those meet by
bands of minima of their shingles instead, are compared bit-sliced by fingerprints of 256 bits, and
every link is verified by the exact similarity of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import map_texts, materialise, materialise_texts, maybe_listed, nonnull_text, read_table
from reelspark.llm.components import connected_components

#: A bucket of more fingerprints is compared in tiles of two parts, each its own row group.
BUCKET_MOST = 8192
#: Comparisons of one fingerprint with a word of 64 that are under way at once.
SLAB = 1 << 16
BATCH_ROWS = 50_000


def fingerprint(text: str, shingle: int) -> int:
    """64-bit SimHash over word shingles, repeats included: a bit is set where over half the hashes set it.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; fewer words than a
    shingle make one shingle, none make fingerprint 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little", signed=True)


#: 64-bit words of a text's sketch that are compared bit-sliced.
WORDS = 4
#: Bands that texts meet by, and the minima in each: of similarity s, 1 - (1 - s**MINIMA)**BANDS meet (99 % at 0.8).
BANDS, MINIMA = 12, 5
#: Shingles that are sketched at once; a longer text is sketched in parts.
SHINGLES_AT_ONCE = 4096
#: Texts of a group whose pairs are all verified without comparing fingerprints first.
FEW = 32
#: Texts that are verified against each other in one task: rows and bytes. A larger group is verified in tiles of two parts.
PART_ROWS, PART_BYTES = 4096, 16 << 20


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """The values hashed anew."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Word shingles of texts as sets of hashes, and what is taken of them. Built once in each task.

    Words are those of ``fingerprint``; fewer words than a shingle make one shingle, none make none.
    """

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.weights = _mixed(np.arange(shingle, dtype="<u8"), 1) | np.uint64(1)
        self.factors = _mixed(np.arange(BANDS * MINIMA, dtype="<u8"), 2) | np.uint64(1)
        self.band_weights = _mixed(np.arange(MINIMA, dtype="<u8"), 3) | np.uint64(1)

    def words(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype="<u8", count=len(words))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """The distinct shingles, ascending."""
        n = max(min(len(words), 1), len(words) - self.shingle + 1)
        out = np.full(n, len(words) if len(words) < self.shingle else self.shingle, dtype="<u8")
        for k in range(min(self.shingle, len(words))):
            out += words[k : k + n] * self.weights[k]
        return np.unique(_mixed(out, 4))

    def sketch(self, shingles: np.ndarray) -> tuple[list[int], list[int | None]]:
        """(WORDS words of the fingerprint, BANDS band keys), as signed longs; without shingles zeros and nulls."""
        if not len(shingles):
            return [0] * WORDS, [None] * BANDS
        least, bits = None, 0
        for at in range(0, len(shingles), SHINGLES_AT_ONCE):
            part = shingles[at : at + SHINGLES_AT_ONCE]
            values = (self.factors[:, None] * part).min(axis=1)
            least = values if least is None else np.minimum(least, values)
            mixed = np.stack([_mixed(part, 5 + k) for k in range(WORDS)], axis=1)
            ones = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
            for lo in range(0, len(ones), 255):  # sums that fit a byte
                bits = bits + np.add.reduce(ones[lo : lo + 255], axis=0, dtype=np.uint8).astype(np.int64)
        bands = _mixed((least.reshape(BANDS, MINIMA) * self.band_weights).sum(axis=1, dtype="<u8"), 99)
        return np.packbits(2 * bits > len(shingles), bitorder="little").view("<i8").tolist(), bands.view("<i8").tolist()


def bits_apart(similarity: float, deviations: float = 0.0) -> int:
    """Bits of a sketch in which texts of that similarity (Jaccard) differ on average at most, and some standard deviations more.

    Sets of similarity s have a cosine of at least 2s / (1 + s), and a bit differs by chance angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WORDS
    return round(n * p + deviations * math.sqrt(n * p * (1 - p)))


def with_fingerprints(documents: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the 64 bits as a signed long). Null text is empty."""
    added = T.StructType([T.StructField("fp", T.LongType())])
    return map_texts(documents, keep, added, lambda: lambda texts: (None, [[fingerprint(t, shingle) for t in texts]]))


def block_masks(radius: int) -> list[int]:
    """Masks of two blocks each, such that any two fingerprints within ``radius`` bits agree under one of them."""
    blocks = radius + 2  # at least two blocks stay whole
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(x | y) for x, y in combinations(parts, 2)]


def within_radius(prints: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, of fingerprints (uint64, one or more words each) in the same group; groups must be contiguous.

    Each unordered pair comes at least once, in slabs of bounded size.
    """
    if len(prints) < 2:
        return
    prints = prints.reshape(len(prints), -1)
    n_bits = 64 * prints.shape[1]
    # 64 fingerprints of one group share a word; planes[w, b] has bit b of each of them
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    within = np.arange(len(group)) - np.repeat(starts, sizes)
    words_of = -(-sizes // 64)
    first_word = np.cumsum(words_of) - words_of
    word = np.repeat(first_word, sizes) + within // 64
    lane = (within % 64).astype(np.uint64)
    n_words = int(words_of.sum())
    one = np.uint64(1)
    planes = np.zeros((n_bits, n_words), dtype=np.uint64)
    valid = np.zeros(n_words, dtype=np.uint64)
    np.bitwise_or.at(valid, word, one << lane)
    for b in range(n_bits):
        np.bitwise_or.at(planes[b], word, ((prints[:, b // 64] >> np.uint64(b % 64)) & one) << lane)
    base = np.repeat(starts, words_of) + 64 * (np.arange(n_words) - np.repeat(first_word, words_of))  # index of lane 0
    last_word = np.repeat(first_word + words_of, sizes)
    # each fingerprint meets its own word and the later ones of its group
    todo = (last_word - word).astype(np.int64)
    ends = np.cumsum(todo)
    bits = max(1, radius.bit_length())
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for lo in range(0, int(ends[-1]), SLAB):
        flat = np.arange(lo, min(lo + SLAB, int(ends[-1])))
        q = np.searchsorted(ends, flat, side="right")
        w = word[q] + (flat - (ends[q] - todo[q]))
        alive, at = np.arange(len(q)), w
        counters = [np.zeros(len(q), dtype=np.uint64) for _ in range(bits)]
        over = ~valid[w]
        mine = prints[q]
        for b in range(n_bits):
            carry = planes[b][at] ^ np.where((mine[:, b // 64] >> np.uint64(b % 64)) & one, ones, np.uint64(0))
            for k in range(bits):
                carry, counters[k] = counters[k] & carry, counters[k] ^ carry
            over |= carry
            if b % 8 == 7 and (b >= radius or b == n_bits - 1):
                far, same = over.copy(), ~over
                for k in reversed(range(bits)):
                    if radius >> k & 1:
                        same &= counters[k]
                    else:
                        far |= same & counters[k]
                        same &= ~counters[k]
                left = far != ones
                if not left.all():  # abandon the words in which every distance exceeds the radius
                    alive, at, mine, over, far = alive[left], at[left], mine[left], over[left], far[left]
                    counters = [c[left] for c in counters]
                if not len(alive):
                    break
        if len(alive):
            near = ~far
            set_bits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lanes = np.nonzero(set_bits)
            i, j = q[alive[r]], base[w[alive[r]]] + lanes
            differ = i != j
            if differ.any():
                yield i[differ], j[differ]


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items, the smallest index connected with it."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            least = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), least)
            while (root[root] != root).any():
                root = root[root]
    return root


def _connected(fp: np.ndarray, group: np.ndarray, ids: np.ndarray, radius: int) -> pd.DataFrame:
    """Each fingerprint with the root of its group in its bucket: all that matters where every link counts."""
    root = _roots(len(fp), within_radius(fp.view(np.uint64), group, radius))
    moved = root != np.arange(len(fp))
    return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def _pairs_by_nearness(sets: list[np.ndarray], sketcher: Sketcher, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets that may be alike: all of a few sets; of more those whose fingerprints are near, the nearer ones first."""
    if len(sets) <= FEW:
        yield np.triu_indices(len(sets), 1)
        return
    prints = np.array([sketcher.sketch(s)[0] for s in sets], np.int64).view(np.uint64)
    for radius in (bits_apart((1 + similarity) / 2), bits_apart(similarity), bits_apart(similarity, 3)):
        yield from within_radius(prints, np.zeros(len(sets), np.int64), radius)


def _alike(sets: list[np.ndarray], sketcher: Sketcher, similarity: float) -> np.ndarray:
    """For each of some sets of shingles, the smallest index connected with it by links of that exact similarity or more.

    Only pairs that are not connected yet are verified.
    """
    root = np.arange(len(sets))  # index 0 is the smallest of all
    sizes = np.array([len(s) for s in sets])
    for i, j in _pairs_by_nearness(sets, sketcher, similarity):
        if not root.any():  # all are connected
            break
        open_ = (root[i] != root[j]) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9)
        i, j = i[open_], j[open_]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for lo, hi in zip(starts, [*starts[1:], len(i)]):
            one = i[lo]
            others = np.unique(j[lo:hi][root[j[lo:hi]] != root[one]])
            for at in range(0, len(others), 256):
                these = others[at : at + 256]
                mine, theirs = sets[one], np.concatenate([sets[x] for x in these])
                held = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.add.reduceat(held, np.r_[0, np.cumsum(sizes[these])[:-1]], dtype=np.int64)
                near = these[both >= similarity * (sizes[one] + sizes[these] - both) - 1e-9]
                if len(near):
                    roots = root[np.r_[near, one]]
                    root[np.isin(root, roots)] = roots.min()
    return root


def _verified(batches: Iterator[pd.DataFrame], shingle: int, similarity: float) -> Iterator[pd.DataFrame]:
    """Rows (root, i, j, node, text) sorted by (root, i, j) in; for each tile the stars of what is verified out."""
    sketcher = Sketcher(shingle)
    key, nodes, sets = None, [], []

    def edges() -> pd.DataFrame:
        ids = np.array(nodes, np.int64)
        root = _alike(sets, sketcher, similarity)
        moved = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    for batch in batches:
        for *at, node, text in zip(*[batch[c] for c in ("root", "i", "j", "node", "text")], strict=True):
            if at != key:
                if len(nodes) > 1:
                    yield edges()
                key, nodes, sets = at, [], []
            nodes.append(node)
            sets.append(sketcher.shingles(sketcher.words(text)))
    if len(nodes) > 1:
        yield edges()


def _stars(batches: Iterator[pd.DataFrame], radius: int, of_bucket) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket in, what ``of_bucket`` makes of whole buckets out."""
    held: list[pd.DataFrame] = []
    rows = 0
    keys = ["c", "v", "i", "j"]

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame[keys].to_numpy(np.int64)
        group = np.r_[0, np.cumsum((key[1:] != key[:-1]).any(axis=1))] if len(key) else np.zeros(0, np.int64)
        shared = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        prints = frame.drop(columns=[*keys, "id"]).to_numpy(np.int64)[shared]
        return of_bucket(np.ascontiguousarray(prints[:, 0] if prints.shape[1] == 1 else prints), group[shared], frame["id"].to_numpy(np.int64)[shared], radius)

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < BATCH_ROWS:
            continue
        frame = pd.concat(held, ignore_index=True)
        tail = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        yield edges(frame[~tail])
        held, rows = [frame[tail]], int(tail.sum())
    if held:
        yield edges(pd.concat(held, ignore_index=True))


def _in_buckets(keyed: DataFrame, radius: int, of_bucket: Callable) -> DataFrame:
    """What ``of_bucket`` finds among rows (id, c, v and the columns of the fingerprint) of equal (c, v).

    A bucket of over BUCKET_MOST rows is cut into parts, and each two parts meet in a tile of their
    own, so no link is lost and no task holds more than two parts.
    """
    hot = materialise(keyed.groupBy("c", "v").count().filter(F.col("count") > BUCKET_MOST).select("c", "v", F.ceil(F.col("count") / BUCKET_MOST).cast("int").alias("parts")))
    none = F.lit(0)
    prints = [x for x in keyed.columns if x not in ("id", "c", "v")]
    if hot.isEmpty():
        tiles = keyed.select("c", "v", none.alias("i"), none.alias("j"), *prints, "id")
    else:
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        other = F.explode(F.when(F.col("parts").isNull(), F.array(none)).otherwise(F.sequence(none, F.col("parts") - 1)))
        tiles = keyed.join(hot, ["c", "v"], "left").withColumn("p", F.coalesce(part, none)).withColumn("o", other)
        tiles = tiles.select("c", "v", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), *prints, "id")
    return tiles.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j").mapInPandas(lambda b: _stars(b, radius, of_bucket), "a long, b long")


def link_fingerprints(prints: DataFrame, radius: int) -> DataFrame:
    """(node, root) for each distinct fingerprint that links with another; root is the component's smallest. ``prints`` has distinct, non-null longs in ``fp``."""
    blocks = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for c, m in enumerate(block_masks(radius))])
    keyed = prints.select("fp", F.col("fp").alias("id"), F.explode(blocks).alias("k")).select("fp", "id", "k.c", "k.v")
    return connected_components(materialise(_in_buckets(keyed, radius, _connected)))


def _rows(documents: DataFrame, id_column: str, added: T.StructType, make: Callable) -> DataFrame:
    """(_id, _h, _size, _r and ``added``) of every row: its id, a hash of its text as it is, the text's bytes, and a number of its own."""
    slim = documents.select(F.col(f"`{id_column}`").alias("_id"), F.xxhash64("text").alias("_h"), F.octet_length(nonnull_text()).cast("long").alias("_size"), "text")
    return materialise_texts(map_texts(slim, ["_id", "_h", "_size"], added, make).withColumn("_r", F.monotonically_increasing_id()))


def _printed(documents: DataFrame, shingle: int, radius: int, id_column: str) -> DataFrame:
    """(_id, _h, _r, fp, root) of every row: links are those of ``near_duplicate_groups``."""
    added = T.StructType([T.StructField("fp", T.LongType())])
    rows = _rows(documents, id_column, added, lambda: lambda texts: (None, [[fingerprint(t, shingle) for t in texts]]))
    linked = materialise(link_fingerprints(materialise(rows.select("fp").distinct()), radius).withColumnRenamed("node", "fp"))
    return rows.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _sketched(documents: DataFrame, shingle: int, similarity: float, id_column: str) -> DataFrame:
    """(_id, _h, _r, root) of every row: links are those of ``similar_groups``."""
    longs = [*[f"w{k}" for k in range(WORDS)], *[f"b{k}" for k in range(BANDS)]]
    added = T.StructType([T.StructField("key", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in longs]])

    def make():
        sketcher = Sketcher(shingle)

        def work(texts: list[str]):
            out = []
            for text in texts:
                words = sketcher.words(text)
                prints, bands = sketcher.sketch(sketcher.shingles(words))
                out.append((xxhash.xxh3_128_digest(words.tobytes()), *prints, *bands))
            return None, [[row[k] for row in out] for k in range(1 + len(longs))]

        return work

    rows = _rows(documents, id_column, added, make)
    # copies have equal words, and so equal sketches: one row of each stands for all
    texts = materialise(rows.groupBy("key").agg(F.min("_r").alias("node"), F.max("_size").alias("size"), *[F.max(c).alias(c) for c in longs]))
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(f"b{k}").alias("v")) for k in range(BANDS)]))
    keyed = texts.select(F.col("node").alias("id"), *[f"w{k}" for k in range(WORDS)], bands.alias("x")).filter("x.v IS NOT NULL").select("id", "x.c", "x.v", *[f"w{k}" for k in range(WORDS)])
    stars = materialise(_in_buckets(keyed, bits_apart(similarity, 3), _connected).distinct())
    near = _units(stars, materialise(connected_components(stars)), texts)
    # only texts that are near another are read again, and only within their unit they are verified
    # (their list is written first; a map of it keeps other texts from moving to meet it)
    members = materialise(rows.select(F.col("_r").alias("node"), "_id", "_h").join(near, "node"))
    again = documents.select(F.col(f"`{id_column}`").alias("_id"), F.xxhash64("text").alias("_h"), nonnull_text().alias("text"))
    again = maybe_listed(again, members, [("_id", "_id"), ("_h", "_h")]).filter("_maybe")
    again = again.join(members.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), "node", "root"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))).select("root", "node", "text")
    linked = connected_components(materialise(_verify(materialise(again), shingle, similarity)))
    # written first: Spark splits the rows of a hot key only where it joins them with what has been shuffled as it is
    roots = materialise(texts.select("key", "node").join(linked.withColumnRenamed("root", "_o"), "node", "left").select("key", F.coalesce("_o", "node").alias("root")))
    return rows.select("_id", "_h", "_r", "key").join(roots, "key")


def _units(stars: DataFrame, near: DataFrame, texts: DataFrame) -> DataFrame:
    """(root, node): the units within which texts are verified, such that any two texts that met in a bucket share one.

    ``near`` (node, root) has the components of all candidates. A component that one task can hold is
    a unit. In a larger one, which chains of candidates may have brought together, units are the
    ``stars`` (a, b) of its buckets: what met in one bucket hangs on one b. So the work follows from
    what met, not from the square of a component, and a text is in as many units as it has bands at most.
    """
    sizes = near.join(texts.select("node", "size"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    large = materialise(sizes.filter((F.col("n") > PART_ROWS) | (F.col("bytes") > PART_BYTES)).select("root"))
    if large.isEmpty():
        return near.select("root", "node")
    within = stars.join(near.join(large, "root", "left_semi").select(F.col("node").alias("a")), "a", "left_semi")
    within = materialise(within.select(F.explode(F.array(F.struct(F.col("b").alias("root"), F.col("a").alias("node")), F.struct(F.col("b").alias("root"), F.col("b").alias("node")))).alias("x")).select("x.*").distinct())
    return near.join(large, "root", "left_anti").select("root", "node").unionByName(within)


def _verify(members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): stars of the texts (root, node, text) that are alike exactly and share a root."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / PART_ROWS, F.col("bytes") / PART_BYTES)).cast("int")
    large = materialise(sizes.select("root", parts.alias("parts")).filter("parts > 1"))
    none = F.lit(0)
    if large.isEmpty():
        tiles = members.select("root", none.alias("i"), none.alias("j"), "node", "text")
    else:
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        other = F.explode(F.when(F.col("parts").isNull(), F.array(none)).otherwise(F.sequence(none, F.col("parts") - 1)))
        tiles = members.join(large, "root", "left").withColumn("p", F.coalesce(part, none)).withColumn("o", other)
        tiles = tiles.select("root", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "node", "text")
    tiles = tiles.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return tiles.mapInPandas(lambda b: _verified(b, shingle, similarity), "a long, b long")


def _least_of(rows: DataFrame) -> DataFrame:
    """(root, component_id): the smallest id of each group."""
    return rows.groupBy("root").agg(F.min("_id").alias("component_id"))


def near_duplicate_groups(documents: DataFrame, shingle: int = 5, radius: int = 4, id_column: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id among the documents reachable over links.

    Documents link when their fingerprints differ in at most ``radius`` bits. Null and empty texts
    have fingerprint 0 and link with each other; a group whose ids are all null has a null
    component_id; repeated rows stay. Other columns are ignored, whatever their names.
    """
    fps = materialise_texts(with_fingerprints(documents, shingle, [id_column]))
    distinct = materialise(fps.groupBy("fp").agg(F.min(id_column).alias("least")))
    linked = link_fingerprints(distinct.select("fp"), radius)
    classes = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    leasts = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = materialise(classes.join(leasts, "root").select("fp", "component_id"))  # a hot fingerprint's rows are split where they meet it
    return fps.join(of_print, "fp").select(id_column, "fp", "component_id")


def similar_groups(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """(id, component_id) for every row: groups of texts of which each has a link, two texts being linked when the Jaccard similarity of their sets of shingles is at least ``similarity``.

    Candidates share one of BANDS bands of minima and are within three standard deviations of the
    bits that such texts differ in; every link is verified exactly. So no link is false, and of the
    links at the threshold itself about 1 % are missed, of nearer ones fewer. Texts that differ in
    case or white space only are copies. Texts without a word (null ones too) are copies of each
    other. Repeated rows stay; a group whose ids are all null has a null component_id. Other
    columns are ignored, whatever their names.
    """
    rows = materialise(_sketched(documents, shingle, similarity, id_column))
    return rows.join(materialise(_least_of(rows)), "root").select(F.col("_id").alias(id_column), "component_id")


def _keep_first(documents: DataFrame, rows: DataFrame, id_column: str) -> DataFrame:
    """``documents`` with one row left of each group of ``rows`` (_id, _h, _r, root): the one with the smallest id (null ids last).

    Rows are told apart by id and text, so that others that share only the id stay; of rows equal
    in both one stays. Only rows that a map of those that go can hold meet their list; the others
    stay without moving, at the cost of a second scan.
    """
    rows = materialise(rows.select("_id", "_h", "_r", "root"))
    last = F.struct(F.col("_id").isNull(), "_id", "_r")
    several = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(last).alias("first")).filter("n > 1").select("root", F.col("first._r").alias("_first"))
    several = materialise(several)  # a hot group's rows are split where they meet it
    marks = rows.join(several, "root").groupBy("_id", "_h").agg(F.max(F.col("_r") == F.col("_first")).alias("_stays"), F.count(F.lit(1)).alias("_n"))
    marks = materialise(marks.filter("NOT _stays OR _n > 1").select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), "_stays"))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_in"), F.col(f"`{id_column}`").alias("_id"), F.xxhash64("text").alias("_h"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))
    keys = [("_id", "_i"), ("_h", "_g")]
    packed = maybe_listed(packed, marks, keys)
    stay = packed.filter("NOT _maybe").select("_in.*").unionByName(packed.filter("_maybe").join(marks, same, "left_anti").select("_in.*"))
    repeated = marks.filter("_stays")
    if repeated.isEmpty():
        return stay
    some = maybe_listed(packed.drop("_maybe"), repeated, keys).filter("_maybe")
    return stay.unionByName(some.join(repeated, same, "left_semi").dropDuplicates(["_id", "_h"]).select("_in.*"))


def drop_near_duplicates(documents: DataFrame, shingle: int = 5, radius: int = 4, id_column: str = "doc_id") -> DataFrame:
    """One row of each group whose fingerprints link within ``radius`` bits: the one with the smallest id. Nulls, ties and repeated rows: see ``_keep_first``."""
    return _keep_first(documents, _printed(documents, shingle, radius, id_column), id_column)


def drop_similar(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """One row of each group of texts of at least ``similarity``: the one with the smallest id (null ids last).

    Null, empty and wordless texts are copies of each other. Rows that share an id but not a group
    all stay; of repeated rows one stays. An empty table stays empty; other columns come back as they were.
    """
    return _keep_first(documents, _sketched(documents, shingle, similarity, id_column), id_column)


# ---- queries ----


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: four-word shingles, links at 4 or fewer bits."""
    groups = near_duplicate_groups(read_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
