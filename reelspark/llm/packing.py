"""Best-fit packing with Martello-Toth dominance reduction.

How documents are best packed depends on their lengths alone, and there are at most as many lengths
as a sequence has tokens. So the corpus is tokenised once on the executors, the counts by length are
packed on the driver (a table no longer than a sequence, whatever the corpus), and the plan is
joined back to the pieces by length and number.

The reduction permanently fixes small sets of lengths that provably dominate all other ways to fill
the sequence of the longest piece; what is left of the instance is packed best-fit decreasing.
"""

from __future__ import annotations

import bisect
import json
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import map_texts, materialise_texts, read_table

SEQUENCE = 2048
#: The id that closes every document.
END_ID = 0
#: Fixed value: how byte-level vocabularies of this kind split a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# ---- packing counts of lengths ----


@dataclass
class Bins:
    """``times`` sequences that hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    times: int


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Pack ``counts`` pieces of each length (1 to ``capacity``) into as few sequences as dominance and best fit find."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is longer than a sequence, or empty")
    fixed = _reduce(left, capacity)
    return fixed + _best_fit(left, capacity)


def _reduce(left: dict[int, int], capacity: int) -> list[Bins]:
    """Martello and Toth's reduction: fixes dominating sets and takes them out of ``left``."""
    out: list[Bins] = []
    lengths = sorted(left)  # those that are left, ascending

    def take(*items: int) -> None:
        need = {n: items.count(n) for n in items}
        times = min(left[n] // k for n, k in need.items())
        out.append(Bins(tuple(items), times))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))

    at = capacity + 1
    while True:
        i = bisect.bisect_left(lengths, at) - 1
        if i < 0:
            return out
        longest = lengths[i]
        while longest in left and (chosen := _dominating(left, lengths, longest, capacity)):
            take(*chosen)
        at = longest  # not reducible: try the next shorter one


def _dominating(left: dict[int, int], lengths: list[int], longest: int, capacity: int) -> tuple[int, ...] | None:
    """The set with ``longest`` that dominates all others with it, of up to three pieces; None if none can be told."""
    room = capacity - longest
    others = lambda n: left.get(n, 0) - (n == longest)  # noqa: E731  pieces of that length besides the one in hand
    least: list[int] = []  # the three smallest others
    for n in lengths:
        least += [n] * min(3 - len(least), max(0, others(n)))
        if len(least) == 3 or n > room:
            break
    if not least or least[0] > room:
        return (longest,)
    i = bisect.bisect_right(lengths, room) - 1
    while others(lengths[i]) < 1:
        i -= 1
    best = lengths[i]  # the largest that fits
    if best == room or len(least) < 2 or least[0] + least[1] > room:
        return longest, best
    if len(least) == 3 and sum(least) <= room:
        return None
    # at most two fit: the pair that fills most
    pair, lo, hi = (0, 0), 0, i
    while lo <= hi:
        a, b = lengths[lo], lengths[hi]
        enough = others(a) >= 1 and others(b) >= 1 and (a != b or others(a) >= 2)
        if a + b > room:
            hi -= 1
            continue
        if enough and a + b > sum(pair):
            pair = (b, a)
        lo += 1
    if best >= sum(pair):
        return longest, best
    big, small = pair
    if big == best and not any(small < n < big and others(n) >= 1 for n in lengths[bisect.bisect_left(lengths, small) : i + 1]):
        return longest, big, small  # every other pair has members no longer than these
    return None


def _best_fit(left: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit decreasing on counts: each length goes where least room is left that still holds it."""
    open_: dict[int, list[Bins]] = {}  # by room left
    rooms: list[int] = []  # ascending
    out: list[Bins] = []

    def put(room: int, bins: Bins) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append(bins)

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                full, rest = divmod(count, capacity // n)
                if full:
                    put(capacity - n * (capacity // n), Bins((n,) * (capacity // n), full))
                if rest:
                    put(capacity - n * rest, Bins((n,) * rest, 1))
                break
            room = rooms[i]
            bins = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            used = min(count, bins.times)
            if used < bins.times:
                put(room, Bins(bins.lengths, bins.times - used))
            put(room - n, Bins((*bins.lengths, n), used))
            count -= used
    for room in rooms:
        out += open_[room]
    left.clear()
    return out


# ---- tokenising ----


class Encoder:
    """A text's ids, as the ``tokenizers`` file at ``path`` gives them (without adding special tokens), as unsigned 32-bit little-endian bytes.

    Where that file holds a byte-level vocabulary whose ids follow the order of its merges, tiktoken
    reads the same vocabulary and splits words the same way, in a third of the time. All others are
    left to tokenizers, and so are texts that name an added token, and those that tiktoken gives up
    (blank runs of about a million and more).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        said = json.loads(tokenizer.to_str())
        self.plain = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.added = [t["content"] for t in said.get("added_tokens", [])]
        self.fast = self._ranks(said)

    def encode(self, text: str) -> bytes:
        if self.fast and not any(name in text for name in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # its pattern engine has run out of stack
                pass
        return self.plain(text)

    @staticmethod
    def _ranks(said: dict):
        """The same vocabulary for tiktoken; None if it isn't of that kind."""
        import tiktoken

        model, split = said["model"], said.get("pre_tokenizer") or {}
        kind = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not kind or said.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        # a byte-level vocabulary writes bytes as letters: printable ones as themselves, the others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in said.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if merged != sorted(merged) or len(ranks) != len(merged) + 256:
            return None
        return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("_task", T.IntegerType()),
        T.StructField("_nth", T.LongType()),
    ]
)


def tokenised_pieces(documents: DataFrame, tokenizer: str, capacity: int, keep: list[str], with_ids: bool) -> DataFrame:
    """The pieces of every document: the ``keep`` columns, where a piece starts, its length and ids.

    A document is its ids and END_ID; only one longer than ``capacity`` is cut, so that all pieces
    but the first are full. _task and _nth number the pieces of one length within a task.
    """

    def make():
        encoder, seen, task = Encoder(tokenizer), {}, TaskContext.get().partitionId()
        end = np.array([END_ID], dtype="<u4").tobytes()

        def work(texts: list[str]):
            at, rows = [], []
            for i, text in enumerate(texts):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    nth = seen[b - a] = seen.get(b - a, -1) + 1
                    at.append(i)
                    rows.append((piece, a, b - a, zlib.crc32(part), part if with_ids else None, task, nth))
            return at, [[row[k] for row in rows] for k in range(len(PIECE))]

        return work

    return map_texts(documents, keep, PIECE, make)


# ---- packing documents ----


def pack(documents: DataFrame, tokenizer: str, capacity: int = SEQUENCE, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: sequence_id, and offset in it (gapless from 0).

    Null and empty texts are documents of END_ID alone; repeated rows are packed each. An empty
    table gives none. ``keep`` names columns that go along (default: doc_id).
    """
    spark = documents.sparkSession
    keep = ["doc_id"] if keep is None else keep
    pieces = materialise_texts(tokenised_pieces(documents, tokenizer, capacity, keep, with_ids))
    by_task = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows, whatever the corpus
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for bins in pack_lengths(counts, capacity):
        offset = 0
        for n in bins.lengths:
            plan.append((n, used[n], used[n] + bins.times, sequence, offset))
            used[n] += bins.times
            offset += n
        sequence += bins.times
    slots = F.broadcast(spark.createDataFrame(plan, "length long, since long, until long, first long, offset long"))  # its size is bounded by the capacity
    # a piece's number among those of its length: those of earlier tasks, then its own within its task
    before = by_task.select("length", "_task", (F.sum("n").over(Window.partitionBy("length").orderBy("_task")) - F.col("n")).alias("_before"))
    numbered = pieces.join(before, ["length", "_task"]).withColumn("_number", F.col("_before") + F.col("_nth"))
    placed = numbered.join(slots, (numbered["length"] == slots["length"]) & (F.col("_number") >= F.col("since")) & (F.col("_number") < F.col("until"))).drop(slots["length"])
    sequence_id = (F.col("first") + F.col("_number") - F.col("since")).alias("sequence_id")
    return placed.select(*[F.col(f"`{c}`") for c in keep], "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), sequence_id, "offset")


# ---- queries ----


def tokenizer_path() -> str:
    """The byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
