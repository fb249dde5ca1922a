"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: wherever it occurs with at
most k edits, one piece at least is whole. One Aho-Corasick automaton finds all pieces of all items
in a text, and each place they suggest is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import filter_texts, map_texts, materialise_texts, read_table

#: Edits allowed, as a share of an item's normalised letters.
ERROR_RATE = 0.1
#: Items whose pieces one automaton holds; a longer benchmark is matched in several passes.
ITEMS_PER_PASS = 5000
#: Letters that a piece should have at least, where the budget allows: shorter items get fewer edits.
PIECE_LEAST = 8

_to_space = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_other = re.compile(r"[^\w ]+")


def normalise(text: str) -> str:
    """Lower-case words joined by single spaces: case, punctuation and white space don't count."""
    text = text.encode("utf-8", "replace").translate(_to_space).decode("utf-8")
    if not text.isascii():
        text = _other.sub(" ", text.lower())
    return " ".join(text.split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed in an item of that many normalised letters."""
    return max(0, min(int(rate * length), length // PIECE_LEAST - 1))


class Item:
    """A test item ready to be verified.

    Its k + 1 pieces are the leaves of a binary tree. A part of j pieces has a budget of j - 1: if
    the item occurs within its budget, then so do all parts on the way down to some whole piece.
    From a piece's hit, the parts are verified from small to large, so most false hits end early.
    """

    def __init__(self, key: int, text: str, rate: float):
        self.key, self.text, self.k = key, text, budget(len(text), rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.cuts = [len(text) * i // (self.k + 1) for i in range(self.k + 2)]

    def pieces(self) -> list[tuple[int, str, tuple | None, list[tuple[int, int, int]]]]:
        """Each piece's start and text, what to look for beside it, and the parts above it but for the whole."""
        out: list = []

        def down(lo: int, hi: int, above: list[tuple[int, int, int]], beside: tuple | None) -> None:
            if hi - lo == 1:
                out.append((self.cuts[lo], self.text[self.cuts[lo] : self.cuts[hi]], beside, above[::-1]))
                return
            mid = (lo + hi) // 2
            part = (self.cuts[lo], self.cuts[hi], hi - lo - 1)
            pair = hi - lo == 2  # one edit between two pieces: half of the other one must be whole
            above = above if pair or hi - lo == self.k + 1 else [*above, part]
            down(lo, mid, above, self._halves(mid, hi, False) if pair else None)
            down(mid, hi, above, self._halves(lo, mid, True) if pair else None)

        down(0, self.k + 1, [], None)
        return out

    def _halves(self, lo: int, hi: int, left: bool) -> tuple[bool, str, str, int]:
        piece = self.text[self.cuts[lo] : self.cuts[hi]]
        return left, piece[: len(piece) // 2], piece[len(piece) // 2 :], len(piece)

    def distance(self, window: str, lo: int = 0, hi: int | None = None, enough: int = 0) -> tuple[int, int]:
        """The least edit distance of the item's letters lo to hi to any stretch of ``window``, and where that stretch ends.

        Myers' bit-parallel search; ends at the first stretch within ``enough`` edits.
        """
        hi = len(self.text) if hi is None else hi
        at = window.find(self.text[lo:hi])
        if at >= 0:
            return 0, at + hi - lo
        m = hi - lo
        full, high = (1 << m) - 1, 1 << m - 1
        plus, minus, score, masks = full, 0, m, self.masks
        best, end = m, 0
        for i, c in enumerate(window):
            eq = masks.get(c, 0) >> lo & full
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best, end = score, i + 1
                    if best <= enough:
                        break
            ph, mh = (ph << 1) & full, (mh << 1) & full
            plus = mh | (full & ~(xv | ph))
            minus = ph & xv
        return best, end


def _beside(text: str, start: int, end: int, side: tuple[bool, str, str, int]) -> bool:
    """Whether the piece beside text[start:end] can be there with one edit at most: one of its halves is whole."""
    left, first, second, length = side
    if not left:
        at = end + len(first)
        return text.startswith(first, end) or text.startswith(second, at) or text.startswith(second, at - 1) or text.startswith(second, at + 1)
    at = start - length
    if at < 1:  # near the text's start, where negative places would wrap: leave it to the next step
        return True
    return text.startswith(second, start - len(second)) or text.startswith(first, at) or text.startswith(first, at - 1) or text.startswith(first, at + 1)


class Matcher:
    """All items of one pass. Built once in each Python worker."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [Item(key, n, rate) for key, text in items if (n := normalise(text or ""))]
        self.automaton = ahocorasick.Automaton()
        for n, item in enumerate(self.items):
            for at, piece, beside, above in item.pieces():
                self.automaton.add_word(piece, (*self.automaton.get(piece, ()), (n, at, len(piece), beside, above)))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, least distance, end of that place in the normalised text, distinct places) of each item found."""
        if not self.items:
            return []
        text = normalise(text)
        starts: dict[int, set[int]] = {}
        for end, hits in self.automaton.iter(text):
            end += 1
            for n, at, length, beside, above in hits:
                start = end - length
                if beside is not None and not _beside(text, start, end, beside):
                    continue
                zero = start - at  # where the item would begin
                if zero in starts.get(n, ()):
                    continue
                item = self.items[n]
                for lo, hi, k in above:
                    if item.distance(text[max(0, zero + lo - k) : zero + hi + k], lo, hi, k)[0] > k:
                        break
                else:
                    starts.setdefault(n, set()).add(zero)
        out = []
        for n, where in starts.items():
            item, found, over = self.items[n], [], -1
            k, m = item.k, len(item.text)
            todo = sorted(where)
            i = 0
            while i < len(todo):  # places whose windows overlap are verified together, in stretches of bounded length
                j = i
                while j + 1 < len(todo) and todo[j + 1] - todo[i] <= 2 * k:
                    j += 1
                lo, hi = max(0, todo[i] - k), todo[j] + m + k
                if k:
                    d, end = item.distance(text[lo:hi])
                    end += lo
                else:
                    d, end = 0, self._exact(text, item.text, lo, hi)
                if d <= k and end >= 0:
                    if not found or end - over > m // 2:
                        found.append((d, end))
                        over = end
                    elif d < found[-1][0]:
                        found[-1] = (d, end)
                i = j + 1
            if found:
                d, end = min(found)
                out.append((item.key, d, end, len(found)))
        return out

    @staticmethod
    def _exact(text: str, item: str, lo: int, hi: int) -> int:
        """Where the first exact place of text[lo:hi] ends that begins and ends at a word's border, so that short items don't match within words. -1: there is none."""
        at = text.find(item, lo, hi)
        while at >= 0:
            end = at + len(item)
            if (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
                return end
            at = text.find(item, at + 1, hi)
        return -1


RESULT = T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("distance", "place", "places")]])


def _passes(benchmark: DataFrame, items_per_pass: int) -> Iterator[Broadcast]:
    """The items (item_id, text), about ``items_per_pass`` at a time: a bounded broadcast each."""
    n = max(1, -(-benchmark.count() // items_per_pass))
    for p in range(n):
        mine = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).select("item_id", "text").distinct()
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in mine.toLocalIterator()])


def contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id, distance, place, places): each document in which a test item occurs within its budget.

    Whole texts are searched for all items. ``place`` is where the nearest place ends in the
    normalised text; ``places`` counts the distinct ones. Items without a word (null, empty,
    punctuation) match nothing; documents without one have no rows; repeated rows of documents
    repeat their result; items that share an id are each matched. An item shorter than twice
    PIECE_LEAST letters must occur exactly, at word borders.

    Each pass holds at most about ``items_per_pass`` items, a bounded broadcast; texts don't move.
    All passes' items are on the driver: a benchmark must fit there.
    """
    out = None
    for items in _passes(benchmark, items_per_pass):

        def make(items=items):
            matcher = Matcher(items.value, rate)

            def work(texts: list[str]):
                hits = [(i, hit) for i, t in enumerate(texts) for hit in matcher.find(t)]
                return [i for i, _ in hits], [[hit[k] for _, hit in hits] for k in range(len(RESULT))]

            return work

        found = map_texts(documents, ["doc_id"], RESULT, make)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """``documents`` without those in which a test item occurs. A filter: nothing is joined, and no text moves.

    Null, empty and wordless texts stay, as do all rows if the benchmark holds no word; repeated
    rows stay or go together; an empty table stays empty; other columns come back untouched.
    """
    for items in _passes(benchmark, items_per_pass):

        def make(items=items):
            matcher = Matcher(items.value, rate)
            return lambda text: not matcher.find(text)

        documents = filter_texts(documents, make)
    return materialise_texts(documents)


# ---- queries ----


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item within its error budget."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES: dict[str, str] = {}
