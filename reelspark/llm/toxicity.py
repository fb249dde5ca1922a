"""Toxicity by a learned lexicon that is matched with Levenshtein automata.

The lexicon is learned from labelled documents: words, and stems with many endings, that stand in
toxic documents in many contexts and hardly ever in clean ones. A trie of its words is intersected
with a Levenshtein automaton, so one walk over a word's letters finds every term within one edit
(long words) or none (short words). A hit counts less if its context window shows a quotation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import TEXT_ROWS, batches_of, bounded_sample, filter_texts, map_texts, materialise, materialise_texts, nonnull_text, read_table

#: Labelled documents that the lexicon is learned from at most (chosen by a hash of doc_id).
FIT_ROWS = 20_000
#: Distinct contexts in toxic documents that a term needs, and how much likelier it must be there.
SUPPORT, LIFT = 5, 20.0
#: Share of a term's documents that must be toxic.
PRECISION = 0.9
#: Words of clean documents within an edit of a term from which on it must be spelt exactly.
NEIGHBOURS = 3
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Distinct endings that make a stem a term, and the share of its uses that one word may have.
STEM_ENDINGS, STEM_SHARE = 8, 0.3
#: Words of at least this many letters may have one edit.
EDIT_LENGTH = 5
#: Words on each side that tell a quotation from abuse, and what a hit counts then.
WINDOW, QUOTED, REPORTED, MISSPELT = 6, 0.25, 0.7, 0.9
#: Words whose weights a task keeps, the letters of the longest that it keeps, and the states of its automaton at most.
CACHED_WORDS, CACHED_LETTERS, STATES_MOST = 300_000, 64, 100_000
#: Word pairs that a task counts at once while it learns.
PAIRS_HELD = 50_000

#: Marks of a quotation, and words that report one.
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
REPORTING = frozenset("said says say called calling quote quoted wrote term word words dit écrit sagte schrieb wort dijo palabra".split())

_words = re.compile(r"[^\W_]+")
_leet = str.maketrans("013457@$", "oieastas")  # fixed values: signs that stand for letters
_like = frozenset("013457@$")


def learnable(doc_id: Column) -> Column:
    """False for the held-out fifth: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0, F.lit(True))


class Automaton:
    """A trie of terms intersected with a Levenshtein automaton, made deterministic as it is used.

    A state is the set of (trie node, edits so far) that some alignment has reached.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.deepest = [0]  # length of the longest word below a node: edits are for long words only
        for term, ends in [*((w, self.word_at) for w in words), *((s, self.stem_at) for s in stems)]:
            node = 0
            for c in term:
                if ends is self.word_at:
                    self.deepest[node] = max(self.deepest[node], len(term))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.deepest.append(0)
                node = self.children[node][c]
            if ends is self.word_at:
                self.deepest[node] = max(self.deepest[node], len(term))
            ends[node] = term
        self._forget()

    def _forget(self) -> None:
        """Start over without the states made so far, so that their number stays bounded."""
        #: By state: its set, the word and edits it accepts, the stem it has completed, and its next states by letter.
        self.states: list[frozenset] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.completes: list[str | None] = []
        self.following: list[dict[str, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """With the letters that an edit leaves out."""
        out = set(state)
        for node, edits in state:
            if edits == 0 and self.deepest[node] >= EDIT_LENGTH:
                out |= {(child, 1) for child in self.children[node].values() if self.deepest[child]}
        return frozenset(out)

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            words = [(edits, self.word_at[node]) for node, edits in state if node in self.word_at and (edits == 0 or len(self.word_at[node]) >= EDIT_LENGTH)]
            self.accepts.append(min(words)[::-1] if words else None)
            self.completes.append(next((self.stem_at[node] for node, edits in state if edits == 0 and node in self.stem_at), None))
            self.following.append({})
        return self.numbers[state]

    def _step(self, number: int, letter: str) -> int:
        out = set()
        for node, edits in self.states[number]:
            child = self.children[node].get(letter)
            if child is not None:
                out.add((child, edits))
            if edits == 0 and self.deepest[node] >= EDIT_LENGTH:
                out.add((node, 1))  # a letter too many
                out |= {(x, 1) for x in self.children[node].values() if self.deepest[x]}  # another letter
        after = self._number(self._closed(out)) if out else -1
        self.following[number][letter] = after
        return after

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term of the word and its edits; a stem fits whole, at the word's start."""
        if len(self.states) > STATES_MOST:
            self._forget()
        state, stem = self.start, None
        for c in word:
            after = self.following[state].get(c)
            if after is None:
                after = self._step(state, c)
            if after < 0:
                return (stem, 0) if stem else None
            state = after
            stem = self.completes[state] or stem
        found = self.accepts[state]
        return (stem, 0) if stem and (found is None or found[1]) else found


@dataclass
class Lexicon:
    """What was learned: the chance of toxicity that a term brings; words near a term that clean documents use; terms near which such words abound; the chance without a hit."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()
    exact: frozenset[str] = frozenset()
    base: float = 0.05


class Scorer:
    """Scores whole texts. Built once in each Python worker; words are looked up once and kept, in bounded number."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = Automaton(sorted(lexicon.words), sorted(lexicon.stems))
        self.chance = lexicon.words | lexicon.stems
        outer = self

        class Kept(dict):
            def __missing__(self, token: str) -> float:
                weight = outer.weight(token)
                if len(token) <= CACHED_LETTERS:
                    if len(self) >= CACHED_WORDS:
                        self.clear()
                    self[token] = weight
                return weight

        self.kept = Kept()

    def matches(self, token: str) -> Iterator[tuple[str, str, int]]:
        """(form, term, edits) of each word in a stretch between spaces, plain and with look-alike letters undone."""
        forms = [token] if token.isalpha() else _words.findall(token)
        if not _like.isdisjoint(token) and not token.isdigit():
            forms += _words.findall(token.translate(_leet))
        for form in forms:
            if (hit := self.automaton.match(form)) and not (hit[1] and (form in self.lexicon.harmless or hit[0] in self.lexicon.exact)):
                yield form, *hit

    def weight(self, token: str) -> float:
        return max((self.chance[term] * (MISSPELT if edits or form not in token else 1.0) for form, term, edits in self.matches(token)), default=0.0)

    def score(self, text: str) -> float:
        tokens = text.lower().split()
        weights = list(map(self.kept.__getitem__, tokens))
        if not any(weights):
            return self.lexicon.base
        clean = 1.0 - self.lexicon.base
        for i, w in enumerate(weights):
            if w:
                clean *= 1.0 - w * self.context(tokens, i)
        return 1.0 - clean

    @staticmethod
    def context(tokens: list[str], i: int) -> float:
        """1 for plain abuse, less within quotation marks or near a word that reports speech."""
        before, after = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
        opened = next((k for k in range(len(before) - 1, -1, -1) if before[k][0] in OPENING), None)
        if opened is not None and not any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in before[opened:-1] if t.rstrip(".,;:!?")) and any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in after if len(t) > 1 and t.rstrip(".,;:!?")):
            return QUOTED
        if any(t.strip(".,;:!?") in REPORTING for t in [*before[:-1], *after[1:]]):
            return REPORTED
        return 1.0


def learn_lexicon(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, unlearnt: Column | None = None) -> Lexicon:
    """Learn from the documents that ``labels`` (doc_id, toxic) marks, leaving out the held-out fifth.

    Only doc_id joins the two; texts are all that is learned from. Equal texts count once; labels
    that are null, or contradict each other for one id, count as toxic if any says so. Without
    both classes the lexicon is empty. ``unlearnt`` leaves out further documents by their doc_id,
    to choose parameters on.

    Terms and words near them come to the driver: no more of them than words in the sample of
    ``fit_rows`` texts, whatever the corpus.
    """
    with batches_of(documents.sparkSession, TEXT_ROWS):
        return _learnt(documents, labels, fit_rows, unlearnt)


def _learnt(documents: DataFrame, labels: DataFrame, fit_rows: int, unlearnt: Column | None) -> Lexicon:
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(learnable(F.col("doc_id")))
    if unlearnt is not None:
        marked = marked.filter(~unlearnt)
    marked = bounded_sample(marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")), "doc_id", fit_rows)
    sample = documents.select("doc_id", nonnull_text().alias("text")).join(F.broadcast(marked), "doc_id").select("text", "y")
    sample = materialise(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.max("text").alias("text"), F.max("y").alias("y")).select("text", "y"))
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(n) < 2:
        return Lexicon()

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each word with the word before it, once in a text. Handed on in parts of bounded size: Spark adds them up."""
        out: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                words = _words.findall(text.lower())
                out.update({(w, hash_of(p), y) for p, w in zip(["", *words], words) if len(w) >= 3})
                if len(out) >= PAIRS_HELD:
                    yield pd.DataFrame([(*k, c) for k, c in out.items()], columns=["word", "before", "y", "docs"])
                    out = Counter()
        yield pd.DataFrame([(*k, c) for k, c in out.items()], columns=["word", "before", "y", "docs"])

    # by word: documents of each class, and distinct contexts in toxic ones (near copies share theirs)
    pairs = sample.mapInPandas(contexts, "word string, before long, y int, docs long").groupBy("word", "before").agg(F.sum(F.when(F.col("y") == 1, F.col("docs")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("docs")).otherwise(0)).alias("c"))
    words = materialise(pairs.groupBy("word").agg(F.sum(F.least("t", F.lit(1))).alias("support"), F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t > 0 OR c > 0"))
    rate = lambda x, k: (F.col(x) + 0.5) / (n[k] + 1.0)
    precision = (F.col("t") + 0.5) / (F.col("t") + F.col("c") + 1.0)
    lifted = (F.col("support") >= SUPPORT) & (rate("t", 1) / rate("c", 0) >= LIFT) & (precision >= PRECISION)
    stems = words.filter(F.length("word") > min(STEM_LENGTHS)).select("word", "support", "t", "c", F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEM_LENGTHS])).alias("stem")).filter("stem IS NOT NULL")
    stems = stems.groupBy("stem").agg(F.sum("support").alias("support"), F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") > 0).cast("int")).alias("endings"), F.max("t").alias("most"))
    stems = stems.filter(lifted & (F.col("endings") >= STEM_ENDINGS) & (F.col("most") <= STEM_SHARE * F.col("t"))).collect()
    found = words.filter(lifted).collect()
    chance = _chances(sample, frozenset(r["word"] for r in found), frozenset(r["stem"] for r in stems))
    chosen: dict[str, float] = {}
    for stem in sorted((r["stem"] for r in stems), key=lambda s: (len(s), s)):  # the shortest stem stands for its longer ones
        if chance.get((stem, True), 0.0) >= PRECISION and not any(stem.startswith(s) for s in chosen):
            chosen[stem] = chance[stem, True]
    kept = {w: chance[w, False] for r in found if chance.get((w := r["word"], False), 0.0) >= PRECISION and not any(w.startswith(s) for s in chosen)}
    lexicon = Lexicon(kept, chosen)
    # words within an edit of a term that clean documents use as well are words of their own
    automaton = Automaton(sorted(kept), sorted(chosen))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [automaton.match(w) for w in batch["word"]]
            out = batch.assign(term=[hit[0] if hit else None for hit in hits])
            yield out[[bool(hit and hit[1]) for hit in hits]]

    own = words.select("word", "support", "t", "c").mapInPandas(near, "word string, support long, t long, c long, term string")
    own = own.filter((F.col("c") > 0) & (rate("t", 1) / rate("c", 0) < LIFT)).groupBy("term").agg(F.collect_set("word").alias("words")).collect()
    lexicon.harmless = frozenset(w for r in own for w in r["words"])
    lexicon.exact = frozenset(r["term"] for r in own if len(r["words"]) >= NEIGHBOURS)
    # a term whose misspellings, where nothing else is found, stand in clean texts rather than toxic ones must be spelt exactly
    scorer = Scorer(lexicon)

    def misspelt_alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, y in zip(batch["text"], batch["y"], strict=True):
                hits = {(term, edits) for token in text.lower().split() if scorer.kept[token] for _, term, edits in scorer.matches(token)}
                if hits and all(edits for _, edits in hits):
                    out += [(term, y) for term, _ in hits]
            yield pd.DataFrame(out, columns=["term", "y"])

    alone = sample.mapInPandas(misspelt_alone, "term string, y int").groupBy("term").agg(F.sum((F.col("y") == 1).cast("long")).alias("t"), F.count(F.lit(1)).alias("n"))
    lexicon.exact |= {r["term"] for r in alone.collect() if (r["t"] + MISSPELT) / (r["n"] + 1.0) < 0.5}  # a row for each term at most
    # the chance of toxicity where nothing is found
    scorer = Scorer(replace(lexicon, base=0.0))

    def unfound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": [y for t, y in zip(batch["text"], batch["y"], strict=True) if not scorer.score(t)]})

    left = {r["y"]: r["count"] for r in sample.mapInPandas(unfound, "y int").groupBy("y").count().collect()}
    lexicon.base = min(0.4, (left.get(1, 0) + 0.5) / (sum(left.values()) + 1.0))
    return lexicon


def _chances(sample: DataFrame, words: frozenset[str], stems: frozenset[str]) -> dict[tuple[str, bool], float]:
    """By (term, whether it is a stem): the smoothed share of toxic texts among those of ``sample`` (text, y) that hold it.

    Contexts alone mislead: one text may bring many, and a term of few texts may stand in as many clean ones.
    """

    def holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                seen = set(_words.findall(text.lower()))
                hits = {(w, False, y) for w in seen & words} | {(s, True, y) for w in seen for k in STEM_LENGTHS if len(w) > k and (s := w[:k]) in stems}
                held.update(hits)
        yield pd.DataFrame([(*k, n) for k, n in held.items()], columns=["term", "stem", "y", "n"])

    counted = sample.mapInPandas(holders, "term string, stem boolean, y int, n long").groupBy("term", "stem")
    counted = counted.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n")).collect()  # a row for each candidate
    return {(r["term"], r["stem"]): (r["t"] + 0.5) / (r["n"] + 1.0) for r in counted}


def hash_of(word: str) -> int:
    """A hash that is the same in every worker."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) >> 1


def score_toxicity(documents: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``toxicity``, the chance (0 to 1) that the whole text is toxic.

    Null and empty texts get the chance of documents without a hit. Every row stays.
    """
    sent = documents.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        scorer = Scorer(sent.value)
        return lambda texts: (None, [[scorer.score(t) for t in texts]])

    return map_texts(documents, keep, T.StructType([T.StructField("toxicity", T.DoubleType())]), make)


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``documents`` without those whose toxicity is at least ``threshold``.

    Null and empty texts stay (they have no hit), as do all rows where no label teaches anything;
    repeated rows stay or go together; an empty table stays empty; other columns come back untouched.
    """
    sent = documents.sparkSession.sparkContext.broadcast(learn_lexicon(documents, labels))

    def make():
        scorer = Scorer(sent.value)
        return lambda text: scorer.score(text) < threshold

    return materialise_texts(filter_texts(documents, make))


# ---- queries ----


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned without the held-out fifth."""
    documents = read_table(spark, sf_dir, "documents")
    lexicon = learn_lexicon(documents, read_table(spark, sf_dir, "labels"))
    scored = score_toxicity(documents, lexicon, ["doc_id"])
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
