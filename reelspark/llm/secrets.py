"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions near the hits, checksums last.

One automaton finds all keywords of all kinds in a lower-cased text. A kind's expression is then
tried only at its keywords' hits, anchored there. Hexadecimal runs have no keyword: their expression
runs over the whole text. Kinds whose tokens embed a checksum are kept only if it holds.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import map_texts, materialise_texts, read_table

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc32_base62_holds(token: str) -> bool:
    """The last six letters are the base-62 CRC-32 of the thirty before them, as in prefixed access tokens."""
    body, check = token[token.index("_") + 1 : -6], token[-6:]
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def luhn_holds(number: str) -> bool:
    """The Luhn check of a card number, ignoring spaces and dashes."""
    digits = [int(c) for c in number if c in "0123456789"][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0 and len(set(digits)) > 1


@dataclass(frozen=True)
class Kind:
    """A kind of secret: keywords (lower case), what to match at a hit, and what a match must pass."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    after: int = 0  # if over 0, a match may start up to this many letters after the keyword's start, instead of matching at it
    most: int = 0  # where after is over 0: letters of the longest match, with what it looks ahead at
    until: str | None = None  # a match goes on to the end of the next match of this, unless another keyword comes before
    base: bool = False


HEX_LEAST = 24

#: The kinds in their order. Base kinds follow the fixed definitions of the scan; the others verify a checksum or a form.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6, base=True),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, base=True),
    Kind("hex", (), r"[0-9a-f]+", lambda m: len(m[0]) >= HEX_LEAST, base=True),
    Kind("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: crc32_base62_holds(m[0])),
    Kind("card", ("card", "visa", "mastercard"), r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", lambda m: luhn_holds(m[0]), after=64, most=38),
    Kind("pem", ("-----begin ",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", until=r"-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
)

_lower_ascii = {c: c + 32 for c in range(65, 91)}


class Scanner:
    """Finds the spans of all kinds in a text. Built once in each Python worker."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern) for k in kinds]
        self.automaton = ahocorasick.Automaton()
        for n, kind in enumerate(kinds):
            for word in kind.keywords:
                of = self.automaton.get(word, (len(word), ()))[1]
                self.automaton.add_word(word, (len(word), (*of, n)))
        self.automaton.make_automaton()
        self.untils = [re.compile(k.until) if k.until else None for k in kinds]
        self.hex_kind = next((n for n, k in enumerate(kinds) if not k.keywords), None)
        self.hex_runs = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) in code points, by start, then kind."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = text.translate(_lower_ascii)
        hits: dict[int, list[int]] = {}
        for end, (length, kinds) in self.automaton.iter(low):
            for n in kinds:
                hits.setdefault(n, []).append(end + 1 - length)
        out = []
        for n, starts in hits.items():
            starts.sort()
            out += self._near(text, n, starts) if self.kinds[n].after else self._at(text, n, starts)
        if self.hex_kind is not None:
            out += [(m.start(), self.hex_kind, m.end()) for m in self.hex_runs.finditer(text)]
        out.sort()
        return out

    def _at(self, text: str, n: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
        """Matches that begin at a keyword."""
        kind, over = self.kinds[n], 0
        ends = [m.end() for m in self.untils[n].finditer(text)] if self.untils[n] else []
        for k, at in enumerate(starts):
            if at < over:
                continue  # within the match before
            if m := self.patterns[n].match(text, at):
                over = m.end()
                if (e := bisect.bisect_left(ends, over)) < len(ends) and not (k + 1 < len(starts) and starts[k + 1] < ends[e]):
                    over = ends[e]
                if kind.keep(m):
                    yield at, n, over

    def _near(self, text: str, n: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
        """Matches that begin within reach of a keyword: every place is tried until one is kept.

        No more of the text is searched for a keyword than matches in its reach can cover, and no place is matched twice.
        """
        kind, over, tried = self.kinds[n], 0, 0
        for at in starts:
            pos, reach = max(at, over, tried), at + kind.after
            while pos <= reach and (m := self.patterns[n].search(text, pos, reach + kind.most)) and m.start() <= reach:
                if kind.keep(m):
                    yield m.start(), n, m.end()
                    pos = over = m.end()
                else:
                    pos = tried = m.start() + 1


def _joined(spans: list[tuple[int, int, int]], kinds: tuple[Kind, ...]) -> str:
    return ",".join(f"{kinds[n].name}:{s}:{e}" for s, n, e in spans)


def scan(documents: DataFrame, keep: list[str] | None = None, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The columns ``keep`` (default: all) and what the scan of the whole text found.

    Adds a count ``n_<kind>`` for each base kind, ``base_spans`` and ``spans`` (kind:start:end,
    comma-joined, by start, then kind). Null and empty texts have no spans. Every row stays,
    repeated ones too; columns named like the added ones are replaced.
    """
    base = [n for n, k in enumerate(kinds) if k.base]
    added = T.StructType([*[T.StructField(f"n_{kinds[n].name}", T.LongType()) for n in base], T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])
    keep = [c for c in (documents.columns if keep is None else keep) if c not in added.fieldNames()]

    def make():
        scanner = Scanner(kinds)

        def work(texts: list[str]):
            found = [scanner.spans(t) for t in texts]
            counts = [[sum(k == n for _, k, _ in f) for f in found] for n in base]
            return None, [*counts, [_joined([x for x in f if x[1] in base], kinds) for f in found], [_joined(f, kinds) for f in found]]

        return work

    return map_texts(documents, keep, added, make)


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, over = [], 0
    for start, _, end in spans:
        if start >= over:
            out += [text[over:start], mark]
        over = max(over, end)
    return "".join([*out, text[over:]])


def redact_secrets(documents: DataFrame, mark: str = "[SECRET]", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``documents`` with each found secret replaced by ``mark``; n_chars follows where a text changed.

    No row goes, repeated ones stay, null and empty texts stay as they are, an empty table stays
    empty, and other columns come back untouched, whatever their names.
    """
    name = "__new"
    while name in documents.columns:
        name += "_"
    added = T.StructType([T.StructField(name, T.StringType())])  # null where nothing was found

    def make():
        scanner = Scanner(kinds)
        return lambda texts: (None, [[_redacted(t, found, mark) if (found := scanner.spans(t)) else None for t in texts]])

    new, columns = F.col(name), {"text": F.coalesce(name, "text")}
    if "n_chars" in documents.columns:
        columns["n_chars"] = F.when(new.isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(documents.schema["n_chars"].dataType)
    return materialise_texts(map_texts(documents, documents.columns, added, make).withColumns(columns).select(*[F.col(f"`{c}`") for c in documents.columns]))


# ---- queries ----


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts of the base kinds, a digest of the base spans, and all spans."""
    found = scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
