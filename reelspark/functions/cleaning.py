"""Cleaning of catalogue fields: durations, flags, lists, ratings, names, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of ratings and what they become.
RATINGS = {"7": "7세이상관람가", "12": "12세이상관람가", "12세이상": "12세이상관람가", "15": "15세이상관람가", "15세이상": "15세이상관람가", "19": "청소년관람불가"}
#: Ratings that count as valid.
VALID_RATINGS = ("전체관람가", "7세이상관람가", "12세이상관람가", "14세이상관람가", "15세이상관람가", "18세이상관람가", "청소년관람불가", "G", "PG", "PG-13", "R", "NC-17")
#: Trust in a source before its format is checked.
SOURCE_TRUST = {"IMDB": 0.92, "WIKIPEDIA": 0.80, "KMRB": 0.97, "FALLBACK": 0.60}
#: Fixed value: letters a person's name may have.
NAME = r"^[가-힣一-鿿a-zA-Z0-9\s·\-.']+$"


def mapping(table: dict) -> Column:
    """A small fixed table as a map literal."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def duration_seconds(text: Column) -> Column:
    """HH:MM or HH:MM:SS in seconds; anything else is 0."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.coalesce(parts.getItem(i).try_cast("int"), F.lit(None))
    total = number(0) * 3600 + number(1) * 60 + F.when(F.size(parts) == 3, number(2)).otherwise(0)
    return F.coalesce(F.when(F.size(parts).isin(2, 3), total), F.lit(0))


def duration_or_null(text: Column) -> Column:
    """As duration_seconds, with null for what isn't a positive duration."""
    return F.nullif(duration_seconds(text), F.lit(0))


def yes_no(text: Column) -> Column:
    """Y and N as a boolean; anything else is null."""
    letter = F.upper(F.trim(text))
    return F.when(letter == "Y", True).when(letter == "N", False)


def placeholder_to_null(text: Column) -> Column:
    """Empty text and a lone dash say nothing."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin("", "-"), trimmed)


def unit_range(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def percent(fraction: Column) -> Column:
    """Whole percent, half to even, 100 at most."""
    return F.least(F.bround(fraction * 100).cast("int"), F.lit(100))


def json_names(text: Column) -> Column:
    """A JSON array of names, trimmed, without empty ones; invalid JSON is an empty list."""
    parsed = F.from_json(text, T.ArrayType(T.StringType()))
    return F.coalesce(F.filter(F.transform(parsed, lambda n: F.trim(n)), lambda n: n != ""), F.array().cast("array<string>"))


def comma_names(text: Column) -> Column:
    """A comma-separated list, trimmed, without empty parts."""
    return F.coalesce(F.filter(F.transform(F.split(text, ","), lambda n: F.trim(n)), lambda n: n != ""), F.array().cast("array<string>"))


def detail_genres(text: Column, blacklist: tuple[str, ...] = ()) -> Column:
    """Detail genres as a list; channel and package names, and what starts with (HD), give none."""
    trimmed = F.trim(text)
    bad = trimmed.startswith("(HD)") | (trimmed.isin(*blacklist) if blacklist else F.lit(False))
    return F.when(bad, F.array().cast("array<string>")).otherwise(comma_names(trimmed))


def normal_rating(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", F.coalesce(F.element_at(mapping(RATINGS), trimmed), trimmed))


def item_confidence(votes: Column, average: Column, most_votes: int = 40_000, default: float = 0.1) -> Column:
    """How well known and liked an item is, 0 to 1; the default without votes."""
    known = F.log1p(votes) / F.log(F.lit(float(most_votes + 1)))
    return F.when((votes > 0) & (average > 0), F.round(F.least(known * average / 10.0, F.lit(1.0)), 6)).otherwise(default)


def freshness(released: Column, as_of: Column, days: int = 365) -> Column:
    """1 on the day of release, falling to 0 within ``days``; 0 without a date."""
    return F.coalesce(F.greatest(1 - F.datediff(as_of, released) / days, F.lit(0.0)), F.lit(0.0))


def valid_name(name: Column) -> Column:
    trimmed = F.trim(name)
    return F.coalesce(F.length(trimmed).between(2, 40) & trimmed.rlike(NAME), F.lit(False))


def valid_cast(names: Column) -> Column:
    return F.coalesce(F.size(names).between(1, 5) & F.forall(names, valid_name), F.lit(False))


def valid_rating(text: Column) -> Column:
    return F.coalesce(F.trim(text).isin(*VALID_RATINGS), F.lit(False))


def valid_date(text: Column) -> Column:
    """YYYY-MM-DD, a day of the calendar, 1900 to 2030."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.year(day).between(1900, 2030), F.lit(False))


def field_confidence(value_ok: Column, source: Column) -> Column:
    """Trust in a source, a little more if the value's format fits, less if not."""
    base = F.coalesce(F.element_at(mapping(SOURCE_TRUST), F.upper(source)), F.lit(0.50))
    return F.round(unit_range(base + F.when(value_ok, 0.05).otherwise(-0.10)), 3)


def lead_and_guests(names: Column, leads: int = 4) -> tuple[Column, Column]:
    """The first few of a cast, comma-joined, and the others."""
    return F.array_join(F.slice(names, 1, leads), ", "), F.array_join(F.slice(names, leads + 1, 1_000_000), ", ")


def date_label(day: Column) -> Column:
    """Month, day and day of the week, as M월 d일(요일)."""
    names = F.array(*[F.lit(x) for x in "월화수목금토일"])
    return F.concat(F.month(day).cast("string"), F.lit("월 "), F.dayofmonth(day).cast("string"), F.lit("일("), F.element_at(names, F.weekday(day) + 1), F.lit(")"))


def item_text(fields: list[tuple[str, Column]], released: Column) -> Column:
    """One text of all filled fields, each with its label, and the year."""
    parts = [F.when(value != "", F.concat(F.lit(f"{label}: " if label else ""), value)) for label, value in fields]
    return F.concat_ws(" ", *parts, F.year(released).cast("string"))


def completeness(fields: list[Column]) -> Column:
    """How many of the fields are filled."""
    return reduce(lambda a, b: a + b, [F.when(f.isNotNull() & (f.cast("string") != ""), 1).otherwise(0) for f in fields])


def media_class(kind: Column, genres: Column) -> Column:
    """Class of an item by media kind and genres; the first rule that fits."""
    has = lambda *names: F.arrays_overlap(genres, F.array(*[F.lit(n) for n in names]))
    return F.when(kind == "movie", "영화").when(has("Animation", "애니메이션"), "TV애니메이션").when(has("Reality", "Talk", "예능"), "TV 연예/오락").when(has("Documentary", "다큐멘터리"), "다큐").otherwise("TV드라마")


def asset_url(path: Column, host: str) -> Column:
    """A path as a URL below ``host``: parts encoded, slashes kept; what is a URL already stays."""
    encoded = F.regexp_replace(F.regexp_replace(F.url_encode(path), "%2F", "/"), r"\+", "%20")
    return F.when(path.startswith("http"), path).when(path.isNotNull(), F.concat(F.lit(host.rstrip("/") + "/"), encoded))


def deterministic_id(name: Column, provider: str = "yt") -> Column:
    """provider|first 16 letters of the name's SHA-256."""
    return F.concat(F.lit(f"{provider}|"), F.substring(F.sha2(name, 256), 1, 16))
