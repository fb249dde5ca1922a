"""Repair of catalogue text: genres, names, sentences, search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.cleaning import comma_names, json_names, mapping
from reelspark.functions.titles import series_name

#: Fixed values, to find equal names: how a synopsis names its guests, in the order in which they count. The first gives a list, the others names.
GUESTS = r"(?:특별\s*)?게스트\s*[:\-]?\s*([가-힣A-Za-z0-9\s,·&X×]+?)(?:[。.!?\n(]|$)"
GUEST_PATTERNS = (
    r"특별\s*출연\s*[:\-]?\s*([가-힣]{2,4})",
    r"(?:배우|가수|개그맨|방송인|모델|운동선수|아이돌|MC|래퍼|코미디언|탤런트)\s+([가-힣]{2,4})",
    r"([가-힣]{2,4})(?:이|가)\s+(?:출연|등장|방문|합류|전격\s*합류|특별출연)",
    r"([가-힣]{2,4})[X×&]\s*([가-힣]{2,4})",
    r"(?:고수|달인|스타|셰프|요리사)\s+([가-힣]{2,4})",
    r"([가-힣]{2,4})(?:이|가|은|는|의|와|과|도|을|를)\s+(?:출연|등장|방문|합류|초대|진행|참여|함께|소개|이야기|준비)",
)
#: Particles, family names that make a word a person, and words that are none.
PARTICLES = "이가은는을를의도와과에서로"
FAMILY_NAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구나민진지엄채원천방공현함변염여추도소석선설마길봉시형"
NO_NAMES = (
    "오늘 이번 지난 다음 그날 매주 매일 처음 출연 게스트 방송 특집 편집 에피 시리즈 스튜디오 무대 현장 이야기 준비 진행 특별 연예 오락 예능 드라마 영화 프로그램 리얼리티 "
    "여성 남성 어린이 어른 노인 청년 커플 한국 서울 부산 미국 중국 일본 음악 노래 댄스 춤 요리 여행 토크 결승 예선 미션 라운드 시즌"
).split()


def keyword_genre(text: Column, rules: list[tuple[str, list[str]]], ambiguous: list[tuple[str, str]] = ()) -> tuple[Column, Column, Column]:
    """(genre, method, keyword): the first rule with a keyword in the text; two keywords that contradict each other settle nothing."""
    clash = F.lit(False)
    for a, b in ambiguous:
        clash = clash | (F.contains(text, F.lit(a)) & F.contains(text, F.lit(b)))
    found = F.filter(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(k).alias("k")) for g, words in rules for k in words]), lambda r: F.contains(text, r.k))
    first = F.try_element_at(found, F.lit(1))
    method = F.when(clash, "ambiguous").when(F.size(found) > 0, "keyword").otherwise("unresolved")
    return F.when(~clash, first.getField("g")), method, F.when(~clash, first.getField("k"))


def remap_genre(items: DataFrame, by_detail: dict[str, str], by_class: dict[str, str]) -> DataFrame:
    """Genres by detail genre, else by class, else as they are."""
    return items.withColumn("genre", F.coalesce(F.element_at(mapping(by_detail), F.col("genre_detail")), F.element_at(mapping(by_class), F.col("ct_cl")), F.col("genre")))


def guest_names(text: Column, most: int = 8) -> Column:
    """Names that a synopsis gives to guests: by a list behind their label, then by each further pattern; in order, once each, ``most`` at most.

    Up to two particles come off the end; words of two to four syllables stay, if they begin with a family name and are no stop words. None of a null text.
    """
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit("(?U)" + pattern), group)
    listed = F.flatten(F.transform(found(GUESTS, 1), lambda r: F.split(r, r"(?U)[,·\s&X×]+")))
    single = []
    for pattern in GUEST_PATTERNS:
        groups = [found(pattern, g + 1) for g in range(pattern.count("([가-힣]"))]
        single.append(groups[0] if len(groups) == 1 else F.flatten(F.zip_with(*groups, lambda x, y: F.array(x, y))))
    bare = F.transform(F.concat(listed, *single), lambda n: F.regexp_replace(n, f"[{PARTICLES}]{{1,2}}$", ""))
    person = lambda n: n.rlike(f"^[{FAMILY_NAMES}][가-힣]{{1,3}}$") & ~n.isin(*NO_NAMES)
    return F.slice(F.array_distinct(F.filter(bare, person)), 1, most)


def romanised_name(text: Column, syllables: dict[str, str]) -> Column:
    """A romanised name in Hangul by a table of syllables; null if any is unknown."""
    parts = F.filter(F.split(F.lower(text), r"[\s\-]+"), lambda p: p != "")
    out = F.transform(parts, lambda p: F.element_at(mapping(syllables), p))
    return F.when((F.size(parts) > 0) & F.forall(out, lambda s: s.isNotNull()), F.array_join(out, ""))


def replace_names(names: Column, table: dict[str, str]) -> Column:
    """A comma-separated list with names replaced; one that comes twice then stays once."""
    return F.array_join(F.array_distinct(F.transform(comma_names(names), lambda n: F.coalesce(F.element_at(mapping(table), n), n))), ", ")


#: Categories of tags that name people.
PEOPLE = ("director", "actor_lead", "actor_guest")


def rename_people(items: DataFrame, tags: DataFrame, preferences: DataFrame, table: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, tags, preferences) with people renamed throughout; rows whose keys become equal are one then.

    ``items``: director (comma-separated), cast_lead and cast_guest (JSON lists); a name that a list
    then has twice stays once. ``tags``: item_id, category, value, confidence, of which equal keys keep the largest confidence.
    ``preferences``: user_id, category, value, affinity, watch_count, of which equal keys keep the
    largest affinity and add up their counts. Only tags that name people are renamed; nulls stay. Names are replaced
    once: a new name that is an old one of another entry is left alone.
    """
    def listed(column: str) -> Column:
        names = F.array_distinct(F.transform(json_names(F.col(column)), lambda n: F.coalesce(F.element_at(mapping(table), n), n)))
        return F.when(F.coalesce(F.size(names) > 0, F.lit(False)), F.to_json(names)).otherwise(F.col(column))  # what isn't a list stays

    renamed = items.withColumns({"director": F.when(F.col("director").isNotNull(), replace_names(F.col("director"), table)), **{c: listed(c) for c in ("cast_lead", "cast_guest")}})
    value = F.when(F.col("category").isin(*PEOPLE), F.coalesce(F.element_at(mapping(table), F.col("value")), F.col("value"))).otherwise(F.col("value"))
    of_items = tags.withColumn("value", value).groupBy("item_id", "category", "value").agg(F.max("confidence").alias("confidence"))
    of_users = preferences.withColumn("value", value).groupBy("user_id", "category", "value").agg(F.max("affinity").alias("affinity"), F.sum("watch_count").alias("watch_count"))
    return renamed, of_items, of_users


def sentence_flags(sentence: Column, synopsis: Column, banned: list[str], least: int = 20, most: int = 80, overlap: float = 0.3) -> Column:
    """What speaks against a generated sentence: its length, banned words, markup, and too much taken from the synopsis."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
    a, b = grams(sentence), grams(synopsis)
    shared = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    checks = [("length", ~F.length(sentence).between(least, most)), ("banned", sentence.rlike("|".join(banned))), ("markup", sentence.rlike("<[^>]+>")), ("copied", shared > overlap)]
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks]))


def search_queries(title: Column, film: Column) -> Column:
    """What to search a trailer by, for films and for series, distinct and in order."""
    name = series_name(title)
    return F.when(film, F.array_distinct(F.array(name, F.concat(name, F.lit(" trailer"))))).otherwise(F.array_distinct(F.array(title, name, F.concat(name, F.lit(" preview")))))


def tone_allowed(rating: Column, segment: Column, barred: dict[int, tuple[str, ...]]) -> Column:
    """Whether a segment may be shown sentences for items of that rating."""
    out = F.lit(True)
    for s, ratings in barred.items():
        out = out & ~((segment == s) & rating.isin(*ratings))
    return F.coalesce(out, F.lit(True))


def backfill_list(items: DataFrame, columns: list[str]) -> DataFrame:
    """The items that lack any of the columns."""
    return items.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) == 1)


def unify(rows: DataFrame, column: str, spellings: dict[str, str]) -> DataFrame:
    """``rows`` with patterns of one column's values replaced, in order, and ``residual``: whether a pattern is still found (none should be)."""
    value = F.col(column)
    for pattern, to in spellings.items():
        value = F.regexp_replace(value, pattern, to)
    left = F.lit(False)
    for pattern in spellings:
        left = left | F.coalesce(value.rlike(pattern), F.lit(False))
    return rows.withColumns({column: value, "residual": left})


def merge_guests(items: DataFrame, from_text: DataFrame, by_episode: DataFrame, by_series: DataFrame, per_episode: Column) -> DataFrame:
    """(item_id, guests, source): names found in an item's text first; else those of its episode, where ``per_episode`` holds for its class, or else of its series.

    ``items``: item_id, series_nm, episode_no and what ``per_episode`` reads; ``from_text``: item_id,
    name; ``by_episode``: series_nm, episode_no, name; ``by_series``: series_nm, name. Names come once, sorted.
    """
    names = lambda rows, keys, name: rows.groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias(name))
    rows = items.join(names(from_text, ["item_id"], "_t"), "item_id", "left").join(names(by_episode, ["series_nm", "episode_no"], "_e"), ["series_nm", "episode_no"], "left").join(names(by_series, ["series_nm"], "_s"), "series_nm", "left")
    other, kind = F.when(per_episode, F.col("_e")).otherwise(F.col("_s")), F.when(per_episode, "episode").otherwise("series")
    return rows.select("item_id", F.coalesce("_t", other).alias("guests"), F.when(F.col("_t").isNotNull(), "text").when(other.isNotNull(), kind).alias("source"))


def sentence_lookup(asked: DataFrame, sentences: DataFrame, default: int) -> DataFrame:
    """(item_id, segment, sentence_id): the first sentence of an item for a segment, or else for the default segment.

    ``asked``: item_id, segment; ``sentences``: item_id, segment, sentence_id.
    """
    firsts = sentences.groupBy("item_id", "segment").agg(F.min("sentence_id").alias("sentence_id"))
    own = asked.join(firsts, ["item_id", "segment"], "left")
    spare = firsts.filter(F.col("segment") == default).select("item_id", F.col("sentence_id").alias("_d"))
    return own.join(spare, "item_id", "left").withColumn("sentence_id", F.coalesce("sentence_id", "_d")).drop("_d").filter("sentence_id IS NOT NULL")
