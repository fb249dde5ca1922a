"""From detection signals to advertising: keyword hits, item summaries, context verdicts, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.titles import keyword_hit
from reelspark.operators.ranking import top_per_group


def spot_keywords(texts: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """One row for each dictionary keyword in a text; a keyword within another one is left out where the longest of those is found too.

    ``dictionary``: keyword, category, hint: a bounded list that its caller keeps. Containment is
    settled within the dictionary, before any text is read.
    """
    a, b = dictionary.select(F.col("keyword").alias("short")), dictionary.select(F.col("keyword").alias("long"))
    holds = a.join(F.broadcast(b), F.contains(F.col("long"), F.col("short")) & (F.col("long") != F.col("short")))
    longest = holds.groupBy("short").agg(F.max(F.struct(F.length("long").alias("n"), F.col("long"))).alias("m")).select(F.col("short").alias("keyword"), F.col("m.long").alias("container"))
    terms = F.broadcast(dictionary.join(longest, "keyword", "left"))
    hits = texts.join(terms, F.contains(F.col(text), F.col("keyword"))).filter(keyword_hit(F.col(text), F.col("keyword")))
    hides = F.col("container").isNotNull() & F.contains(F.col(text), F.col("container"))
    return hits.filter(~F.coalesce(hides & keyword_hit(F.col(text), F.coalesce("container", F.lit("")))  , F.lit(False))).drop("container")


def context_verdict(frames: DataFrame, brand_negative: list[str], food_negative: list[str], cutoff: float, food: list[str], travel: list[str], travel_hits: int, food_labels: list[str], tableware: list[str]) -> DataFrame:
    """Frames with (context_valid, context_reason), the first rule that decides.

    ``frames``: category, labels (array of detected ones) and scores (array of structs concept, score, category).
    """
    top = F.element_at(F.array_sort(F.transform("scores", lambda s: F.struct((-s.score).alias("o"), s.concept.alias("c")))), 1).getField("c")
    any_of = lambda text, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))
    loud = lambda words: F.exists("scores", lambda s: (s.score >= cutoff) & (s.category != "negative") & any_of(s.concept, words))
    hits = F.size(F.filter("scores", lambda s: (s.category == F.col("category")) & (s.score >= cutoff - 0.04)))
    has = lambda labels: F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))
    is_food = F.col("category").isin(*food)
    reason = (
        F.when(any_of(top, brand_negative), "brand_safety").when(loud(brand_negative), "brand_safety_secondary")
        .when(F.col("category").isin(*travel) & (hits < travel_hits), "travel_and_condition").when(~is_food, "non_food_category")
        .when(any_of(top, food_negative), "context_blocked").when(loud(food_negative), "food_context_secondary")
        .when(has(food_labels) & ~has(tableware), "no_tableware_with_food").otherwise("eating_scene")
    )
    return frames.withColumn("context_reason", reason).withColumn("context_valid", F.col("context_reason").isin("non_food_category", "eating_scene"))


def item_summary(signals: DataFrame, bucketed: DataFrame, keywords: int = 3) -> DataFrame:
    """One row for each item: its signal kinds, most frequent ones, counts, and buckets with at least two kinds.

    ``bucketed`` as from signals.in_buckets.
    """
    n = signals.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = top_per_group(n, ["item_id"], [F.desc("n"), F.col("kind")], keywords)
    head = top.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind"))), lambda s: s.kind), ",").alias("top_kinds"))
    whole = n.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.sum("n").alias("signals"))
    multi = bucketed.groupBy("item_id", "bucket").agg(F.count_distinct("kind").alias("k")).filter("k >= 2").groupBy("item_id").agg(F.count(F.lit(1)).alias("multi_buckets"))
    return whole.join(head, "item_id").join(multi, "item_id", "left").select("item_id", "kinds", "top_kinds", "signals", F.coalesce("multi_buckets", F.lit(0)).cast("long").alias("multi_buckets"))


#: Endings of names of sights, and sights without one, as against towns.
SIGHT_ENDINGS = ("산", "사", "궁", "대교", "시장", "오일장", "해변", "해수욕장", "마을", "성", "봉", "폭포", "길", "공원")
SIGHTS = ("경기전", "객사", "태종대", "광안대교", "상당산성", "정선아리랑시장", "정선오일장", "한옥마을", "순천만")


def is_sight(place: Column) -> Column:
    """Whether a place is a sight rather than a town, by its name alone: a town that ends like one (부산) counts as one."""
    return place.isin(*SIGHTS) | place.rlike(f"({'|'.join(SIGHT_ENDINGS)})$")


def item_regions(items: DataFrame, mentions: DataFrame, stated: DataFrame, looked_at: int = 10, listed: int = 5) -> DataFrame:
    """(item_id, regions, region, basis): the places that an item names, most often named first, and the one that it is about.

    ``mentions``: item_id, place, source (spoken or written), at; ``stated``: item_id, place, from the
    item's own description. Ties go to what was spoken before what was written, then to the first
    mention. ``regions`` has ``listed`` of them. ``region`` is the stated place; else, of the ``looked_at``
    most named, the first town; else the first sight. ``basis`` tells which. An item without evidence has no
    region; null places don't count; of several stated places the first by name stands.
    """
    order = F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("place"))
    first = F.min(F.struct((F.col("source") != "spoken").alias("written"), F.col("at")))
    counted = mentions.filter("place IS NOT NULL").groupBy("item_id", "place").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    top = top_per_group(counted.withColumn("o", order), ["item_id"], [F.col("o")], looked_at)
    places = top.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place"))), lambda x: x["place"]).alias("_p"))
    said = stated.filter("place IS NOT NULL").groupBy("item_id").agg(F.min("place").alias("_s"))
    town = F.try_element_at(F.filter("_p", lambda p: ~is_sight(p)), F.lit(1))
    sight = F.try_element_at(F.filter("_p", is_sight), F.lit(1))
    rows = items.select("item_id").join(places, "item_id", "left").join(said, "item_id", "left")
    basis = F.when(F.col("_s").isNotNull(), "stated").when(town.isNotNull(), "town").when(sight.isNotNull(), "sight")
    return rows.select("item_id", F.coalesce(F.slice("_p", 1, listed), F.array().cast("array<string>")).alias("regions"), F.coalesce("_s", town, sight).alias("region"), basis.alias("basis"))


def place_hints(texts: DataFrame, key: str, text: str, dictionary: DataFrame, place_category: str, least: int = 2) -> DataFrame:
    """(key, category, place): what a text's keywords of at least ``least`` letters say: the category of the last one, and the last one that is a place.

    ``dictionary``: keyword, category, hint, position, whose order decides which is last. Texts without such a keyword have no row.
    """
    hits = spot_keywords(texts.select(key, text), text, dictionary).filter(F.length("keyword") >= least)
    place = F.max_by(F.when(F.col("category") == place_category, F.col("keyword")), F.when(F.col("category") == place_category, F.col("position")))
    return hits.groupBy(key).agg(F.max_by("category", "position").alias("category"), place.alias("place"))


def match_ads(items: DataFrame, events: DataFrame, products: DataFrame) -> DataFrame:
    """(item_id, ad, source, score): an event of the item's place first; else the best product for its first food keyword.

    ``items``: item_id, place, foods (ordered array), text; ``events``: place, event; ``products``:
    food, region, product. A product scores 1, 2 more if the text names its region, 1 more if that is
    the item's place, 1 more if the text names the food. An item with an event gets no product.
    """
    by_event = items.join(events, "place").groupBy("item_id").agg(F.min("event").alias("ad")).select("item_id", "ad", F.lit("event").alias("source"), F.lit(1).alias("score"))
    rest = items.join(by_event, "item_id", "left_anti").withColumn("food", F.try_element_at("foods", F.lit(1)))
    named = lambda c: F.coalesce(F.contains(F.col("text"), c), F.lit(False)).cast("int")
    score = 1 + 2 * named(F.col("region")) + F.coalesce((F.col("region") == F.col("place")).cast("int"), F.lit(0)) + named(F.col("food"))
    scored = rest.join(products, "food").withColumn("score", score)
    best = top_per_group(scored, ["item_id"], [F.desc("score"), F.col("product")], 1)
    return by_event.unionByName(best.select("item_id", F.col("product").alias("ad"), F.lit("product").alias("source"), "score"))


def clean_frames(food: DataFrame, captions: DataFrame, share: float = 0.5) -> DataFrame:
    """(item_id, at): each item's first food frame after ``share`` of its timeline without a caption in the same second."""
    late = food.withColumn("_m", F.max("at").over(Window.partitionBy("item_id"))).filter(F.col("at") >= F.col("_m") * share)
    second = lambda f: f.withColumn("_s", F.floor("at"))
    return second(late).join(second(captions).select("item_id", "_s").distinct(), ["item_id", "_s"], "left_anti").groupBy("item_id").agg(F.min("at").alias("at"))


def first_keyword(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first rule of which the text holds a keyword."""
    out = None
    for label, words in rules:
        hit = F.lower(text).rlike("|".join(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)
