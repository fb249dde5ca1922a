"""Title search: the index, queries against it, and fuzzy matches between catalogues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.titles import initials, initials_only, sequence_similarity, trigram_similarity
from reelspark.operators.catalogue import first_per_group
from reelspark.operators.ranking import top_per_group


#: Lengths of the stretches that names are compared by; the longest that a bound allows is used.
STRETCHES = (3, 2, 1)
#: Left names that one task meets under one stretch, at most.
NAMES_A_PART = 1000


def _letters_of(text: Column, q: Column) -> Column:
    """A name's stretches of ``q`` letters, in order, repeats included."""
    def cut(letters: Column) -> Column:
        more = lambda i: [F.when(q > j, F.get(letters, i + j)).otherwise("") for j in range(1, max(STRETCHES))]
        return F.transform(F.sequence(F.lit(0), F.length(text) - q), lambda i: F.concat(F.get(letters, i), *more(i)))

    # as the only member of an array, the letters are worked out once
    return F.when(F.length(text) >= q, F.transform(F.array(F.split(text, "")), cut)[0]).otherwise(F.array().cast("array<string>"))


def _shared(n: Column, bound: Column, q: int) -> Column:
    """Stretches that a name of ``n`` letters has in common with any other at least as similar as ``bound``: each edit spoils at most ``q`` of the longer name's."""
    return F.ceil(n * (1 - q * (1 - bound + 1e-6)) - (q - 1) - 1e-9).cast("int")


def _tokens(names: DataFrame, name: str) -> DataFrame:
    """``names`` (with q) once for each stretch of q letters: token, i (its number among equal ones, so that sets stand for bags), and n, how many there are."""
    n = F.length(name) - F.col("q") + 1
    each = names.withColumn("token", F.explode(_letters_of(F.col(name), F.col("q")))).groupBy(*names.columns, "token").agg(F.count(F.lit(1)).alias("_c"))
    return each.select(*names.columns, "token", n.alias("n"), F.explode(F.sequence(F.lit(1), F.col("_c").cast("int"))).alias("i"))


def similar_name_pairs(left: DataFrame, right: DataFrame, least: float, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k, a, b) to be looked at: all pairs of names of equal ``k`` that can be as similar as the left one's ``bound``, and some that are not.

    ``left``: k, a, bound (``least`` or more); ``right``: k, b; both without repeats. Empty names have no stretches, and meet none.
    Stretches are ordered by rarity among the right names. Two names
    that share ``o`` of them share one even without the last ``o`` - 1 of each, so the commonest ones aren't joined.
    A stretch under which many left names meet is dealt to several tasks.
    """
    needed = lambda q: _shared(F.length("a"), F.col("bound"), q)
    q = F.coalesce(*[F.when(needed(x) >= 1, x) for x in STRETCHES], F.lit(1))
    o = F.coalesce(*[F.when(needed(x) >= 1, needed(x)) for x in STRETCHES], F.lit(1))
    asked = _tokens(left.withColumn("q", q).withColumn("o", o), "a")
    # of right names all stretches are open but single letters, which the lowest bound cuts
    fewest = F.when(F.col("q") == 1, F.greatest(F.lit(1), _shared(F.length("b"), F.lit(least), 1))).otherwise(1)
    given = write(_tokens(right.withColumn("q", F.explode(F.array(*[F.lit(x) for x in STRETCHES]))).withColumn("o", fewest), "b"))
    common = given.groupBy("k", "q", "token", "i").agg(F.count(F.lit(1)).alias("f"))
    # a rank within a name: its own stretches alone are sorted
    place = lambda name: F.row_number().over(Window.partitionBy("k", name, "q").orderBy("f", "token", "i"))
    on = ["k", "q", "token", "i"]
    theirs = given.join(common, on).withColumn("_p", place("b")).filter("_p <= n - o + 1").select(*on, "b")
    ours = asked.join(common, on, "left").withColumn("f", F.coalesce("f", F.lit(0)))
    ours = write(ours.withColumn("_p", place("a")).filter("_p <= n - o + 1 AND f > 0").select(*on, "a", "bound"))
    parts = ours.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / NAMES_A_PART).cast("int").alias("parts"))
    l = ours.join(parts, on).select(*on, "a", "bound", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))  # noqa: E741
    r = theirs.join(parts, on).select(*on, "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    longer, shorter = F.greatest(F.length("a"), F.length("b")), F.least(F.length("a"), F.length("b"))
    return l.join(r, [*on, "part"]).filter(shorter >= longer * (F.col("bound") - 1e-6)).select("k", "a", "b").distinct()


def _two_best(pairs: DataFrame, ids: DataFrame, least: float) -> DataFrame:
    """(k, a, match_id, s): the two most similar ids of each name over ``least``; ties to the smaller id."""
    near = pairs.withColumn("s", F.round(sequence_similarity(F.col("a"), F.col("b")), 6)).filter(F.col("s") > least)
    one = near.join(ids, ["k", "b"]).groupBy("k", "a", "match_id").agg(F.max("s").alias("s"))
    return top_per_group(one, ["k", "a"], [F.desc("s"), F.col("match_id")], 2, "_n").drop("_n")


def _nearest_names(left: DataFrame, ids: DataFrame, least: float, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``_two_best`` of all right names. ``left``: k, a; ``ids``: k, b, match_id."""
    ids = write(top_per_group(ids.distinct(), ["k", "b"], [F.col("match_id")], 2, "_n").drop("_n"))
    right = ids.select("k", "b").distinct()
    # two names stand for each stretch of three letters, and every name for itself: whom a name meets there sets its bound
    clues = lambda name: F.array_distinct(F.array_append(_letters_of(F.col(name), F.lit(3)), F.concat(F.lit("="), F.col(name))))
    stand = right.select("k", "b", F.explode(clues("b")).alias("clue")).groupBy("k", "clue").agg(F.array_distinct(F.array(F.min("b"), F.max("b"))).alias("bs"))
    first = left.select("k", "a", F.explode(clues("a")).alias("clue")).join(stand, ["k", "clue"]).select("k", "a", F.explode("bs").alias("b")).distinct()
    # pairs are written before they are measured: a condition on the distance would move below distinct, to every stretch that two names share
    seeds = write(_two_best(write(first), ids, least))
    bounds = seeds.groupBy("k", "a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s")).filter("n = 2").select("k", "a", "s")
    asked = left.join(bounds, ["k", "a"], "left").select("k", "a", F.coalesce("s", F.lit(least)).alias("bound"))
    more = _two_best(write(similar_name_pairs(asked, right, least, write)), ids, least)
    one = more.unionByName(seeds).groupBy("k", "a", "match_id").agg(F.max("s").alias("s"))
    return write(top_per_group(one, ["k", "a"], [F.desc("s"), F.col("match_id")], 2, "_n").drop("_n"))


def fuzzy_match(left: DataFrame, right: DataFrame, write: Callable[[DataFrame], DataFrame], least: float = 0.3) -> DataFrame:
    """(item_id, match_id): the most similar other name over ``least`` (to six places); one of the same type before all others; ties to the smaller id.

    ``left``: item_id, name, type; ``right``: match_id, match_name, match_type. Null ids and names match nothing; null types
    are a type of their own. Equal names are looked at once. ``write`` writes a frame to shared storage and reads it back.

    Names of the same type meet first, all others only where these give fewer than two ids (one may be the item's own).
    Similar names found at sight set each name's bound; who could beat it is found by ``similar_name_pairs``.
    """
    kind = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = left.filter("item_id IS NOT NULL AND name IS NOT NULL").select("item_id", F.col("name").alias("a"), kind("type").alias("k"))
    ids = right.filter("match_id IS NOT NULL AND match_name IS NOT NULL").select("match_id", F.col("match_name").alias("b"), kind("match_type").alias("k"))
    names = write(rows.select("k", "a").distinct())
    same = _nearest_names(names, ids, least, write)
    enough = same.groupBy("k", "a").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    short = write(names.join(enough, ["k", "a"], "left_anti"))
    other = _nearest_names(short.select(F.lit("").alias("k"), "a").distinct(), ids.withColumn("k", F.lit("")), least, write)
    wide = short.join(other.drop("k"), "a").select("k", "a", "match_id", "s")
    found = same.withColumn("other", F.lit(0)).unionByName(wide.withColumn("other", F.lit(1))).groupBy("k", "a", "match_id").agg(F.min(F.struct("other", (-F.col("s")).alias("s"))).alias("o"))
    best = rows.join(found, ["k", "a"]).filter("item_id <> match_id")
    return top_per_group(best, ["item_id"], [F.col("o"), F.col("match_id")], 1).select("item_id", "match_id")


def search_index(items: DataFrame) -> DataFrame:
    """One row for each series: its text to search and its initial consonants."""
    rows = items.withColumn("series", F.coalesce("series_nm", "title"))
    one = first_per_group(rows, ["series"], [F.col("poster_url").isNull(), "item_id"])
    return one.select("series", "item_id", F.concat_ws(" ", "series", "genre", "director").alias("search_text"), initials(F.col("series")).alias("initials"))


#: Letters of the stretches that texts are found by, at most.
GRAM = 3
#: What may follow an episode's number, and the letters that mark one in a title.
EPISODE, MARKS = r"\s+(\d+)\s*[화회]?\s*$", ("화", "회")


def _grams(text: Column, least: Column) -> Column:
    """The distinct stretches of ``least`` to GRAM letters of a text."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    stretches = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(least, F.lit(GRAM)), lambda k: F.when(i + k - 1 <= n, F.substring(text, i, k)))))
    return F.array_distinct(F.filter(stretches, lambda g: g.isNotNull()))


def postings(index: DataFrame) -> DataFrame:
    """(kind, gram, series): the stretches of 1 to GRAM letters of each series' text (kind t), and the beginnings of its initial consonants (kind i). Written once, it serves any number of queries."""
    text = index.select("series", F.lit("t").alias("kind"), F.explode(_grams(F.lower("search_text"), F.lit(1))).alias("gram"))
    begins = F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.when(k <= F.length("initials"), F.substring("initials", 1, k)))
    first = index.select("series", F.lit("i").alias("kind"), F.explode(F.array_distinct(F.filter(begins, lambda g: g.isNotNull()))).alias("gram"))
    return text.unionByName(first).select("kind", "gram", "series")


def search(index: DataFrame, posted: DataFrame, queries: DataFrame, n: int = 8) -> DataFrame:
    """(query, series, similarity, rank) for a table of queries of any size: by initial consonants where a query has no others, else by contained text, most similar first; ties by series.

    A text that contains a query holds all its stretches of GRAM letters (itself, if it is shorter). So
    a query meets only the texts that ``posted`` has under its rarest stretch, and those are looked at. Queries that are null or empty find nothing.
    """
    q = F.lower("query")
    by_initials = initials_only(F.col("query")) & F.col("query").rlike("[ㄱ-ㅎ]")
    asked = queries.select("query").distinct().filter(F.length("query") > 0).withColumn("kind", F.when(by_initials, "i").otherwise("t"))
    grams = F.when(by_initials, F.array(F.substring("query", 1, GRAM))).otherwise(_grams(q, F.least(F.length(q), F.lit(GRAM))))
    sizes = posted.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n"))
    spelt = asked.select("query", "kind", F.explode(grams).alias("gram")).join(sizes, ["kind", "gram"], "left")
    rarest = spelt.groupBy("query", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r")).filter("r.n > 0").select("query", "kind", F.col("r.gram").alias("gram"))
    hit = F.when(F.col("kind") == "i", F.col("initials").startswith(F.col("query"))).otherwise(F.contains(F.lower("search_text"), q))
    pairs = rarest.join(posted, ["kind", "gram"]).select("query", "kind", "series").join(index, "series").filter(hit)
    similar = F.when(F.col("kind") == "i", 0.0).otherwise(F.round(trigram_similarity(F.col("search_text"), F.col("query")), 6))
    return top_per_group(pairs.withColumn("similarity", similar), ["query"], [F.desc("similarity"), F.col("series")], n).select("query", "series", "similarity", "rank")


def search_episodes(index: DataFrame, posted: DataFrame, items: DataFrame, queries: DataFrame, providers: tuple[str, ...] = (), n: int = 8) -> DataFrame:
    """(query, series, title, item_id, rank): as ``search``, but a query that ends in a number asks for that episode of the series that the rest of it finds.

    Episodes are the series' items whose title holds the number and a mark of episodes; of equal
    titles the first by ``providers`` (then by id) stands, in order of title. If there is none, the series themselves are
    the answer. ``items``: item_id, series_nm, title, provider.
    """
    number = F.regexp_extract("query", EPISODE, 1)
    name = F.trim(F.regexp_replace("query", EPISODE, ""))
    split = (number != "") & (name != "")
    parsed = queries.select("query").distinct().filter(F.length("query") > 0).withColumn("name", F.when(split, name).otherwise(F.col("query"))).withColumn("episode", F.when(split, F.regexp_replace(number, "^0+(?=[0-9])", "")))
    found = search(index, posted, parsed.select(F.col("name").alias("query")), n).withColumnRenamed("query", "name")
    hits = parsed.join(found, "name")
    titles = items.select("item_id", F.col("series_nm").alias("series"), "title", "provider").filter("series IS NOT NULL")
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("title", F.concat("episode", F.lit(mark)))
    place = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider")), F.lit(0)) if providers else F.lit(0)
    rows = hits.filter("episode IS NOT NULL").select("query", "episode", "series").join(titles, "series").filter(marked)
    one = first_per_group(rows.withColumn("_place", F.when(place == 0, len(providers) + 1).otherwise(place)), ["query", "title"], [F.col("_place"), F.col("item_id")])
    episodes = top_per_group(one, ["query"], [F.col("title"), F.col("item_id")], n).select("query", "series", "title", "item_id", "rank")
    whole = hits.join(episodes.select("query").distinct(), "query", "left_anti").join(index.select("series", "item_id"), "series").select("query", "series", F.lit(None).cast("string").alias("title"), "item_id", "rank")
    return episodes.unionByName(whole)
