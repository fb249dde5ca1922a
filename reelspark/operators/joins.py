"""Joins beyond plain equality: ranges, as-of, substrings, boxes, similar sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def point_in_span(points: DataFrame, spans: DataFrame, keys: list[str], at: str, since: str, until: str, bucket: float) -> DataFrame:
    """Points with the spans that hold them, both ends included.

    Spans are exploded to the buckets of ``bucket`` units that they touch, so the join is an equality
    on key and bucket; choose a bucket about as long as a typical span.
    """
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(since) / bucket), F.floor(F.col(until) / bucket))))
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    return p.join(s, [*keys, "_b"]).filter((F.col(at) >= F.col(since)) & (F.col(at) <= F.col(until))).drop("_b")


def next_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, then: str) -> DataFrame:
    """As-of forward join: each left row with the soonest right time after it (null if none).

    Both sides are laid on one line by key and time, and the next right time is carried back over
    it: one shuffle by key, no pairs.
    """
    l = left.withColumn("_t", F.col(at)).withColumn("_r", F.lit(None).cast(right.schema[then].dataType)).withColumn("_side", F.lit(1))  # noqa: E741
    r = right.select(*keys, F.col(then).alias("_t"), F.col(then).alias("_r"), F.lit(0).alias("_side")).distinct()
    line = l.unionByName(r, allowMissingColumns=True)
    # backwards in time, the last right time so far is the soonest after; a running frame is linear
    before = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    return line.withColumn(then, F.last("_r", ignorenulls=True).over(before)).filter("_side = 1").select(*left.columns, then)


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Texts with the dictionary terms they contain. ``terms`` is a small fixed dictionary, as its caller vouches."""
    return texts.join(F.broadcast(terms), F.contains(F.col(text), F.col(term)))


def ngram_containing(names: DataFrame, name: str, terms: DataFrame, term: str, least: int, most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """As ``containing``, for a dictionary of any size: names are exploded to their stretches of ``least`` to ``most`` letters, and joined by equality (of ``keys`` too).

    Spark takes the stretches for as small as the names, so a hint keeps it from broadcasting them. A caller with a small dictionary may broadcast that.
    """
    n = F.length(F.col(name))
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    stretches = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(i + k - 1 <= n, F.substring(F.col(name), i, k)))))
    exploded = names.withColumn(term, F.explode(F.array_distinct(F.filter(stretches, lambda s: s.isNotNull()))))
    return exploded.hint("merge").join(terms, [term, *keys])


def exact_then_partial(left: DataFrame, key: str, dictionary: DataFrame, name: str, order: str) -> DataFrame:
    """Each left key with one entry of a small dictionary: an equal name, else the first that contains it or is contained."""
    keys = left.select(key).distinct()
    hits = keys.join(F.broadcast(dictionary), (F.col(key) == F.col(name)) | F.contains(F.col(key), F.col(name)) | F.contains(F.col(name), F.col(key)))
    best = hits.groupBy(key).agg(F.min(F.struct((F.col(key) != F.col(name)).alias("p"), F.col(order), F.col(name))).alias("b"))
    return left.join(best.select(key, F.col(f"b.{name}").alias(name)), key, "left")


def region_boxes(points: DataFrame, boxes: DataFrame, lat: str, lng: str, columns: list[str]) -> DataFrame:
    """Points with the first of a few fixed boxes (order, name, lat0, lat1, lng0, lng1) that holds them."""
    hits = points.join(F.broadcast(boxes), F.col(lat).between(F.col("lat0"), F.col("lat1")) & F.col(lng).between(F.col("lng0"), F.col("lng1")), "left")
    return hits.groupBy(*columns).agg(F.min_by("name", "order").alias("region"))


#: Owners of one member in one list, and pairs of owners that one task counts.
LIST_OWNERS = 1000
TASK_PAIRS = 2_000_000


def most_similar_set(sets: DataFrame, owner: str, member: str, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(owner, nearest, jaccard): for each owner the other one whose members overlap most, ties to the smaller.

    Owners that share nothing with any other are left out. ``write`` writes a frame to shared storage and reads it back.
    An owner's members are held as one array.

    1. The smallest other owner of each member is the best that a single shared member can bring; the
       best of those, measured exactly, is an owner's bound.
    2. Who beats the bound shares two members or more, and a share of the owner's own that follows from it. If an owner leaves
       out all but one of as many of its commonest members, who beats it shares one of the others; if it leaves out one less,
       two of them. The first is taken only where the member in question has more owners than all the rarer ones together, as
       each owner of those must then be looked at to the end. So owners don't meet over an item that everyone has.
    3. A member's owners go to each other as lists, each pair in one direction, and are counted where the lists of an owner
       come together: pairs are never shuffled before they are known to share enough.
    4. What both of a pair left out is compared at the end.
    """
    pairs = sets.select(F.col(owner).alias("a"), F.col(member).alias("m")).dropna()
    held = write(pairs.groupBy("a").agg(F.collect_set("m").alias("ms")).withColumn("n", F.size("ms")))
    by_size = Window.partitionBy("m").orderBy("n", "a")
    me = F.struct("n", "a")
    met = held.select("a", "n", F.explode("ms").alias("m"))
    met = met.withColumn("o", F.when(F.row_number().over(by_size) == 1, F.lead(me).over(by_size)).otherwise(F.first(me).over(by_size)))
    met = met.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("m"))).filter("f > 1")  # those that one owner alone has are of no use
    best = F.max(F.struct((1 / (F.col("n") + F.col("o.n") - 1)).alias("j"), (-F.col("o.a")).alias("b"), F.col("o.n").alias("bn"))).alias("s")
    start = met.groupBy("a", "n").agg(best, F.array_sort(F.collect_list(F.struct("f", "m"))).alias("fm"))
    start = write(start.select("a", "n", (-F.col("s.b")).alias("b"), F.col("s.bn").alias("bn"), F.col("fm.f").alias("fs"), F.col("fm.m").alias("ms")))

    jaccard = lambda i: i / (F.col("n") + F.col("bn") - i)
    bounds = start.join(held.select(F.col("a").alias("b"), F.col("ms").alias("theirs")), "b").withColumn("j", jaccard(F.size(F.array_intersect("ms", "theirs"))))
    # the members that may be left out: one less than must be shared
    bounds = bounds.withColumn("k", (F.greatest(F.lit(2), F.ceil(F.col("j") * F.col("n") - 1e-9)) - 1).cast("int")).withColumn("g", F.size("ms"))
    rarer = F.aggregate(F.slice("fs", 1, F.greatest(F.col("g") - F.col("k"), F.lit(0))), F.lit(0).cast("long"), lambda s, f: s + f)
    one = (F.col("g") > F.col("k")) & (F.get("fs", F.col("g") - F.col("k")) > rarer)
    bounds = bounds.withColumn("l", F.when(one, 1).otherwise(2)).withColumn("k", F.when(F.col("g") <= F.col("k"), F.col("g")).otherwise(F.col("k") + 1 - F.col("l")))
    placed = write(bounds.select("a", "n", "b", "j", "l", "k", "fs", "ms"))

    owners = placed.select("a", "l", (F.size("ms") - F.col("k")).alias("rare"), F.posexplode(F.arrays_zip("fs", "ms")).alias("at", "x"))
    parts = F.ceil(F.col("x.fs") / LIST_OWNERS).cast("int")
    owners = owners.select("a", "l", (F.col("at") < F.col("rare")).alias("rare"), F.col("x.ms").alias("m"), F.pmod(F.xxhash64("a"), parts).cast("int").alias("p"), parts.alias("parts"))
    those = lambda l, rare, name: F.collect_list(F.when((F.col("l") == l) & (F.col("rare") == rare), F.col("a"))).alias(name)  # noqa: E731, E741
    lists = owners.groupBy("m", "p", "parts").agg(those(1, True, "r1"), those(1, False, "c1"), those(2, True, "r2"), those(2, False, "c2"))
    lists = lists.select("m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "r1", "c1", "r2", "c2")
    # a pair goes from the owner who looks at more to the other, else from the smaller; over a member that one of them at least has kept
    after = lambda name: F.filter(name, lambda b: b > F.col("a"))
    first = F.when(F.col("rare"), F.concat(after("r1"), after("c1"), "r2", "c2")).otherwise(F.concat(after("r1"), "r2"))
    second = F.when(F.col("rare"), F.concat(after("r2"), after("c2"))).otherwise(after("r2"))
    sent = owners.drop("parts").join(lists, ["m", "p"]).select("a", "l", F.when(F.col("l") == 1, first).otherwise(second).alias("bs")).filter(F.size("bs") > 0)
    total = start.agg(F.sum(F.aggregate("fs", F.lit(0).cast("long"), lambda s, f: s + f))).first()[0] or 0
    tasks = max(1, total // 2 // TASK_PAIRS)
    counted = sent.repartition(tasks, "a").select("a", "l", F.explode("bs").alias("b")).groupBy("a", "l", "b").agg(F.count(F.lit(1)).alias("c")).filter("c >= l").drop("l")
    theirs = placed.select(F.col("a").alias("b"), F.col("n").alias("bn"), F.col("j").alias("bj"), F.col("k").alias("bk"))
    shared = counted.join(placed.select("a", "n", "j", "k"), "a").join(theirs, "b")
    most = jaccard(F.least(F.col("c") + F.least("k", "bk"), F.col("n"), F.col("bn")))
    shared = write(shared.filter(most >= F.least("j", "bj") - 1e-12).select("a", "n", "b", "bn", "c", (F.least("k", "bk") > 0).alias("open")))
    left = placed.filter("k > 0").select("a", F.slice("ms", F.size("ms") - F.col("k") + 1, F.col("k")).alias("rest"))
    rest = shared.filter("open").join(left, "a").join(left.select(F.col("a").alias("b"), F.col("rest").alias("other")), "b")
    rest = rest.withColumn("c", F.col("c") + F.size(F.array_intersect("rest", "other")))
    exact = shared.filter("NOT open").select("a", "b", jaccard(F.col("c")).alias("j")).unionByName(rest.select("a", "b", jaccard(F.col("c")).alias("j")))
    both = exact.select("j", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*", "j")
    best = placed.select("a", "b", "j").unionByName(both).groupBy("a").agg(F.max(F.struct("j", (-F.col("b")).alias("b"))).alias("m"))
    return best.select(F.col("a").alias(owner), (-F.col("m.b")).alias("nearest"), F.col("m.j").alias("jaccard"))
