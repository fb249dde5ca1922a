"""URL filters: domain rules, and gradient-boosted trees on lexical features for all other addresses.

Native throughout: features, rules and verdicts are DataFrame functions; the trees are Spark's own.
The rules label the addresses they fit, and the trees learn from those.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import bounded_sample, lower_ascii, materialise, read_table

#: Labelled addresses that the trees are fitted on at most (chosen by a hash of the address).
FIT_ROWS = 20_000
#: Values that host suffixes, and first parts of paths, are hashed to for their shares of blocked addresses.
HASHED = 1 << 14
#: Parts of the hosts: an address that trees are fitted on gets its shares from the hosts of other parts, so that they hold nothing of its own label.
FOLDS = 5
TREES, DEPTH = 12, 4

#: The rules as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equally long
    rules the first by name wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a letter, over letters' counts in the text: letters are sorted, and each run of equal ones adds its share."""
    letters = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(letters)
    of_run = lambda a: a["sum"] + a["run"] * F.log2(F.greatest(a["run"], F.lit(1)))
    start = F.struct(F.lit("").alias("letter"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.when(a["letter"] == c, F.struct(c.alias("letter"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("letter"), F.lit(1).alias("run"), of_run(a).alias("sum")))
    return F.when(n > 0, F.log2(n) - F.aggregate(letters, start, step, of_run) / n).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Length, depth, digit ratio, entropy and parameter counts of an address, by name."""
    url = F.coalesce(url, F.lit(""))
    count = lambda text, what: (F.length(text) - F.length(F.regexp_replace(text, what, ""))).cast("double")
    return {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_host_labels": count(host, r"\."),
        "f_host_hyphens": count(host, "-"),
        "f_depth": count(path, "/"),
        "f_path_length": F.length(path).cast("double"),
        "f_digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "f_path_digits": count(path, "[0-9]") / F.greatest(F.length(path), F.lit(1)),
        "f_entropy": _entropy(url),
        "f_params": count(F.regexp_extract(url, r"\?([^#]*)", 1), "="),
        "f_query_length": F.length(F.regexp_extract(url, r"\?([^#]*)", 1)).cast("double"),
        "f_fragment": F.contains(url, F.lit("#")).cast("double"),
        "f_secure": url.startswith("https").cast("double"),
        "f_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    }


def suffix_of(host: Column) -> Column:
    """The host's last label."""
    return F.element_at(F.split(host, r"\."), -1)


def lang_of(path: Column) -> Column:
    """The path's first part."""
    return F.regexp_extract(path, r"^/([^/]*)", 1)


def _hashed(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(HASHED)).cast("int")


def _shares(labelled: DataFrame, what: str) -> DataFrame:
    """(h, fold, share) of each hashed value of ``what``: the smoothed share of blocked addresses, over all labelled ones outside that fold.

    Fold null: over all. HASHED rows for each of FOLDS + 1 at most, so it may be broadcast.
    """
    counted = materialise(labelled.groupBy(_hashed(F.col(what)).alias("h"), _fold().alias("fold")).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n")))
    whole = counted.groupBy("h").agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    share = lambda blocked, n: ((blocked + 0.5) / (n + 1.0)).alias("share")
    outside = counted.join(whole, "h").select("h", "fold", share(F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n")))
    return materialise(outside.unionByName(whole.select("h", F.lit(None).cast("int").alias("fold"), share(F.col("all_blocked"), F.col("all_n")))))


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(FOLDS)).cast("int")


def judge(pages: DataFrame, rules: tuple = RULES, fit_rows: int = FIT_ROWS, threshold: float = 0.5, seed: int = 42, unlearnt: Column | None = None) -> DataFrame:
    """Each row of ``pages`` with host, path, rule, score and verdict added (replacing columns so named).

    The verdict is the rule's; where none fits, it is the trees': block if their score is at least
    ``threshold``. Null urls and those without ``://`` have empty host and path. If the rules label
    no address, or all alike, the score of all others is that label's (0 without any), and no trees
    are fitted. Repeated rows get equal verdicts; an empty table stays empty. Null labels don't occur.

    Each labelled address counts once, so that hot ones don't outweigh others. Shares of suffixes
    and first path parts are taken over all of them, for the rows that trees are fitted on over those of other
    hosts. The trees are fitted on at most ``fit_rows``, taken in order of a hash. ``unlearnt`` (of
    host and path) leaves labelled addresses out of both, to measure on.
    """
    taken = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    traits = {"suffix": suffix_of(F.col("host")), "lang": lang_of(F.col("path"))}
    labelled = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path")).withColumn("label", (ruled == "block").cast("double")).filter("label IS NOT NULL")
    if unlearnt is not None:
        labelled = labelled.filter(~unlearnt)
    labelled = materialise(labelled.withColumns(traits))
    labels = [r["label"] for r in labelled.select("label").distinct().collect()]
    # the given columns travel packed, so that none clashes with what the trees add
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in taken]).alias("_in"), "url", host.alias("host"), path.alias("path"))
    if len(labels) < 2:
        scored = rows.withColumn("score", F.lit(labels[0] if labels else 0.0))
    else:
        shares = {what: _shares(labelled, what) for what in traits}

        def with_features(df: DataFrame, fold: Column) -> DataFrame:
            df = df.withColumn("h_fold", fold)
            df = df.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")) | {f"h_{what}": _hashed(of) for what, of in traits.items()})
            for what, share in shares.items():
                share = F.broadcast(share.select(F.col("h").alias("_h"), F.col("fold").alias("_fold"), F.col("share").alias(f"f_{what}")))
                df = df.join(share, (F.col(f"h_{what}") == F.col("_h")) & F.col("h_fold").eqNullSafe(F.col("_fold")), "left").drop("_h", "_fold")
            return df.fillna(0.5, [f"f_{what}" for what in traits])

        sample = materialise(with_features(bounded_sample(labelled, "url", fit_rows, seed).drop(*traits), _fold()))
        assembler = VectorAssembler(inputCols=[c for c in sample.columns if c.startswith("f_")], outputCol="_features")
        model = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=seed).fit(assembler.transform(sample))
        scored = model.transform(assembler.transform(with_features(rows, F.lit(None).cast("int")))).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(ruled, F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("_in.*", "host", "path", rule.alias("rule"), "score", verdict.alias("verdict"))


# ---- queries ----


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the address of every page."""
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op2_urls": op2_urls}
ORACLES: dict[str, str] = {}
