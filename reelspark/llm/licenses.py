"""License scans by diagonal voting.

Every rolling word pair of every document is joined, by its hash, to the places at which license
templates hold that pair. A hit at word i of the document and word p of the template votes for the
diagonal i - p, which is where the template would start. Votes are summed by diagonal, and
neighbouring diagonals (shifted by a changed, added or left-out word) are merged. A merged span is
verified: its longest chain of hits, along which the places in the document and in the template both
increase and the diagonal shifts by little, must hold most of the template.

Native throughout: one scan, one broadcast join with the fixed templates, then aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.common import lower_ascii, nonnull_text, read_table

#: Phrases whose every word must stand consecutively, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Longer templates, matched where most of their word pairs stand in order, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("you should have received a copy of the gnu affero general public license", "agpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("this work is licensed under a creative commons attribution", "creative-commons"),
    ("dedicated to the public domain under cc0 1 0", "cc0"),
)

#: Neighbouring diagonals at most this far apart are merged, and between two hits of a chain the diagonal shifts by no more.
DIAGONAL_GAP = 3
#: Share of a template's word pairs that a chain must hold; of a template with fewer pairs than WHOLE, all of them.
COVERAGE = 0.75
WHOLE = 8

#: What stands between words: ASCII that is neither a digit nor a small letter, once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(text), NOT_WORD), lambda w: w != "")


def template_pairs(spark: SparkSession, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """(h, t, p, w1, w2): every word pair of every template; its size follows from the fixed templates. Template -1 stands for the document itself."""
    rows = [(-1, 0, "", "")]
    for t, (text, _) in enumerate([*phrases, *templates]):
        words = text.split()
        rows += [(t, p, a, b) for p, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "t int, p int, g1 string, g2 string").select(F.xxhash64("g1", "g2").alias("h"), "t", "p", "g1", "g2")


def _longest_chain(hits: Column, places: int) -> Column:
    """(n, start, last) of the longest chain among ``hits`` (i, p), sorted; ``places`` bounds p.

    For each template place the state keeps the longest chain that ends there: its hits, its first
    and its last word. So the work is the number of hits times the template's length.
    """
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("last"))
    state = F.struct(F.array_repeat(nothing, places).alias("ends"), nothing.alias("best"))

    def step(s: Column, hit: Column) -> Column:
        shift = lambda x, p: F.abs((hit["i"] - x["last"]) - (hit["p"] - p))
        before = F.transform(s["ends"], lambda x, p: F.when((x["n"] > 0) & (p < hit["p"]) & (x["last"] < hit["i"]) & (shift(x, p) <= DIAGONAL_GAP), F.struct(x["n"].alias("n"), x["start"].alias("start"))))
        longest = F.array_max(before)  # of equally long ones the shortest stretch; nulls don't count
        made = F.struct((F.coalesce(longest["n"], F.lit(0)) + 1).alias("n"), F.coalesce(longest["start"], hit["i"]).alias("start"), hit["i"].alias("last"))
        # a list of one, so that what was found is worked out once
        put = lambda new: F.struct(
            F.transform(s["ends"], lambda x, p: F.when((p == hit["p"]) & ((new["n"] >= x["n"]) | (hit["i"] - x["last"] > 2 * places)), new).otherwise(x)).alias("ends"),
            F.when(new["n"] > s["best"]["n"], new).otherwise(s["best"]).alias("best"),
        )
        return F.transform(F.array(made), put)[0]

    return F.aggregate(hits, state, step, lambda s: s["best"])


def scan_licenses(documents: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_words, places, spans) for every row of ``documents``, repeated and null ones too.

    ``places`` are the (start, label) of phrases whose words stand consecutively; ``spans`` the
    (start, end, label, share) of templates of which a chain of hits, in order, holds at least
    ``coverage`` of the word pairs: the longest chain of each run of merged diagonals. Starts and
    ends count words from 0. Null text is empty and has neither. Texts are scanned whole. Other
    columns are ignored, whatever their names. An empty table gives none.
    """
    spark = documents.sparkSession
    pairs = F.broadcast(template_pairs(spark, phrases, templates))
    rows = documents.select(F.monotonically_increasing_id().alias("r"), "doc_id", words_of(nonnull_text()).alias("w"))
    # the empty pair in front stands for the document, so that documents without a hit stay
    nothing = F.array(F.lit(""))
    shifted = F.arrays_zip(F.concat(nothing, F.col("w")).alias("a"), F.concat(nothing, F.slice(F.col("w"), 2, 2_000_000_000), nothing).alias("b"))
    grams = rows.select("r", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(shifted).alias("i", "g")).select("r", "doc_id", "n_words", (F.col("i") - 1).alias("i"), F.col("g.a").alias("w1"), F.col("g.b").alias("w2"))
    hits = grams.withColumn("h", F.xxhash64("w1", "w2")).join(pairs, "h").filter("w1 = g1 AND w2 = g2")
    diagonals = hits.groupBy("r", "doc_id", "n_words", "t", (F.col("i") - F.col("p")).alias("d")).agg(F.collect_list("p").alias("ps"))
    # neighbouring diagonals of one template in one document are merged; a phrase's are not, as it must stand whole
    along = Window.partitionBy("r", "t").orderBy("d")
    n = len(phrases)
    all_pairs = [len(text.split()) - 1 for text, _ in [*phrases, *templates]]
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.greatest("t", F.lit(0)) + 1)
    total, label = of(all_pairs), of([x for _, x in [*phrases, *templates]])
    new = F.when((F.col("t") >= n) & (F.col("d") - F.lag("d").over(along) <= DIAGONAL_GAP), 0).otherwise(1)
    merged = diagonals.withColumn("island", F.sum(new).over(along))
    votes = F.collect_list(F.transform("ps", lambda p: F.struct((F.col("d") + p).alias("i"), p.alias("p"))))
    merged = merged.groupBy("r", "doc_id", "n_words", "t", "island").agg(F.flatten(votes).alias("hits"))
    distinct = F.size(F.array_distinct(F.transform("hits", lambda h: h.p)))
    least = of([k if k < WHOLE else math.ceil(coverage * k - 1e-9) for k in all_pairs])
    phrase = (F.col("t") >= 0) & (F.col("t") < n) & (distinct == total)
    place = F.when(phrase, F.struct(F.element_at(F.array_sort("hits"), 1)["i"].cast("long").alias("start"), label.alias("label")))
    chain = F.when((F.col("t") >= n) & (distinct >= least), _longest_chain(F.array_sort("hits"), max(all_pairs)))
    merged = merged.select("r", "doc_id", "n_words", "t", place.alias("place"), chain.alias("chain"))
    span = F.struct(F.col("chain.start").cast("long").alias("start"), (F.col("chain.last") + 2).cast("long").alias("end"), label.alias("label"), (F.col("chain.n") / total).alias("share"))
    found = merged.select("r", "doc_id", "n_words", "place", F.when(F.col("chain.n") >= least, span).alias("span"))
    # nulls (documents without a place) are left out of the lists
    return found.groupBy("r").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("place").alias("places"), F.collect_list("span").alias("spans")).drop("r")


# ---- queries ----


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license phrases and templates of every document."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p.start)
    labels = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda p: p.label) for x in lists]))), ",")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("places").alias("base_labels"), labels("places", "spans").alias("labels"), score.alias("score"),
    )


QUERIES = {"op4_licenses": op4_licenses}
ORACLES: dict[str, str] = {}
