"""License scans by diagonal voting (DataFrame functions only).

Templates are word sequences. All rolling grams of ``GRAM`` words of all texts are joined, by their hash, with the places
of the same grams in the templates, and the words are compared too, so that a vote is never a mere hash's. A vote is for a diagonal: the
word number in the text less that in the template. A template that stands in a text word by word has all its votes on
one diagonal. A longer one in which words were put in or left out has them on neighbouring diagonals; those are merged, and a merged span is
verified by the share of the template's grams that it holds and by its length in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tubal.llm.common import text_or_empty

#: What stands between words, after A-Z are lower-cased: anything but digits, a-z and what is beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals of one template that differ by no more words are one span.
NEAR = 8
#: Share of a template's grams that a span must hold, and its greatest length in template lengths.
COVERED, LONGEST = 0.8, 2

# The phrases of the base and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# The wording of common license notices, in words.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl", "the terms of the gnu general public license as published by"),
    ("lgpl", "the terms of the gnu lesser general public license as published by"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
]


def license_words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")  # several times as fast as to extract the words


def _grams(words: Column) -> Column:
    """All rolling grams, in order, each as its words joined by a space."""
    last = F.size(words) - GRAM
    rolling = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(GRAM)]))
    return F.when(last >= 0, rolling).otherwise(F.array().cast("array<string>"))


def template_places(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """``template, label, base, length`` (grams), ``at``, ``gram`` and its ``hash``: as many rows as the templates have words.
    The row with the empty gram is no template: every text has one empty gram at its end, so that texts without votes stay."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text")) for i, (base, (label, text)) in enumerate([*((True, x) for x in phrases), *((False, x) for x in notices)])]
    named = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.template", "t.label", "t.base", F.split("t.text", " ").alias("words"))
    grams = named.select("template", "label", "base", _grams(F.col("words")).alias("grams"))
    places = grams.select("template", "label", "base", F.size("grams").alias("length"), F.posexplode("grams").alias("at", "gram"))
    end = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("length"), F.lit(0).alias("at"), F.lit("").alias("gram"))
    return places.unionByName(end).withColumn("hash", F.xxhash64("gram"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places at which a phrase stands word by word, ``first_word`` and ``last_word`` are the least and the greatest
    of their starts (null without one). ``labels`` has ``base_labels`` and those of notices found. ``score`` is the greatest share of a template's
    grams found, 1 with a phrase, 0 where nothing is found. A null text has no words; ids may be null or repeat; texts
    of fewer than three words and empty tables find nothing; other columns are ignored. A text's votes are grouped by template and
    diagonal, so that a very long text is no single group."""
    for _, text in [*phrases, *notices]:
        if len(text.split(" ")) < GRAM:
            raise ValueError(f"a template has {GRAM} words at least, not {text!r}")
    places = template_places(docs.sparkSession, phrases, notices).select("template", "label", "base", "length", "at", F.col("gram").alias("_gram"), F.col("hash").alias("_hash"))
    worded = docs.select(F.col(id_col).alias("doc_id"), license_words(text_or_empty(text_col)).alias("words"), F.monotonically_increasing_id().alias("row"))
    rolled = worded.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.concat(_grams(F.col("words")), F.array(F.lit(""))).alias("grams"))
    # No list is empty; the outer form keeps Spark from making all grams a second time to see that.
    each = rolled.select("doc_id", "row", "n_words", F.posexplode_outer("grams").alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    # The templates are a fixed, small table. Equal words are asked for in a form that Spark does not take for a second
    # key of the join: one number as the key is looked up in a third less time.
    equal = F.col("gram").startswith(F.col("_gram")) & F.col("_gram").startswith(F.col("gram"))
    votes = each.join(F.broadcast(places), (F.col("hash") == F.col("_hash")) & equal)
    of = ["row", "doc_id", "n_words", "template", "label", "base", "length"]
    diagonal = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("pos") - F.col("at")).alias("diagonal")
    voted = votes.groupBy(*of, diagonal).agg(F.min("pos").alias("from"), F.max("pos").alias("to"), F.collect_list("at").alias("held"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    # A phrase of the base stands on one diagonal or not at all, and is not merged.
    apart = F.col("base") | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(along), F.lit(-(1 << 30))) > NEAR)
    spans = voted.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("long")).over(along))
    spans = spans.groupBy(*of, "span").agg(F.min("diagonal").alias("start"), F.min("from").alias("from"), F.max("to").alias("to"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    share = F.size("held") / F.col("length")
    fits = F.when(F.col("base"), share == 1).otherwise((share >= COVERED) & (F.col("to") - F.col("from") + 1 <= F.col("length") * LONGEST)) & (F.col("template") >= 0)
    fitting = spans.select("row", "doc_id", "n_words", "start", "label", share.alias("share"), fits.alias("fits"), (fits & F.col("base")).alias("base"))
    listed = lambda of: F.array_join(F.array_sort(F.collect_set(F.when(F.col(of), F.col("label")))), ",")
    at = F.when(F.col("base"), F.col("start").cast("long"))
    found = fitting.groupBy("row", "doc_id", "n_words").agg(
        F.count(at).alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"), listed("base").alias("base_labels"), listed("fits").alias("labels"),
        F.coalesce(F.max(F.when(F.col("fits"), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")
