"""License scans: texts and license templates meet on diagonals.

All rolling word k-grams of a text are hashed and joined to the places where templates have the same
hashes. A hit at text place p and template place q votes for diagonal p - q. Votes are summed for each
(document, template, diagonal), and diagonals a few words apart (inserted or dropped words) are merged. A
chain that grows longer than a template can be is a template that stands there again and again: it is parted,
in the order of the text, where the template's places begin anew. A span is verified if the runs of equal
words in it cover enough of the template and it is not too long.

Everything is native. The templates are a parameter of a few kilobytes whose size is checked, so their
places are broadcast. Every text is worked through once, and of its k-grams only those that a template has are
stored; documents are never shuffled, only the few votes are. One document's votes are
summed before they meet, so a document of any length, or a hot one, gives few rows.

Defined results: null text has no words, a null score is never given: a text without any license has no
labels (an empty text) and score 0. Repeated rows keep a result each.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, store

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that count wherever they stand, and the labels they give.
BASE_PHRASES: dict[str, str] = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# The opening or telling passages of widely used licenses, by label.
TEMPLATES: dict[str, str] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "reserved-notice": "Copyright. All rights reserved.",
}
GRAM = 3
MAX_TEMPLATE_WORDS = 50_000
# Diagonals at most so many words apart are one span with words inserted or dropped.
DRIFT = 3
# A span counts if it has at least this share of its template's words, in place.
LEAST_SHARE = 0.6


def license_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n words, by their places; none if there are fewer words."""
    return F.when(
        F.size(hashes) >= n,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def base_places(words: Column, phrases: Mapping[str, str] = BASE_PHRASES) -> Column:
    """(place, label) wherever a phrase's words stand one after another."""
    return F.concat(*[_phrase_places(words, phrase.split(" "), label) for phrase, label in phrases.items()])


def _phrase_places(words: Column, phrase: list[str], label: str) -> Column:
    def stands(i: Column) -> Column:
        later = [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase) if k]
        return reduce(and_, later, i.isNotNull())

    starts = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), stands)
    return F.transform(starts, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))


def template_places(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """(hash, label, place, size, words) of every template k-gram. Bounded by MAX_TEMPLATE_WORDS."""
    if (total := sum(len(t.split()) for t in templates.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of {total} words; at most {MAX_TEMPLATE_WORDS} are broadcast")
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(t).alias("template")) for label, t in templates.items()])
    table = docs.sparkSession.range(1).select(F.inline(rows))
    words = table.select("label", _hashes(license_words(F.col("template"))).alias("words"))
    return words.select(
        "label", F.size("words").alias("size"), F.posexplode(_grams(F.col("words"), gram)).alias("place", "hash")
    )


def _counted(docs: DataFrame, id: str, text: str, templates: DataFrame, gram: int) -> DataFrame:
    """Each text worked through once and stored: its number of words, base places, and k-grams that templates have."""
    known = sorted(r["hash"] for r in templates.select("hash").distinct().collect())  # at most MAX_TEMPLATE_WORDS

    def hit(hash: Column, at: Column) -> Column:
        return F.when(hash.isin(known), F.struct(at.alias("at"), hash.alias("hash")))

    def read(words: Column) -> Column:
        grams = let(_hashes(words), lambda hashes: _grams(hashes, gram))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            base_places(words).alias("places"),
            F.filter(F.transform(grams, hit), lambda x: x.isNotNull()).alias("hits"),
        )

    read_once = let(license_words(F.col(text)), read)  # bound: the optimizer would write the words into every use
    return store(docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_text"), read_once.alias("r")).select(*KEY, "r.*"))


def _votes(counted: DataFrame, templates: DataFrame) -> DataFrame:
    """The template places hit for each (document, template, diagonal); at most a template's length."""
    hits = counted.select(*KEY, F.inline("hits")).join(F.broadcast(templates), "hash")
    return hits.groupBy(*KEY, "label", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places")
    )


def _spans(votes: DataFrame, gram: int, drift: int) -> DataFrame:
    """Neighbouring diagonals of one template as one span: its words in the text, and the share of the
    template's words that stand in it."""
    order = Window.partitionBy(*KEY, "label").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True))
    chained = votes.withColumn("new", new.cast("int")).withColumns(
        {
            "chain": F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "low": F.array_min("places"),
            "high": F.array_max("places"),
        }
    )
    chain = Window.partitionBy(*KEY, "label", "chain")
    length = F.max(F.col("diagonal") + F.col("high") + gram).over(chain) - F.min(F.col("diagonal") + F.col("low")).over(chain)
    in_text = chain.orderBy(F.col("diagonal") + F.col("low"), "diagonal")
    again = F.coalesce(F.col("low") <= F.lag("high").over(in_text), F.lit(False))
    merged = chained.withColumn("again", ((length > 2 * F.col("size")) & again).cast("int")).withColumn(
        "copy", F.sum("again").over(in_text.rowsBetween(Window.unboundedPreceding, 0))
    )
    places = F.array_distinct(F.flatten(F.collect_list("places")))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + gram - 1))))
    return (
        merged.groupBy(*KEY, "label", "size", "chain", "copy")
        .agg(
            F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("places") + gram).alias("end"),
            F.size(covered).alias("covered"),
        )
        .withColumn("share", F.col("covered") / F.col("size"))
    )


KEY = ("_id", "_text")


def find_spans(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    gram: int = GRAM,
    drift: int = DRIFT,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """Verified spans: _id, _text (the text's hash), label, first and end (words), share.

    A span is verified if it holds enough of its template's words and is at most twice as long.
    """
    table = template_places(docs, templates, gram)
    return _verified(_counted(docs, id, text, table, gram), table, gram, drift, least_share)


def _verified(counted: DataFrame, table: DataFrame, gram: int, drift: int, least_share: float) -> DataFrame:
    spans = _spans(_votes(counted, table), gram, drift)
    enough = (F.col("share") >= least_share) & (F.col("end") - F.col("first") <= 2 * F.col("size"))
    return spans.where(enough).select(*KEY, "label", "first", "end", "share")


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    gram: int = GRAM,
    drift: int = DRIFT,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """For each document the base figures, all labels, and the best verified share as score.

    Rows are found again by id and the hash of their text, so rows with the same id and different texts
    are told apart, and rows that are equal get equal results.
    """
    table = template_places(docs, templates, gram)
    base = _counted(docs, id, text, table, gram)
    spans = _verified(base, table, gram, drift, least_share)
    found = spans.groupBy(*[F.col(k).alias(f"{k}2") for k in KEY]).agg(
        F.collect_set("label").alias("own"), F.max("share").alias("share")
    )
    labels = F.transform(F.col("places"), lambda x: x["label"])
    at = F.transform(F.col("places"), lambda x: x["place"])
    joined = base.join(found, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2")), "left")
    return joined.select(
        F.col("_id").alias(id),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union(labels, F.coalesce("own", F.array().cast("array<string>")))), ","
        ).alias("labels"),
        F.coalesce("share", F.lit(0.0)).alias("score"),
    )
