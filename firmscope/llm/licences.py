"""Licence scan in DataFrame functions alone: licence names at fixed places,
and a positional index of rare licence words.

The templates are openings and notices of known licences. Their words are
counted over all documents, and the words of highest inverse document
frequency of each template enter a positional index (word, template, place). A
file's index words (two different ones at least) are looked up; each gives the
place where the template would begin. Where two or more agree, the template is
a candidate, and it is reported if all its mandatory key phrases stand in the file near the places
they have in the template. The index is a fixed number of rows, whatever the
corpus; documents are read twice and never shuffled.

``score`` is the greatest share of a verified template's words that stand at
their places, at least ``NAMED`` where a licence is named, and 0 without any.

Rows: a null text is an empty one and has no words. Rows that repeat a text or
a doc_id get a result each. Ties between index words are settled by the word.
Work grows with the words of a text and the places found, so very long texts
take part like any other. Empty tables give an empty result. Extra columns are
not read. Only A-Z count as capitals, but for the Kelvin sign, which becomes k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.decontaminate import SEPARATORS
from firmscope.llm.spans import let

# fixed values: licence names and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # lower case, words apart by one space
    keys: tuple[str, ...]  # mandatory phrases of the text


# fixed values: openings and notices of public licences, with their mandatory phrases
TEMPLATES = [
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "software and associated documentation files", "to deal in the software without restriction")),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "except in compliance with the license")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("is free software", "gnu general public license", "free software foundation")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("is free software", "gnu lesser general public license", "free software foundation")),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("is free software", "gnu affero general public license", "free software foundation")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("accompanying materials", "eclipse public license")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute", "with or without fee is hereby granted")),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy", "covered by this license")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "authors be held liable for any damages")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
]
#: Index words of a template: this share of its distinct words, and so many at least.
INDEX_SHARE, INDEX_LEAST = 0.5, 3
#: Words by which a key phrase may stand away from its place.
DRIFT = 8
#: Score of a licence's name alone.
NAMED = 0.5


def plain(text: Column) -> Column:
    """The words of a text, apart by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def _words(normal: Column) -> Column:
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def build_index(docs: DataFrame, text_col: str = "text", templates: list[Template] = TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, template, place): the words of highest inverse document
    frequency of each template. Counts go over all documents; at most one row
    for each word of the templates comes to the driver."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    present = docs.select(F.array_intersect(_words(plain(F.col(text_col))), _texts(vocabulary)).alias("w"))
    # a row without licence words still counts as a document
    counts = {r.word: r.n for r in present.select(F.explode_outer("w").alias("word"), F.lit(1).alias("one")).groupBy("word").agg(F.count("one").alias("n")).collect()}
    n = docs.count()
    idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}
    index = []
    for i, t in enumerate(templates):
        words = t.text.split()
        size = max(INDEX_LEAST, math.ceil(INDEX_SHARE * len(set(words))))
        rare = set(sorted(set(words), key=lambda w: (-idf[w], w))[:size])
        index += [(w, i, q) for q, w in enumerate(words) if w in rare]
    return index


def _named(normal: Column, words: Column) -> Column:
    """array<struct<start, label>>: where the phrases stand."""
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    none = F.array().cast("array<struct<start:int,label:string>>")

    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()

        def stands(i: Column) -> Column:
            here = F.get(words, i) == first
            for j, p in enumerate(rest, 1):
                here = here & (F.get(words, i + j) == p)
            return F.coalesce(here, F.lit(False))

        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
        return F.when(F.contains(padded, F.lit(f" {phrase} ")), F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))).otherwise(none)

    return F.concat(*[places(phrase, label) for phrase, label in PHRASES.items()])


def _verified(words: Column, index: list[tuple[str, int, int]], templates: list[Template]) -> Column:
    """array<struct<label, start, share>> of the templates that index words
    place at one point of the file and whose key phrases are there."""
    rare = sorted({w for w, _, _ in index})
    postings = F.create_map(*[c for w in rare for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for x, t, q in index if x == w]))])
    none = F.array().cast("array<struct<label:string,start:int,share:double>>")

    def phrase_places(t: Template) -> Column:
        spots = []
        for k in t.keys:
            at = f" {t.text} ".index(f" {k} ")
            spots.append(F.struct(F.lit(len(t.text[:at].split())).alias("q"), _texts(k.split()).alias("words")))
        return F.array(*spots)

    known = F.array(*[F.struct(F.lit(t.label).alias("label"), _texts(t.text.split()).alias("words"), phrase_places(t).alias("keys")) for t in templates])

    def stands_near(at: Column, key: Column) -> Column:
        first = at + key["q"] + 1
        return F.exists(F.sequence(F.lit(-DRIFT), F.lit(DRIFT)), lambda d: F.when(first + d >= 1, F.slice(words, F.greatest(first + d, F.lit(1)), F.size(key["words"])) == key["words"]).otherwise(False))

    def share(at: Column, own: Column) -> Column:
        held = F.filter(F.transform(own, lambda w, q: F.get(words, at + q) == w), lambda x: F.coalesce(x, F.lit(False)))
        return F.size(held) / F.size(own)

    def judged(v: Column) -> Column:
        return let(F.get(known, v["t"]), lambda t: F.when(F.forall(t["keys"], lambda key: stands_near(v["at"], key)), F.struct(t["label"].alias("label"), v["at"].alias("start"), share(v["at"], t["words"]).alias("share"))))

    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.element_at(postings, w).alias("p"))), lambda s: s["p"].isNotNull())
    votes = F.array_sort(F.flatten(F.transform(places, lambda s: F.transform(s["p"], lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["q"]).alias("at"))))))
    agreed = let(votes, lambda v: F.array_distinct(F.filter(v, lambda x, i: F.coalesce(F.get(v, i + 1) == x, F.lit(False)))))
    found = F.filter(F.transform(agreed, judged), lambda x: x.isNotNull())
    return F.when(F.size(F.array_intersect(words, _texts(rare))) >= 2, found).otherwise(none)


def scan(docs: DataFrame, index: list[tuple[str, int, int]], id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """(id, n_words, named, verified): the places of licence names, and the
    templates found, as arrays of (start, label) and (label, start, share)."""
    none = F.array().cast("array<struct<label:string,start:int,share:double>>")
    normal = docs.select(F.col(id_col), plain(F.col(text_col)).alias("normal"))

    def both(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _named(F.col("normal"), w).alias("named"), (_verified(w, index, templates) if index else none).alias("verified"))

    return normal.select(id_col, let(_words(F.col("normal")), both).alias("s")).select(id_col, "s.*")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    starts = F.transform("named", lambda s: s["start"].cast("long"))
    base, own = F.transform("named", lambda s: s["label"]), F.transform("verified", lambda s: s["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform("verified", lambda s: s["share"])), F.lit(0.0))
    return scanned.select(
        id_col, "n_words", F.size("named").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"), F.greatest(best, F.when(F.size("named") > 0, NAMED).otherwise(0.0)).alias("score"))
