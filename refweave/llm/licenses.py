"""License scans with a positional rare-token index, in DataFrame expressions only.

Phrases give the base places.  For whole notices, the index maps each rare word of the
templates (high inverse document frequency among them) to its postings: template and
position.  A word of a file at position ``i`` and a posting at position ``j`` vote for the
template beginning at word ``i - j``.  Words may be put in or left out, such as the signs of a comment at the begin
of each line, so beginnings within ``TOLERANCE`` words count together.  The template with enough of its rare words at one
beginning is aligned, and counts if its mandatory key phrase stands in the file and all words of the phrase vote for
that beginning too.

Only files with a key phrase are aligned.  The index has a few hundred rows, fixed by the templates, so it is broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from refweave.llm.common import text_of, with_matches, written
from refweave.operators.joins import join_unique

#: What stands between words; A-Z count as letters, which is the same as lower-casing them before.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOLERANCE = 8  # words put in or left out before the beginning seems another one
ALIGNED = 0.6  # share of a template's rare words at one beginning
COMMON = 3  # templates that a rare word is in, at most

# Phrases, and notices with their mandatory key phrases.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation",
        "permission is hereby granted free of charge",
    ),
    "apache-2": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing",
        "apache org licenses license 2",
    ),
    "bsd-3": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list",
        "redistribution and use in source and binary forms",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version",
        "gnu general public license",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
        "gnu lesser general public license",
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
        "not distributed with this file you can obtain one at https mozilla org",
        "mozilla public license",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software",
        "unencumbered software released into the public domain",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit",
        "creative commons attribution 4",
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy",
        "creative commons attribution sharealike",
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy",
        "creative commons attribution noncommercial",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for "
        "any damages arising from the use of this software",
        "in no event will the authors be held liable for any damages",
    ),
    "bsl-1": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit",
        "accompanying documentation covered by this license",
    ),
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
        "public license as published by the free software foundation either version",
        "gnu affero general public license",
    ),
    "proprietary": (
        "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means",
        "all rights reserved",
    ),
}


def index(templates: dict[str, tuple[str, str]] = TEMPLATES, common: int = COMMON) -> list[tuple[str, str, int, bool, float]]:
    """``(word, label, position, is_rare, idf)`` of the rare words of each template and of those of its key phrase."""
    words = {label: text.split() for label, (text, _) in templates.items()}
    frequency: dict[str, int] = {}
    for some in words.values():
        for w in set(some):
            frequency[w] = frequency.get(w, 0) + 1
    out = []
    for label, some in words.items():
        must = _phrase_places(some, templates[label][1].split())
        for j, w in enumerate(some):
            rare = frequency[w] <= common
            if rare or j in must:
                out.append((w, label, j, rare, math.log(len(templates) / frequency[w])))
    return out


def _phrase_places(words: list[str], phrase: list[str]) -> range:
    """Where the key phrase stands in its template."""
    for j in range(len(words) - len(phrase) + 1):
        if words[j : j + len(phrase)] == phrase:
            return range(j, j + len(phrase))
    raise ValueError(f"the key phrase {' '.join(phrase)!r} does not stand in its template")


def _phrase(words: str) -> str:
    return rf"(?i)(?<= ){words}(?= )"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def scan(
    df: DataFrame,
    key: str,
    text: str,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """Licenses per row: ``(key, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``n_base`` counts the places of all ``phrases``, which must not overlap themselves; ``labels`` also
    has aligned templates; ``score`` is 1 for a phrase, else the best aligned share, else 0.
    A null or empty text has no words and no labels.  Rows with the same key and text have the
    same result each; null keys are allowed.  Other columns are not carried.
    """
    spark = df.sparkSession
    postings = index(templates)
    n_rare = {label: max(1, sum(r for _, x, _, r, _ in postings if x == label)) for label in templates}
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(text_of(text), _BETWEEN, " ")), F.lit(" "))
    rows = df.select(F.col(key).alias("_key"), norm.alias("_norm"), text_of(text).alias("_text"))
    for n, phrase in enumerate(phrases):
        possible = F.col("_norm").rlike(_phrase(phrase))
        rows = with_matches(rows, f"_p{n}", "_norm", _phrase(phrase), possible, _spaces)
        # Each word has one space before it.
        rows = rows.withColumn(f"_p{n}", F.transform(f"_p{n}", lambda f: f["start"] - 1))
    every = F.concat(*[F.col(f"_p{n}") for n in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{n}") > 0, F.lit(x)) for n, x in enumerate(phrases.values())]))
    hints = sorted({max(p.split(), key=len) for _, p in templates.values()})
    hinted = F.col("_norm").rlike("(?i) (?:" + "|".join(map(re.escape, hints)) + ") ")
    verified = F.array_compact(
        F.array(*[F.when(F.col("_norm").rlike(f"(?i) {re.escape(p)} "), F.lit(x)) for x, (_, p) in templates.items()])
    )
    found = written(
        rows.select(
            "_key",
            F.when(F.col("_norm") == "  ", 0).otherwise(_spaces(F.col("_norm")) - 1).cast("bigint").alias("n_words"),
            F.size(every).cast("bigint").alias("n_base"),
            F.array_min(every).cast("bigint").alias("first_word"),
            F.array_max(every).cast("bigint").alias("last_word"),
            F.array_sort(F.array_distinct(base)).alias("_base"),
            F.when(hinted, verified).otherwise(F.array().cast("array<string>")).alias("_verified"),
            "_norm", "_text",
        ).select(
            "_key", "n_words", "n_base", "first_word", "last_word", "_base", "_verified",
            F.when(F.size("_verified") > 0, F.split(F.lower(F.trim("_norm")), " ")).alias("_words"),
            F.when(F.size("_verified") > 0, F.md5(F.concat(F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(":"), F.col("_text")).cast("binary"))).alias("_row"),
        ),
        "licenses",
    )
    places = {x: _phrase_places(t.split(), p.split()) for x, (t, p) in templates.items()}
    rows_ = [(w, x, j, j // 62, j % 62 if rare else None, j % 62 if j in places[x] else None) for w, x, j, rare, _ in postings]
    table = spark.createDataFrame(rows_, "word string, label string, j int, part int, bit int, must int")
    # A beginning is in two ranges of twice the tolerance, so that near ones share at least one.
    at = F.floor((F.col("i") - F.col("j")) / TOLERANCE)
    set_bit = lambda c: F.bit_or(F.coalesce(F.expr(f"shiftleft(1L, {c})"), F.lit(0)))
    votes = (
        found.where(F.col("_row").isNotNull())
        .select("_row", "_verified", F.posexplode("_words").alias("i", "word"))
        .join(F.broadcast(table), "word")
        .where(F.array_contains("_verified", F.col("label")))
        .select("_row", "label", "part", "bit", "must", F.explode(F.array(at, at - 1)).alias("begin"))
        .groupBy("_row", "label", "begin", "part")
        # Bits, so that a repeated row does not count twice; 62 positions of a template to a number.
        .agg(set_bit("bit").alias("bits"), set_bit("must").alias("musts"))
        .groupBy("_row", "label", "begin")
        .agg(F.sum(F.bit_count("bits")).alias("n"), F.sum(F.bit_count("musts")).alias("n_must"))
    )

    def of_label(values: dict[str, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("label"))

    votes = votes.where(F.col("n_must") == of_label({x: len(r) for x, r in places.items()}))
    share = F.col("n") / of_label(n_rare)
    aligned = (
        votes.withColumn("share", share).where(F.col("share") >= ALIGNED)
        .groupBy("_row").agg(F.collect_set("label").alias("_aligned"), F.max("share").alias("_share"))
    )
    plain = found.where(F.col("_row").isNull()).drop("_words", "_row", "_verified").withColumns(
        {"_aligned": F.array().cast("array<string>"), "_share": F.lit(None).cast("double")}
    )
    marked = join_unique(found.where(F.col("_row").isNotNull()).drop("_words", "_verified"), aligned, ["_row"], "left").drop("_row")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_aligned", F.array().cast("array<string>"))))
    return plain.unionByName(marked).select(
        F.col("_key").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
