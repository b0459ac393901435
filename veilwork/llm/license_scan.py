"""Licence scan with a positional rare-token index, in DataFrame functions only.

Templates are word sequences with a label and a mandatory key phrase. The index lists, for the
highest-IDF words of each template, at which offsets they stand (postings). A file's occurrences of
these rare words are looked up; each posting proposes the template at one relative position (file
position minus offset), proposals that agree are one alignment. An alignment counts when the key
phrase's words stand consecutively at its place and enough of the template's IDF weight matches.
Every key phrase holds at least one indexed word, so no place is missed. Everything happens within
the row, without a shuffle; the index is a constant of the plan.

Defined cases: null counts as empty (no words, score 0); repeated rows give repeated results; ties
between templates only merge labels; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, text, True)


DEFAULT_TEMPLATES = (
    _phrase("gpl", "gnu general public license"),
    _phrase("apache", "apache license"),
    _phrase("cc-by", "cc by"),
    _phrase("mit", "mit license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    Template(
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "terms of the gnu general public license",
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "source and binary forms with or without modification",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "any purpose with or without fee is hereby granted",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "unencumbered software released into the public domain",
    ),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("cc0", "creative commons zero public domain dedication", "creative commons zero"),
    Template("proprietary", "copyright all rights reserved", "all rights reserved"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Before lower-casing, so A-Z are word characters too.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def idf_weights(templates) -> dict[str, float]:
    """ln(1 + templates / templates with the word), over the template collection."""
    df = Counter(w for t in templates for w in set(t.words))
    return {w: math.log(1 + len(templates) / n) for w, n in df.items()}


def rare_postings(templates, per_template: int = 2) -> dict[str, list[tuple[int, int]]]:
    """Word -> (template number, offset) of the ``per_template`` highest-IDF words of each key phrase."""
    idf, index = idf_weights(templates), {}
    for no, t in enumerate(templates):
        keep = sorted(set(t.key_words), key=lambda w: (-idf[w], w))[: 1 if t.base else per_template]
        for at, w in enumerate(t.words):
            if w in keep:
                index.setdefault(w, []).append((no, at))
    return index


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=DEFAULT_TEMPLATES,
    min_coverage: float = 0.6,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    idf, index = idf_weights(templates), rare_postings(templates)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def constant(values, kind) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")

    table = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"),
            F.lit(t.base).alias("base"),
            constant(t.words, "string").alias("words"),
            constant([idf[w] for w in t.words], "double").alias("idf"),
            F.lit(sum(idf[w] for w in t.words)).alias("total"),
            F.lit(t.key_at).alias("key_at"),
            F.lit(len(t.key_words)).alias("key_size"),
            F.lit(t.key).alias("key"),
        )
        for t in templates
    ])
    postings = F.create_map(*[
        c
        for w, ps in index.items()
        for c in (F.lit(w), F.array(*[F.struct(F.lit(no).alias("no"), F.lit(at).alias("at")) for no, at in ps]))
    ])

    def plain(word: Column) -> Column:
        return F.translate(word, _UPPER, _LOWER)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1)).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    rare = list(index)
    hits = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.lower(F.get("words", i)).isin(rare))
    rows = rows.withColumn("hits", F.when(F.col("n") > 0, hits).otherwise(F.array().cast("array<int>")))
    proposed = F.flatten(
        F.transform(
            "hits",
            lambda h: F.transform(
                F.coalesce(F.try_element_at(postings, plain(F.get("words", h))), F.array().cast("array<struct<no:int,at:int>>")),
                lambda p: F.struct(p["no"].alias("no"), (h - p["at"]).alias("start")),
            ),
        )
    )
    rows = rows.withColumn("proposed", F.array_distinct(F.when(F.size("hits") > 0, proposed)))

    def judged(p: Column) -> Column:
        t = F.get(table, p["no"])
        start = p["start"]
        key_from = start + t["key_at"]
        key = F.array_join(F.transform(F.slice(F.col("words"), F.greatest(key_from, F.lit(0)) + 1, t["key_size"]), plain), " ")
        weight = F.aggregate(
            F.sequence(F.lit(0), F.size(t["words"]) - 1),
            F.lit(0.0),
            lambda acc, j: acc
            + F.when(
                (start + j >= 0) & (plain(F.get("words", start + j)) == F.get(t["words"], j)), F.get(t["idf"], j)
            ).otherwise(0.0),
        )
        return F.struct(
            ((key_from >= 0) & (key == t["key"])).alias("found"),
            t["base"].alias("base"),
            t["label"].alias("label"),
            start.alias("start"),
            F.when(t["base"], 1.0).otherwise(F.round(weight / t["total"], 6)).alias("coverage"),
        )

    rows = rows.withColumn("judged", F.transform("proposed", judged))
    rows = rows.withColumn("places", F.filter("judged", lambda j: j["found"] & (j["coverage"] >= min_coverage)))
    rows = rows.withColumn("base", F.filter("places", lambda j: j["base"]))
    starts = F.transform("base", lambda j: j["start"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda j: j["label"]))), ",")
    none = F.lit("")
    return rows.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(joined("base"), none).alias("base_labels"),
        F.coalesce(joined("places"), none).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda j: j["coverage"])), F.lit(0.0)).alias("score"),
    )
