"""License scans by an exact set-similarity join.

A text block is a run of words, wherever it starts and whatever lines it crosses: it begins with a word of the template
and is 1 / THRESHOLD times as long. A template matches a block that holds at least THRESHOLD of the template's distinct
words, all of those that tell its license from others (required), and none that would make it another license
(forbidden); a short template's words must stand in its order. Blocks are joined in overlapping pieces, each twice the longest block, so that every block lies whole in
one piece. The words of the templates are ordered by their frequency over all pieces, rarest first: a block that reaches
the threshold must share a word of the template's prefix (prefix filter), must have enough words (length filter), and
the place of the first shared word bounds how many can follow (positional filter). Pairs that pass the filters are
verified exactly, a piece by each of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.llm.common import ROW, cut, numbered
from civicrill.llm.decontaminate import words_of

#: Base phrases and their labels; fixed values.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Elements of Creative Commons licenses, short and long.
ELEMENTS = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
#: Identifiers of licenses as files state them, with their labels; fixed values.
IDENTIFIERS = (
    ("MIT", "mit"),
    ("ISC", "isc"),
    ("Apache-2.0", "apache-2"),
    ("MPL-2.0", "mpl-2"),
    ("BSD-2-Clause", "bsd-2"),
    ("BSD-3-Clause", "bsd-3"),
    ("GPL-2.0", "gpl-2"),
    ("GPL-3.0", "gpl-3"),
    ("LGPL-2.1", "lgpl-2.1"),
    ("LGPL-3.0", "lgpl-3"),
    ("AGPL-3.0", "agpl-3"),
    ("Unlicense", "unlicense"),
)


def _creative_commons() -> Iterator[tuple[str, str, str, str]]:
    """Both statements of each license of the family; the elements that a license lacks are forbidden."""
    for n in range(3):
        for has in combinations(ELEMENTS, n):
            if {"nd", "sa"} <= set(has):
                continue
            label, lacks = "-".join(("cc-by", *has)), [e for e in ELEMENTS if e not in has]
            yield f"Licensed under CC {' '.join(('BY', *has))} 4.0", label, " ".join(("cc", "by", *has)), " ".join(lacks)
            long = "-".join(("Attribution", *[ELEMENTS[e] for e in has]))
            yield f"This work is licensed under a Creative Commons {long} 4.0 International License", label, " ".join(("creative", "commons", "attribution", *[ELEMENTS[e] for e in has])), " ".join(ELEMENTS[e] for e in lacks)


#: Notices by which licenses are usually stated: text, label, required words (the first is the rarest), forbidden words.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", "associated files granted", ""),
    ("Released under the MIT License.", "mit", "mit", ""),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc", "fee purpose granted", ""),
    ("Licensed under the Apache License, Version 2.0", "apache-2", "apache 2", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2", "mozilla 2", ""),
    ("Licensed under the Mozilla Public License, Version 2.0", "mpl-2", "mozilla 2", ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", "redistribution binary", ""),
    ("Released under the BSD License", "bsd", "bsd", ""),
    ("Released under the GPL License", "gpl", "gpl", ""),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl", "gnu general public", "lesser affero library"),
    *[(f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version", f"gpl-{v}", f"gnu {v} general public", "lesser affero library") for v in (2, 3)],
    *[(f"This work is licensed under the GNU General Public License, version {v}", f"gpl-{v}", f"gnu {v} general public", "lesser affero library") for v in (2, 3)],
    *[(f"Released under the GPLv{v} License", f"gpl-{v}", f"gplv{v}", "") for v in (2, 3)],
    ("This library is licensed under the GNU Lesser General Public License", "lgpl", "lesser gnu general public", ""),
    ("This work is licensed under the GNU Affero General Public License", "agpl", "affero gnu general public", ""),
    ("This is free and unencumbered software released into the public domain", "unlicense", "unencumbered", ""),
    *_creative_commons(),
    ("Licensed under the MIT License", "mit", "mit", ""),
    ("The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "mit", "noninfringement kind", ""),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "bsd", "redistributions retain", ""),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3", "endorse contributors neither", ""),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License", "apache-2", "apache 2 compliance", ""),
    ("Released under the ISC License", "isc", "isc", ""),
    ("Licensed under the ISC License", "isc", "isc", ""),
    *[(f"Licensed under the terms of the GNU General Public License, version {v} or later", f"gpl-{v}", f"gnu {v} general public", "lesser affero library") for v in (2, 3)],
    *[(f"Licensed under GPLv{v}", f"gpl-{v}", f"gplv{v}", "") for v in (2, 3)],
    *[(f"Licensed under {a}GPL version {v}", f"{a}gpl-{v}".lower(), f"{a}gpl {v}".lower(), "") for a, v in (("L", 2.1), ("L", 3), ("A", 3), ("", 2), ("", 3))],
    *[(f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version", f"lgpl-{v}", f"lesser gnu {v} general public", "affero") for v in (2.1, 3)],
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "agpl-3", "affero gnu 3 general public", "lesser"),
    *[(f"SPDX-License-Identifier: {name}", label, f"spdx {name.lower().replace('-', ' ').replace('.', ' ')}", "") for name, label in IDENTIFIERS],
)
#: Labels of any version; left out where a text names a version of theirs.
GENERIC = ("gpl", "lgpl", "agpl", "bsd")
#: A template of so few different words must stand in its own order; words between its own may be missing or added.
SHORT = 8
THRESHOLD = 0.8
#: Templates are held in each task; a longer list is refused.
MAX_TEMPLATES = 10_000


@dataclass(frozen=True)
class Template:
    no: int
    label: str
    words: frozenset[bytes]
    #: Words of the text that one match may take.
    span: int
    required: tuple[bytes, ...]
    forbidden: frozenset[bytes]
    #: Different words in the order of the text, where that order counts.
    order: tuple[bytes, ...] | None

    @property
    def needed(self) -> int:
        return ceil(THRESHOLD * len(self.words) - 1e-9)


def templates(texts=TEMPLATES) -> list[Template]:
    """Numbered templates; each needs a required word, which must be one of its own."""
    if len(texts) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    out = []
    for i, (text, label, required, forbidden) in enumerate(texts):
        ws, must = words_of(text.encode()), tuple(words_of(required.encode()))
        if not must or not set(must) <= set(ws):
            raise ValueError(f"required words of {text!r}")
        own = tuple(dict.fromkeys(ws))
        out.append(Template(i, label, frozenset(ws), ceil(len(ws) / THRESHOLD - 1e-9), must, frozenset(words_of(forbidden.encode())), own if len(own) <= SHORT else None))
    return out


def pieces(words: list[bytes], vocabulary: frozenset[bytes], anchors: frozenset[bytes], run: int) -> Iterator[list[tuple[int, bytes]]]:
    """(place, word) of the vocabulary's words in each 2 * run words, from every run-th word on, that hold an anchor: without one, no template matches."""
    at = {k for place, w in enumerate(words) if w in anchors for k in (place // run - 1, place // run)}
    for k in sorted(k for k in at if k >= 0):
        yield [(place, w) for place, w in enumerate(words[k * run : (k + 2) * run], k * run) if w in vocabulary]


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """Starts (in words) at which a phrase's words stand consecutively, with its label."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        sought, at = b" " + phrase.encode() + b" ", -1
        while (at := line.find(sought, at + 1)) >= 0:
            out.append((line.count(b" ", 0, at), label))
    return out


def blocks(docs: DataFrame, phrases=PHRASES, texts=TEMPLATES, text: str = "text") -> DataFrame:
    """One row per input row, written to the shared folder: n_words, base places, and the pieces: distinct words of templates, and their places."""
    named = templates(texts)
    vocabulary = frozenset().union(*[t.words | t.forbidden for t in named])
    anchors, longest = frozenset(t.required[0] for t in named), max((t.span for t in named), default=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_words, base, found = [], [], []
            for body in pdf["__bytes"]:
                words = words_of(body)
                n_words.append(len(words))
                base.append([{"start": s, "label": k} for s, k in phrase_places(words, phrases)])
                own = [] if anchors.isdisjoint(words) else pieces(words, vocabulary, anchors, longest)
                found.append([{"words": sorted({w.decode() for _, w in ws}), "places": [{"at": i, "word": w.decode()} for i, w in ws]} for ws in own])
            yield pdf.drop(columns="__bytes").assign(n_words=n_words, base=base, pieces=found)

    src = numbered(docs).select(ROW, "doc_id", F.col(text).cast("binary").alias("__bytes"))
    return cut(src.mapInPandas(run, f"{ROW} long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, base array<struct<start:long,label:string>>, pieces array<struct<words:array<string>,places:array<struct<at:int,word:string>>>>"), "licenses")


def similar(found: DataFrame, texts=TEMPLATES) -> DataFrame:
    """(ROW, label, containment) of all block-template pairs that match, the best of each row and label."""
    spark = found.sparkSession
    each = found.select(ROW, F.posexplode("pieces").alias("piece", "p")).select(ROW, "piece", "p.words", "p.places")
    named = templates(texts)
    # one row per word of the template list
    seen = {r["word"]: r["n"] for r in each.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted({w.decode() for t in named for w in t.words}, key=lambda w: (seen.get(w, 0), w)))}
    rows = []
    for t in named:
        order = sorted((w.decode() for w in t.words), key=rank.__getitem__)
        must, never = [w.decode() for w in t.required], [w.decode() for w in t.forbidden]
        text = [w.decode() for w in t.order] if t.order else None
        rows += [(w, t.no, t.label, order, must, never, text, t.needed, t.span, place) for place, w in enumerate(order[: len(order) - t.needed + 1])]
    prefix = spark.createDataFrame(rows, "word string, no int, label string, template array<string>, required array<string>, forbidden array<string>, stated array<string>, needed int, span int, place int")
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    known = F.filter("words", lambda w: ranks[w].isNotNull())
    sorted_words = F.transform(F.sort_array(F.transform(known, lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))), lambda s: s["w"])
    probes = each.select(ROW, "piece", "places", sorted_words.alias("words")).select(ROW, "piece", "places", "words", F.posexplode("words").alias("at", "word"))
    pairs = (
        probes.join(F.broadcast(prefix), "word")
        .filter(F.size("words") >= F.col("needed"))
        # the pair's first shared word only, and with it as many more as both sides still hold
        .filter(1 + F.least(F.size("words") - F.col("at") - 1, F.size("template") - F.col("place") - 1) >= F.col("needed"))
        .filter(F.col("place") == F.array_position("template", F.array_intersect("template", "words")[0]) - 1)
    )
    near = pairs.filter((F.size(F.array_except("required", "words")) == 0) & (F.size(F.array_intersect("words", "template")) >= F.col("needed")))

    def held(block: Column) -> Column:
        """Words of the template in a block, or null where the block is another license's or none's."""
        fits = (F.size(F.array_except("required", block)) == 0) & ~F.arrays_overlap(block, F.col("forbidden"))
        # both without repeats and in the order of their first array
        fits &= F.col("stated").isNull() | (F.array_intersect(block, "stated") == F.array_intersect("stated", block))
        return F.when(fits, F.size(F.array_intersect(block, "template")))

    starts = F.filter("places", lambda p: F.array_contains("template", p["word"]))
    block = lambda p: F.transform(F.filter("places", lambda q: (q["at"] >= p["at"]) & (q["at"] < p["at"] + F.col("span"))), lambda q: q["word"])
    best = near.withColumn("held", F.array_max(F.transform(F.transform(starts, block), held)))
    return best.filter(F.col("held") >= F.col("needed")).groupBy(ROW, "label").agg(F.max(F.col("held") / F.size("template")).alias("containment"))


def scan(docs: DataFrame, phrases=PHRASES, texts=TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a base phrase stands, else the best containment, else 0. Null text has no words. Phrases and
    templates may run over lines. Repeated rows and ids stay apart; other columns are ignored.
    """
    found = blocks(docs.select("doc_id", "text"), phrases, texts)
    best = similar(found, texts).groupBy(ROW).agg(F.collect_list("label").alias("own"), F.max("containment").alias("best"))
    base = F.transform("base", lambda b: b["label"])
    own = F.coalesce("own", F.array().cast("array<string>"))
    exact = F.filter(own, lambda x: ~(x.isin(*GENERIC) & F.exists(F.concat(base, own), lambda y: y.startswith(F.concat(x, F.lit("-"))))))
    return found.drop("pieces").join(best, ROW, "left").select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, exact))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
