"""License scans: exact set-similarity (containment) join of text blocks with license templates.

Method. Every text is cut into word blocks of twice the longest template, overlapping by half. Template tokens are
ordered by their frequency in the whole corpus, rarest first. A block can hold a share of at least ``threshold`` of a
template only if it has one of the template's first ``size - need + 1`` tokens (prefix filter), at least ``need``
vocabulary tokens (length filter), and enough of them left after its first match in that order (positional filter);
the blocks that pass are compared exactly. No qualifying block is lost. Templates with ``threshold`` 1 and
``phrase=True`` are found through the same candidates and then confirmed word by word, giving exact places.

Templates of different labels can share most of their words (the versions of one license). Where one of them would itself
pass for the other they are rivals: a match falls to a rival that a block beside or around it holds to a greater share.

The templates are a parameter and don't grow with the corpus, so they travel as literals in the plan: the join is local to
each row, needs no shuffle and keeps hot sources and repeated rows harmless. Their tokens may be of any number and script.

Edge cases: null or wordless text gives zero words, no labels and score 0; one output row per input row, null and
repeated ids included; a template longer than the text simply cannot match; extra columns are kept untouched unless
they bear one of the result names, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import documents, held, let, unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    threshold: float = 0.8
    phrase: bool = False

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.words))

    @property
    def need(self) -> int:
        return max(1, math.ceil(self.threshold * len(self.tokens) - 1e-9))


def template(label: str, text: str, threshold: float = 0.8, phrase: bool = False) -> Template:
    low = text.replace("\u212a", "\ue000").replace("\u0130", "\ue000").lower()
    words = tuple("".join(c if (not c.isascii() or c.isalnum()) else " " for c in low).split(" "))
    return Template(label, tuple(w for w in words if w), threshold, phrase)


BASE = (
    template("cc-by", "cc by", 1.0, True),
    template("gpl", "general public license", 1.0, True),
    template("reserved", "all rights reserved", 1.0, True),
)
NOTICES = (
    template("mit", "Released under the MIT License."),
    template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    template("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    template("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    template("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    template("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    template("lgpl", "Licensed under the GNU Lesser General Public License"),
    template("agpl", "Licensed under the GNU Affero General Public License"),
    template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    template("cc0", "Dedicated to the public domain under CC0 1.0 Universal"),
    template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def rivals(templates: tuple[Template, ...]) -> list[tuple[int, int]]:
    """Places of templates with different labels of which one's words would pass for the other."""
    passes = lambda s, t: len(set(s.tokens) & set(t.tokens)) >= t.need
    return [(i, j) for i, s in enumerate(templates) for j, t in enumerate(templates) if s.label != t.label and (passes(s, t) or passes(t, s))]


def words(text: Column) -> Column:
    """Words of a text in lower case; a null text has none.

    ``lower`` is much cheaper than ``translate``. It also lowers other letters, as templates do; the two characters whose
    lower case has ASCII letters are replaced first.
    """
    plain = F.coalesce(text, F.lit(""))
    for c in ("\u212a", "\u0130"):
        plain = F.replace(plain, F.lit(c), F.lit("\ue000"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def _strings(values) -> Column:
    return F.split(F.lit(" ".join(values)), " ")  # words hold no blanks: one literal however many there are


def token_order(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> list[str]:
    """All template tokens, rarest first by the number of documents that hold them. The result is bounded by the templates."""
    vocabulary = sorted({w for t in templates for w in t.tokens})
    held = docs.select(F.explode(F.array_intersect(words(F.col(text)), _strings(vocabulary))).alias("token"))
    n = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _at(positions: Column, w: Column, t: Template, order: dict[str, int]) -> Column:
    """Starts of a phrase: its rarest token is the candidate, the words around it the confirmation."""
    rare = min(t.words, key=order.__getitem__)
    off, n = t.words.index(rare), len(t.words)
    found = F.filter(positions, lambda p: (F.get(w, p) == rare) & (p >= off) & (F.slice(w, F.greatest(p - off, F.lit(0)) + 1, n) == _strings(t.words)))
    return F.transform(found, lambda p: p - off)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``phrases`` (array of label, start), ``matches`` (array of label, block, template, score) and ``block_words``."""
    order = token_order(docs, templates, text)
    rank = {w: k for k, w in enumerate(order)}
    step = max(len(t.words) for t in templates)
    phrases, notices = [t for t in templates if t.phrase], [t for t in templates if not t.phrase]
    ranked = {t: sorted(t.tokens, key=rank.__getitem__) for t in templates}
    prefix = {t: ranked[t][: len(ranked[t]) - t.need + 1] for t in templates}
    signal = sorted({w for t in templates for w in prefix[t]})
    ranks = F.map_from_arrays(_strings(order), F.sequence(F.lit(0), F.lit(len(order) - 1)))

    own_w, own_p, own_b = unused([*docs.columns, "n_words", "phrases", "matches", "block_words"], "w", "p", "b")
    out = held(docs, **{own_w: words(F.col(text))}).withColumn("n_words", F.size(own_w).cast("long"))
    w = F.col(own_w)
    out = held(out, **{own_p: F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(signal), i)))})
    p = F.col(own_p)

    # blocks k = words [k*step, (k+2)*step): each with a prefix token, as the ranks of its vocabulary tokens
    def block(k):
        mine = F.array_intersect(F.slice(w, k * step + 1, 2 * step), _strings(order))
        return F.struct(k.alias("block"), F.array_sort(F.transform(mine, lambda x: F.element_at(ranks, x))).alias("ranks"))

    ids = F.array_distinct(F.flatten(F.transform(p, lambda x: F.array((x / step).cast("int"), F.greatest((x / step).cast("int") - 1, F.lit(0))))))
    out = out.withColumn(own_b, F.when(F.size(p) > 0, F.transform(ids, block)).otherwise(F.array().cast("array<struct<block:int,ranks:array<int>>>")))

    def matches(t: Template) -> Column:
        mine = F.array(*[F.lit(rank[x]) for x in ranked[t]])
        first = F.array(*[F.lit(rank[x]) for x in prefix[t]])
        n, need = len(ranked[t]), t.need

        def passes(b):
            here = b["ranks"]
            match = F.array_intersect(first, here)  # in template order: its first entry is the earliest match
            i, j = F.array_position(mine, F.get(match, F.lit(0))), F.array_position(here, F.get(match, F.lit(0)))
            bound = 1 + F.least(F.lit(n) - i, F.size(here) - j)
            return (F.size(here) >= need) & (F.size(match) > 0) & (bound >= need)

        exact = F.transform(F.filter(F.col(own_b), passes), lambda b: F.struct(F.lit(t.label).alias("label"), b["block"].alias("block"), F.lit(notices.index(t)).alias("template"), (F.size(F.array_intersect(b["ranks"], mine)) / F.lit(n)).alias("score")))
        return F.filter(exact, lambda m: m["score"] * n >= need - 1e-9)

    empty_p, empty_m = F.array().cast("array<struct<label:string,start:int>>"), F.array().cast("array<struct<label:string,block:int,template:int,score:double>>")

    pairs = [i * len(notices) + j for i, j in rivals(tuple(notices))]
    rival = F.split(F.lit(",".join(map(str, pairs or [-1]))), ",").cast("array<int>")

    def best(found: Column) -> Column:
        """Matches that no rival beats in their block or one that overlaps it."""
        beaten = lambda m: F.exists(found, lambda o: (o["score"] > m["score"]) & (F.abs(o["block"] - m["block"]) <= 1) & F.array_contains(rival, m["template"] * len(notices) + o["template"]))
        return F.when(F.size(found) > 1, F.filter(found, lambda m: ~beaten(m))).otherwise(found)

    def labelled(t: Template) -> Column:
        return F.transform(_at(p, w, t, rank), lambda s: F.struct(F.lit(t.label).alias("label"), s.alias("start")))

    starts = [labelled(t) for t in phrases]
    out = held(
        out,
        phrases=F.when(F.size(p) > 0, F.concat(empty_p, *starts)).otherwise(empty_p),
        matches=F.when(F.size(p) > 0, let(F.concat(empty_m, *[matches(t) for t in notices]), best)).otherwise(empty_m),
    )
    return out.withColumn("block_words", F.lit(2 * step)).drop(own_w, own_p, own_b)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda m: m["label"]) for x in c]))), ",")
    starts = F.transform("phrases", lambda x: x["start"])
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels("phrases").alias("base_labels"), labels("phrases", "matches").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0)).alias("score"),
    )

