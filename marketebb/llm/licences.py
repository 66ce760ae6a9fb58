"""Licence scan: a trained paragraph classifier, confirmed by templates, with DataFrame functions alone.

A paragraph is a run of lines up to a blank line or the end of a sentence; comment marks before and after lines do not belong to it, so a
notice is one whatever the width it is wrapped at. Its features are word unigrams and bigrams. A multinomial logistic regression with an L1
penalty tells licence families from ``none``; it is trained on worn copies of the templates below (words dropped, corpus
words around them), on sentences about licences of no known family, and on every distinct paragraph of the corpus that is surely none.
Paragraphs with the same n-grams of the templates are one row with their number: the model sees no others, so this is the same sum. Where more
than ``MASS`` paragraphs teach, all get the same smaller weight, such that together they weigh ``MASS``; none is left out. Words around the
worn copies are drawn by the share of all those paragraphs that begin with them. The probability that a family needs is calibrated on a
held-back half of the paragraphs: the least one that lets through at most ``FALSE_SHARE`` of them, exactly. A prediction stands if the share of a
template's bigrams in the paragraph reaches ``CONFIRM``; a paragraph that is about a licence but is no confirmed family is ``unknown``.

A paragraph that may be a licence line itself is no negative: it speaks of licences (``ABOUT``), holds a sentence of
a template, shares a run of ``RUN`` words with one, or has a quarter of its bigrams. What one copy does
not say, it cannot hide in all the others.

The weights are a literal of bounded size. Anchors are the words of the templates that no negative of the whole corpus has, and, whatever the
corpus has, the words ``ABOUT`` licences and the telling phrases of the templates (two content words, at most one small word
between them). A paragraph without an anchor is ``none`` by rule, so one search over the text sets it aside. Texts are never
shuffled: training moves a hash and the template n-grams of each paragraph, the scan is one map over the documents.

Nulls: a null text has no paragraphs, a null doc_id stays. Equal rows are scanned each, and teach once. Texts and paragraphs of any length count whole. Of
families with equal probability the first in the order of the templates is taken. Paragraphs are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketebb.llm.shared import discard, stage

# Usual notices of licence families, and sentences about licences of none of them.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Distributed under the GNU Lesser General Public License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "unknown": (
        "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Licensed under the terms of our company license agreement.",
        "This material is licensed for internal use only.",
        "The license of this package is not known.",
        "Proprietary and confidential, see the license file for details.",
    ),
}
NONE, UNKNOWN = "none", "unknown"
MASS, COPIES, FALSE_SHARE, CONFIRM, PENALTY = 2_000, 30, 0.002, 0.5, 2e-3
#: Words around a worn copy come from as many first words of a paragraph; parts into which the search for a threshold cuts its range.
OPENING, PARTS = 8, 1_000
#: Words of licence lines alone, words that tell nothing, and the run of words that a line of no licence does not share.
ABOUT = ("license", "licensed", "licence", "licenced", "copyright")
SMALL = frozenset("a all an and any are as by can file following for from in is it may not of on or person project software that the this to under use with you work".split())
RUN = 4


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)?"), 0)


def _ngrams(ws: Column) -> Column:
    pairs = F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(ws, pairs)


def ngrams(ws: Column) -> Column:
    """Distinct unigrams and bigrams of a paragraph."""
    return F.array_distinct(_ngrams(ws))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def unwrapped(text: Column) -> Column:
    """The paragraphs of a text, one on each line."""
    return _once(text, _unwrapped)


def _unwrapped(text: Column) -> Column:
    # the patterns begin with the characters they look for, and most texts have no line that ends in blanks or a mark
    ends = reduce(or_, (text.contains(x) for x in ("\r", " \n", "\t\n", "*/\n", "-->\n")))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*+(?:/\*++|\*++/?|//++|#++|--++|;++|%++|<!--)?[ \t]*+", "")
    text = F.when(ends, F.regexp_replace(text, r"[ \t](?<![ \t]{2})[ \t]*+(?:(?:\*/|-->)[ \t]*+)?(?=\n)|(?:\*/|-->)[ \t]*+(?=\n)", "")).otherwise(text)
    return F.regexp_replace(text, r"\n(?!\n)(?<!\n\n)(?<![.!?][^\p{L}\p{N}\n]{0,8}\n)", " ")


def _search(anchors: list[str]) -> str:
    """A pattern for texts with one of the anchors, sorted out by their first characters."""
    apart = r"[^\p{L}\p{N}]++"
    first: dict[str, list[str]] = {}
    for a in sorted(anchors):
        head, *rest = a.split(" ")
        first.setdefault(head[0], []).append(apart.join(map(re.escape, [head[1:], *rest])))
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(xs)})" for c, xs in first.items()) + r")(?![\p{L}\p{N}])"


def paragraphs(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """(doc_id, paragraph, grams): the paragraphs with an anchor, counted from 0 with all and with blank lines, and their n-grams.

    The nested lambdas see to it that words and n-grams of a line are computed once, however often they are used.
    """
    search = _search(anchors)
    spoken = F.transform(F.split(unwrapped(F.lower("text")), "\n"), lambda x: F.when(x.rlike(search), words(x)))
    lines = F.transform(spoken, lambda ws: F.when(ws.isNotNull(), ngrams(ws)))
    some = docs.where(F.lower("text").rlike(search))
    return some.select("doc_id", F.posexplode(lines).alias("paragraph", "grams")).where(F.col("grams").isNotNull())


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sentences(), "family string, template string")


def sentences() -> list[tuple[str, str]]:
    """(family, text) of the templates, and of each of their sentences where they have several."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            parts = [x for x in re.split(r"(?<=[a-z]\.) ", text) if len(_spoken(x)) > 2]
            out += [(family, x) for x in dict.fromkeys([text, *parts])]
    return out


def _spoken(text: str) -> list[str]:
    """The words of a text, as ``words`` finds them."""
    return re.findall(r"[^\W_]+(?:\.[0-9]+)?", text.lower())


def phrases() -> list[str]:
    """Pairs of content words of the templates, with at most one small word between them."""
    out = set()
    for _, text in sentences():
        ws = _spoken(text)
        for i, w in enumerate(ws[:-1]):
            run = ws[i : i + 2] if ws[i + 1] not in SMALL else ws[i : i + 3]
            if w not in SMALL and run[-1] not in SMALL and len(run) > 1:
                out.add(" ".join(run))
    return sorted(out)


def doubtful(ws: Column, told: Column) -> Column:
    """Whether a paragraph of these words may be a licence line, from the templates alone; ``told``: words ``ABOUT`` licences and n-grams of the templates that it has."""
    spoken = [_spoken(t) for _, t in sentences()]
    runs = [t[i : i + RUN] for t in spoken for i in range(max(len(t) - RUN, 0) + 1)]
    runs = [r for r in runs if len(r) < RUN or sum(w not in SMALL for w in r) > 1]
    pairs = [sorted({f"{a} {b}" for a, b in zip(t, t[1:], strict=False)}) for t in spoken]
    near = [F.size(F.array_intersect(told, F.array(*map(F.lit, p)))) >= max(3, len(p) / 4) for p in pairs]
    same = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" ")).rlike("|".join(sorted({re.escape(f" {' '.join(r)} ") for r in runs})))
    # fewer bigrams than the poorest run holds are neither a run nor a quarter, and need no closer look
    least = min(3, *(len(set(zip(r, r[1:], strict=False))) for r in runs))
    some = F.size(F.filter(told, lambda g: g.contains(" "))) >= least
    return F.arrays_overlap(told, F.array(*map(F.lit, ABOUT))) | (some & reduce(or_, near, same))


def _draw(*parts: Column) -> Column:
    """A number from 0 to 999 that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1000))


def negatives(docs: DataFrame, known: list[str]) -> DataFrame:
    """(grams, opening, held, n): all distinct paragraphs that are surely no licence line, those with the same values in one row.

    ``grams``: their n-grams among the known ones; ``opening``: known words among their first ones; ``held`` marks the half that calibrates.
    """
    own = F.array(*map(F.lit, sorted({*known, *ABOUT})))
    # nested lambdas, so that words and n-grams of a line are computed once
    spoken = F.transform(F.split(unwrapped(F.col("text")), "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), words(x).alias("ws")))
    told = F.transform(spoken, lambda x: F.struct(x["h"].alias("h"), x["ws"].alias("ws"), F.sort_array(F.array_intersect(_ngrams(x["ws"]), own)).alias("told")))
    lines = docs.where("text is not null").select(F.explode(told).alias("line")).select("line.*").where(F.size("ws") > 0)
    sure = lines.where(~doubtful(F.col("ws"), F.col("told")))
    opening = F.sort_array(F.array_intersect("told", F.slice("ws", 1, OPENING)))
    sure = sure.select("h", F.array_join("told", "\n").alias("grams"), F.array_join(opening, "\n").alias("opening")).distinct()
    held = (F.pmod("h", F.lit(2)) == 1).alias("held")
    return sure.groupBy("grams", "opening", held).agg(F.count(F.lit(1)).alias("n"))


def _split(joined: str) -> Column:
    return F.filter(F.split(joined, "\n"), lambda g: g != "")


def worn(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    """(family, ws): worn copies of the templates, with words around them that come as often as ``shares`` says."""
    draw = random.Random(COPIES)
    around = []
    for k in range(1, COPIES + 1):
        some = [w for w in sorted(shares) if draw.random() < shares[w]]
        draw.shuffle(some)
        around.append((k, some))
    numbers = spark.createDataFrame(around, "k int, around array<string>")
    kept = F.filter("ws", lambda w, i: _draw(F.col("template"), F.col("k"), i) >= 80)
    copies = templates(spark).join(numbers).withColumn("ws", words(F.col("template")))
    copies = copies.withColumn("ws", F.when(F.col("k") == 1, F.col("ws")).otherwise(kept))
    before, after = F.concat("around", "ws"), F.concat("ws", "around")
    return copies.select("family", F.when(F.col("k") % 3 == 0, before).when(F.col("k") % 3 == 2, after).otherwise(F.col("ws")).alias("ws"))


def least_letting(chances: DataFrame, most: int) -> float | None:
    """The least ``p`` of (p, n) such that rows above it number at most ``most``; none if all of them do.

    Exact, with ``PARTS`` numbers on the driver at a time: the range of the part that holds it is cut into parts again.
    """
    low = high = None
    above = 0
    while True:
        if low is None:
            part = F.lit(0)
        else:
            chances = chances.where(F.col("p").between(low, high))
            part = F.least(F.floor((F.col("p") - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        parts = chances.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))
        for r in sorted(parts.collect(), key=lambda r: -r.part):
            if above + r.n > most:
                break
            above += r.n
        else:
            return None
        if r.low == r.high:
            return r.low
        low, high = r.low, r.high


@dataclass
class Model:
    """Families, the weight of each n-gram for each of them, biases, and the least probability of a prediction."""

    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    least: float
    anchors: list[str]

    def add_probabilities(self, rows: DataFrame) -> DataFrame:
        """With ``p``, the softmax over the families as an array in their order, from ``grams``.

        Nested lambdas see to it that no step is computed again for each element of the next, wherever the optimizer moves ``p``.
        """
        table = F.create_map(*(x for g, w in self.weights.items() for x in (F.lit(g), F.array(*map(F.lit, w)))))
        hits = F.filter(F.transform("grams", lambda g: F.try_element_at(table, g)), lambda w: w.isNotNull())
        logits = F.aggregate(hits, F.array(*map(F.lit, self.bias)), lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))
        shifted = _once(logits, lambda x: _once(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top))))
        shares = _once(shifted, lambda e: _once(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total)))
        return rows.withColumn("p", shares)


def fit(docs: DataFrame, mass: int = MASS, false_share: float = FALSE_SHARE) -> Model:
    spark = docs.sparkSession
    families = [NONE, *TEMPLATES]
    known = templates(spark).select(ngrams(words(F.col("template"))).alias("grams"))
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=2_000).fit(known)
    none = stage(negatives(docs, sorted(vocabulary.vocabulary)), "licence-negatives")
    groups = stage(none.groupBy("grams", "held").agg(F.sum("n").alias("n")).withColumn("grams", _split("grams")), "licence-groups")
    sizes = {r.held: r.n for r in groups.groupBy("held").agg(F.sum("n").alias("n")).collect()}
    # a word of the templates is one row here, so these tables have bounded size
    begin = none.select(F.explode(_split("opening")).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).collect()
    used = groups.select(F.explode("grams").alias("w")).distinct().collect()
    copies = worn(spark, {r.w: r.n / sum(sizes.values()) for r in begin}).select("family", ngrams(F.col("ws")).alias("grams"), F.lit(1.0).alias("weight"))
    # rows of weight 1 at most: a group that weighs more is several equal rows
    each = min(1.0, mass / sizes.get(False, mass))
    taught = groups.where(~F.col("held")).withColumn("weight", F.col("n") * F.lit(each))
    taught = taught.withColumn("rows", F.ceil("weight").cast("int")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    learn = copies.unionByName(taught.select(F.lit(NONE).alias("family"), "grams", (F.col("weight") / F.col("rows")).alias("weight")))
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    learn = stage(learn.withColumn("label", label.cast("double")), "licence-rows")
    regression = LogisticRegression(family="multinomial", regParam=PENALTY, elasticNetParam=1.0, maxIter=60, weightCol="weight").fit(vocabulary.transform(learn))
    matrix = regression.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in matrix[:, j]] for j, g in enumerate(vocabulary.vocabulary) if abs(matrix[:, j]).max() > 1e-6}
    single = [g for g in vocabulary.vocabulary if " " not in g and not g[0].isdigit()]
    # words that the corpus uses otherwise are no anchors; phrases and the words about licences always are
    anchors = sorted({*single} - {r.w for r in used} | {*ABOUT, *phrases()})
    model = Model(families, weights, [float(x) for x in regression.interceptVector.toArray()], 0.5, anchors)
    # the array has none first
    wrong = model.add_probabilities(groups.where("held").select("grams", "n")).select(F.array_max(F.slice("p", 2, len(families))).alias("p"), "n")
    total = sizes.get(True, 0)
    chances = stage(wrong, "licence-chances")
    model.least = max(0.5, least_letting(chances, total - math.ceil((1 - false_share) * total)) or 0.0)
    discard(none, groups, learn, chances)
    return model


def scan(docs: DataFrame, model: Model, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, paragraph, family, probability, containment of every paragraph about a licence."""
    names = F.array(*map(F.lit, model.families))
    found = paragraphs(docs, model.anchors)
    found = model.add_probabilities(found)
    found = found.withColumn("best", F.array_max(F.slice("p", 2, len(model.families)))).where(F.col("best") >= model.least)
    found = found.withColumn("family", F.element_at(names, F.array_position("p", F.col("best")).cast("int")))
    shares = []
    for family, texts in TEMPLATES.items():
        if family != UNKNOWN:
            pairs = [sorted({f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)}) for ws in map(_spoken, texts)]
            each = [F.size(F.array_intersect("grams", F.array(*map(F.lit, p)))) / len(p) for p in pairs]
            shares.append(F.when(F.col("family") == family, F.array_max(F.array(*each))))
    found = found.withColumn("containment", F.coalesce(*shares, F.lit(0.0)))
    family = F.when(F.col("containment") >= confirm, F.col("family")).otherwise(UNKNOWN)
    return found.select("doc_id", "paragraph", family.alias("family"), F.col("best").alias("probability"), "containment")


def licences(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(docs))
