"""Licence scans by a trained classifier of lines, confirmed by templates.

Words are runs of letters and digits, lower-cased; a gram is a word or two neighbouring words of a line. A multinomial
logistic regression with an L1 penalty over the presence of grams (those of ``TEMPLATES``, which is all that tells
licences) tells the licence families and the class *unknown* apart. It is trained on the notices and the other
lines of the whole corpus (a line is a notice there if it has ``CONFIRM`` of a template's word pairs) and on the templates, whole
and clipped at either end as line ends clip them. Lines with the same grams are one row with their number as its weight, so a pass
over the texts and a table of gram sets hold all lines. Half of the other lines are held back: the cut-off on the
probability of *unknown* is set so that at most ``FALSE_SHARE`` of them would be taken for licences.

Prediction: the penalty leaves few grams with a weight, and a line without one that speaks for a family has the
intercept's probability, so only lines with such a gram are scored. A gram speaks for a family if it raises the family's odds by a factor of e to the ``SPEAKS``. Neighbouring lines
that each have a gram speaking for a family are one unit, however many they are, so a wrapped notice is read as one; a blank line ends it. A unit is
a licence if its summed weights make its family the likeliest and *unknown* at most as likely as the cut-off.
Confirmation: a predicted unit stands if its words, read across line ends, hold ``CONFIRM`` of the word pairs of a template of its family.
Of its lines those count that are in a smallest run of lines that still confirms one of these templates.

All work is DataFrame expressions and Spark ML: no array of templates is compared row by row, grams and pairs are joined.

Defined results: a null or empty text has no lines; a document without licences has null names and measures and no lines;
repeated rows are separate documents; a line is counted once, whatever families it is part of; carriage returns end lines as line feeds do;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pinned, table, written

FALSE_SHARE, CONFIRM, PENALTY, SPEAKS = 0.0005, 0.6, 0.0002, 1.5
#: Short notices by family, as their publishers or common practice word them.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
               "you may not use this file except in compliance with the License",
               "distributed under the Apache 2.0 license", "Apache License, Version 2.0", "Apache License 2.0"],
    "mit": ["Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The MIT License (MIT)"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "SPDX-License-Identifier: GPL-3.0-or-later", "released under the GNU GPL version 2", "GNU General Public License",
            "licensed under the GPL", "GNU GPL"],
    "bsd": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted",
            "BSD 3-Clause License", "BSD 2-Clause License", "released under the BSD license"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
                 "CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License",
              "CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
                 "CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal public domain dedication", "CC0 1.0",
            "SPDX-License-Identifier: CC0-1.0"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0",
            "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "licensed under the MPL 2.0"],
    "proprietary": ["Copyright. All rights reserved. Reproduction without permission is prohibited", "All rights reserved",
                    "Reproduction without permission is prohibited", "Proprietary and confidential",
                    "Unauthorized copying of this file, via any medium, is strictly prohibited"],
}
UNKNOWN = "unknown"
CLASSES = [UNKNOWN, *TEMPLATES]
WORD = r"[^\p{L}\p{N}]+"


def plain_words(line: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in line.lower()).split()


def plain_pairs(words: list[str]) -> list[str]:
    """A text's different word pairs; of a single word, the word."""
    return sorted({" ".join(words[i:i + 2]) for i in range(max(1, len(words) - 1))}) if words else []


def plain_grams(line: str) -> set[str]:
    words = plain_words(line)
    return {*words, *map(" ".join, zip(words, words[1:]))}


def plain_share(words: list[str], family: str) -> float:
    """The largest share of a template's pairs, of the family's templates, that the words hold."""
    held = set(plain_pairs(words))
    return max(len(held.intersection(plain_pairs(plain_words(t)))) / len(plain_pairs(plain_words(t))) for t in TEMPLATES[family])


def notices() -> list[tuple[str, str]]:
    """(line, family): the templates, and what is left of them when a line end cuts off up to six tenths.

    What is left must not confirm another family as well as its own, as ``License, Version 2.0`` would.
    """
    found = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            forms = {text, "This file is " + text, text + " See the LICENSE file for details", "Copyright 2020 The Authors " + text}
            clipped = {" ".join(part) for i in range(1, int(len(words) * CONFIRM) + 1) for part in (words[i:], words[:-i]) if len(part) > 2}
            forms |= {form for form in clipped if not any(plain_share(plain_words(form), f) >= CONFIRM for f in TEMPLATES if f != family)}
            found += [(form, family) for form in sorted(forms)]
    return found


def vocabulary() -> list[str]:
    return sorted({g for texts in TEMPLATES.values() for text in texts for g in plain_grams(text)})


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), WORD), lambda w: w != F.lit(""))


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _grams(words: str, known: list[str]) -> Column:
    """The different grams of an array of words that are ``known``."""
    pairs = f"zip_with({words}, slice({words}, 2, size({words})), (a, b) -> a || ' ' || b)"
    return F.expr(f"array_distinct(filter(concat({words}, {pairs}), g -> g in ({_listed(known)})))")


def _lines(text: Column) -> Column:
    """The lines of a text; the carriage return is an end of line as well."""
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")


def _templates(spark: SparkSession) -> DataFrame:
    """(family, template, pairs_n, pair)."""
    rows, n = [], 0
    for family, texts in TEMPLATES.items():
        for text in texts:
            pairs = plain_pairs(plain_words(text))
            rows += [(family, n, len(pairs), pair) for pair in pairs]
            n += 1
    return spark.createDataFrame(rows, "family string, template int, pairs_n int, pair string")


def _shares(units: DataFrame, by: list[str], words: str) -> DataFrame:
    """``by``, family, share: the largest share of a template's pairs that a unit's words hold, per family; only units with a pair."""
    texts = [t for known in TEMPLATES.values() for t in known]
    known = sorted({p for t in texts for p in plain_pairs(plain_words(t))})
    held = units.select(*by, F.explode(_grams(words, known)).alias("pair")).join(_templates(units.sparkSession), "pair")
    counted = held.groupBy(*by, "family", "template", "pairs_n").agg(F.count(F.lit(1)).alias("held"))
    return counted.groupBy(*by, "family").agg(F.max(F.col("held") / F.col("pairs_n")).alias("share"))


@dataclass
class Classifier:
    """Weights of the grams by class, intercepts, and the highest probability of *unknown* that counts as a licence."""
    weights: dict[str, list[float]]
    intercepts: list[float]
    cutoff: float
    common: dict[str, int]  # lines of the corpus that have a word of the grams

    def speaks_for(self, gram: str) -> list[str]:
        """Families whose odds against *unknown* the gram raises by e to the ``SPEAKS`` at least."""
        w = self.weights[gram]
        return [c for k, c in enumerate(CLASSES) if k and w[k] - w[0] >= SPEAKS]

    def triggers(self) -> list[str]:
        """Words one of which every line with a speaking gram has: of a pair the rarer, unless one of its words is there already."""
        speaking = [g.split(" ") for g in self.weights if self.speaks_for(g)]
        found = {g[0] for g in speaking if len(g) == 1}
        for pair in sorted(g for g in speaking if len(g) == 2):
            if not found & set(pair):
                found.add(min(pair, key=lambda w: (self.common.get(w, 0), w)))
        return sorted(found)


def gram_sets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """grams, half, n: how many lines of the corpus have this set of known grams, by a digest's half; lines without a word don't count.

    All that training asks of a line is in its grams, so one row stands for all lines alike.
    """
    known = vocabulary()
    lines = docs.select(F.explode(_lines(F.col(f"`{text_col}`"))).alias("given")).select(_words(F.col("given")).alias("words"))
    half = (F.crc32(F.concat_ws(" ", "words").cast("binary")) % 2).cast("int")
    # Few words are known: the others are blanked before words are paired, and a pair with a blank is never made.
    known_words = F.transform("words", lambda w: F.when(w.isin([g for g in known if " " not in g]), w))
    found = lines.select(known_words.alias("words"), half.alias("half"), (F.size("words") > 0).cast("long").alias("counts"))
    found = found.select(F.array_sort(_grams("words", known)).alias("grams"), "half", "counts")
    return found.groupBy("grams", "half").agg(F.sum("counts").alias("n")).where("n > 0")


def train(docs: DataFrame, text_col: str = "text") -> Classifier:
    spark = docs.sparkSession
    sets = pinned(gram_sets(docs, text_col).withColumn("line", F.monotonically_increasing_id()))
    held = sets.select("line", F.explode("grams").alias("pair")).join(_templates(spark), "pair")
    shares = held.groupBy("line", "family", "template", "pairs_n").agg(F.count(F.lit(1)).alias("held"))
    likest = shares.groupBy("line").agg(F.max(F.struct((F.col("held") / F.col("pairs_n")).alias("share"), "family")).alias("best"))
    seen = sets.join(likest, "line", "left").select("grams", "half", "n", F.col("best.share").alias("share"), F.col("best.family").alias("family"))
    number = F.coalesce(*[F.when(F.col("family") == c, float(k)) for k, c in enumerate(CLASSES)], F.lit(0.0))
    lines = pinned(seen.where(f"share is null or share >= {CONFIRM} or share < 0.3").select(
        "grams", "half", "n", F.when(F.col("share") >= CONFIRM, number).otherwise(0.0).alias("label")))
    made = spark.createDataFrame(notices(), "line string, family string").select(_words(F.col("line")).alias("words"), "family")
    made = made.select(_grams("words", vocabulary()).alias("grams"), number.alias("label"), F.lit(1).cast("long").alias("n"))
    rows = lines.where("half = 0 or label > 0").select("grams", "label", "n").unionByName(made)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    # All families together weigh as much as the corpus, or the larger the corpus the less likely a notice is one.
    others = sum(n for label, n in sizes.items() if label)
    rows = rows.withColumn("weight", F.col("n") * F.when(F.col("label") > 0, max(1.0, sizes.get(0.0, 0) / others)).otherwise(1.0))
    counts = CountVectorizerModel.from_vocabulary(vocabulary(), inputCol="grams", outputCol="features", minTF=1.0, binary=True)
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=PENALTY, elasticNetParam=1.0, maxIter=60,
                                standardization=False).fit(pinned(counts.transform(rows)))
    unseen = fitted.transform(counts.transform(lines.where("half = 1 and label = 0"))).select(vector_to_array("probability")[0].alias("p"), "n")
    cutoff = unseen.agg(F.percentile("p", F.lit(FALSE_SHARE), F.col("n"))).first()[0]
    matrix = fitted.coefficientMatrix.toArray()
    weights = {g: [float(v) for v in matrix[:, i]] for i, g in enumerate(vocabulary()) if matrix[:, i].any()}
    words = sets.select("n", F.explode("grams").alias("w")).where(~F.col("w").contains(" "))
    common = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return Classifier(weights, [float(v) for v in fitted.interceptVector], min(0.5, cutoff if cutoff is not None else 0.5), common)


def _triggered(text: Column, model: Classifier) -> Column:
    """(line, given) of the lines of a text that have a trigger, numbered from 0 among all."""
    numbered = F.transform(_lines(text), lambda given, n: F.struct(n.alias("line"), given.alias("given")))
    return F.filter(numbered, lambda x: F.exists(_words(x["given"]), lambda w: w.isin(model.triggers() or [""])))


def predicted_units(lines: DataFrame, model: Classifier) -> DataFrame:
    """row, family, unit, p, lines, words: what the classifier takes for licences among ``lines`` (row, line, given)."""
    spark = lines.sparkSession
    spoken = [(g, w, model.speaks_for(g)) for g, w in sorted(model.weights.items())]
    weights = spark.createDataFrame(spoken, "gram string, w array<double>, families array<string>") if spoken else spark.createDataFrame(
        [], "gram string, w array<double>, families array<string>")
    split = lines.withColumn("words", _words(F.col("given")))
    hits = written(split.select("row", "line", _grams("words", [g for g, *_ in spoken] or [""]).alias("grams")).where(F.size("grams") > 0), "licence-grams")
    grams = hits.select("row", "line", F.explode("grams").alias("gram")).join(weights, "gram")
    spoken_for = grams.select("row", "line", F.explode("families").alias("family")).distinct()
    order = Window.partitionBy("row", "family").orderBy("line")
    units = spoken_for.withColumn("unit", F.col("line") - F.row_number().over(order))
    parts = units.join(hits, ["row", "line"])
    key = ["row", "family", "unit"]
    scored = (parts.select(*key, F.explode("grams").alias("gram")).distinct().join(weights, "gram").groupBy(*key)
              .agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(CLASSES))]))
    raw = [F.col(f"s{k}") + F.lit(v) for k, v in enumerate(model.intercepts)]
    top = F.greatest(*raw)
    total = sum((F.exp(r - top) for r in raw[1:]), F.exp(raw[0] - top))
    likeliest = F.coalesce(*[F.when(raw[k] == top, c) for k, c in enumerate(CLASSES)])
    taken = scored.withColumns({"p": F.exp(raw[0] - top) / total, "top": likeliest}).where(
        (F.col("top") == F.col("family")) & (F.col("p") <= model.cutoff)).select(*key, "p")
    held = (parts.drop("grams").join(taken, key).join(split.select("row", "line", "words"), ["row", "line"])
            .groupBy(*key, "p").agg(F.sort_array(F.collect_list(F.struct("line", "words"))).alias("lines")))
    return held.withColumn("words", F.flatten(F.transform("lines", lambda x: x["words"])))


def _counted_lines(units: DataFrame) -> DataFrame:
    """row, line: the lines in a smallest run of a unit's lines that holds ``CONFIRM`` of a template of its family.

    A run that ends at a line confirms if enough of the template's pairs occur last at or behind its first line. So
    the latest first line is the one at the place of the needed number among the last occurrences, latest first. Of runs
    with one first line the shortest is smallest. The work grows with lines times a template's pairs.
    """
    key = ["row", "family", "unit"]
    tokens = "flatten(transform(lines, x -> transform(x.words, w -> struct(x.line as line, w as word))))"
    pairs = f"zip_with({tokens}, slice({tokens}, 2, size({tokens})), (a, b) -> struct(a.word || ' ' || b.word as pair, a.line as low, b.line as high))"
    seen = units.select(*key, F.expr(f"inline({pairs})")).join(_templates(units.sparkSession), ["family", "pair"])
    key += ["template", "pairs_n"]
    ends, held = seen.select(*key, "high").distinct(), seen.select(*key, "pair").distinct()
    each = (ends.join(held, key).join(seen.groupBy(*key, "pair", "high").agg(F.max("low").alias("low")), [*key, "pair", "high"], "left"))
    last = F.max("low").over(Window.partitionBy(*key, "pair").orderBy("high"))
    starts = each.withColumn("low", last).groupBy(*key, "high").agg(F.sort_array(F.collect_list("low"), asc=False).alias("lows"))
    need = F.ceil(F.col("pairs_n") * CONFIRM - 1e-9).cast("int")
    runs = starts.where(F.size("lows") >= need).select(*key, "high", F.element_at("lows", need).alias("low"))
    return runs.groupBy(*key, "low").agg(F.min("high").alias("high")).select("row", F.explode(F.sequence("low", "high")).alias("line")).distinct()


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Classifier | None = None) -> DataFrame:
    """One row per document: id, licences (families, comma-joined), n_licence_lines, probability, similarity."""
    model = model or train(docs, text_col)
    rows = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"),
                               _triggered(F.col(f"`{text_col}`"), model).alias("lines")), "licence-lines")
    units = pinned(predicted_units(rows.select("row", F.inline("lines")), model))
    key = ["row", "family", "unit"]
    shares = _shares(units.withColumnRenamed("family", "predicted"), ["row", "predicted", "unit"], "words").where("predicted = family")
    found = units.join(shares.drop("predicted"), key).where(F.col("share") >= CONFIRM)
    names = found.groupBy("row").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("family"))).alias("licences"),
        F.max(1 - F.col("p")).alias("probability"), F.max("share").alias("similarity"))
    counted = _counted_lines(found).groupBy("row").agg(F.count(F.lit(1)).alias("n_licence_lines"))
    return rows.select("id", "row").join(names.join(counted, "row"), "row", "left").select(
        F.col("id").alias(id_col), "licences", F.coalesce("n_licence_lines", F.lit(0)).cast("long").alias("n_licence_lines"),
        "probability", "similarity")


def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licence_scan(table(spark, folder, "documents"))
