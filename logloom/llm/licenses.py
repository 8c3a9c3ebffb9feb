"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a window of adjacent lines without a wordless one among them, so notices that
are wrapped or commented out are seen whole. Its features are the word unigrams and bigrams it has of a
vocabulary taken from the templates; a multinomial logistic regression tells the licence
families and an unknown class apart. It is trained here, on the templates (whole, in
pieces and with words missing) and on a bounded sample of the corpus' own paragraphs as
the unknown class. Probabilities are calibrated by a temperature fitted on a part held out.
A family counts as confirmed if the paragraph holds enough of one of its templates; a
paragraph can confirm several. Of overlapping windows the one most like a template stands.

Scoring uses DataFrame functions alone and moves no text.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.text import stored

# Families and the notices by which works name them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Released under the BSD License."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0", "This is free and unencumbered software released into the public domain."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission."),
]
UNKNOWN = "unknown"
#: Paragraphs of the corpus that the unknown class is learned from, those of the smallest hashes.
SAMPLE = 4_000
#: Unigrams in more than this share of the sample tell nothing and are not in the vocabulary.
COMMON = 0.02
#: Copies of each template with words left out.
VARIANTS = 30
#: Least calibrated probability of a family, and least share of a template's bigrams.
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.6
#: Most lines of a window; it also ends where the lines before hold as many words as the longest template.
LINES = 16
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and + - . within; punctuation around them is left out."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: w != "")


def bigrams(ws: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat_ws(" ", F.get(ws, i - 1), F.get(ws, i)))
    return F.when(F.size(ws) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _paragraphs(docs: DataFrame) -> DataFrame:
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    return docs.select("doc_id", F.posexplode(lines).alias("paragraph", "line"))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(i, family, text) for i, (family, text) in enumerate(TEMPLATES)]
    table = spark.createDataFrame(rows, "template int, family string, line string").repartition(1)
    return table.withColumn("words", words(F.col("line"))).withColumn("pairs", bigrams(F.col("words")))


def _training(templates: DataFrame, sample: DataFrame) -> DataFrame:
    """(family, words, held_out): templates whole, their parts, with words missing; the sample."""
    n = F.size("words")
    parts = templates.where(n > 12).select(
        "family", "template", F.explode(F.array(F.slice("words", 1, F.ceil(n / 2).cast("int")), F.slice("words", F.ceil(n / 3).cast("int"), n))).alias("words")
    )
    variants = templates.withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(VARIANTS)))).select(
        "family", "template",
        F.filter("words", lambda w, i: F.pmod(F.xxhash64("template", "id", i), F.lit(8)) != 0).alias("words"),
    ).where(F.size("words") > 1)
    known = templates.select("family", "template", "words").unionByName(parts).unionByName(variants)
    all_rows = known.select("family", "words").unionByName(sample.select(F.lit(UNKNOWN).alias("family"), "words"))
    return all_rows.withColumn("held_out", F.pmod(F.xxhash64("words"), F.lit(5)) == 0)


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Vocabulary, families, weights, intercepts and temperature. What is collected is bounded by the templates."""
    spark = docs.sparkSession
    templates = _templates(spark).persist()
    pool = _paragraphs(docs).where("line <> ''").select("line", F.xxhash64("line").alias("__h"))
    # Distinct lines; their hashes alone are shuffled.
    last = pool.select("__h").distinct().orderBy("__h").limit(sample).agg(F.max("__h")).first()[0]
    picked = pool.where(F.col("__h") <= F.lit(last)).dropDuplicates(["line"]).select(words(F.col("line")).alias("words")).persist()
    pairs = {r.pair for r in templates.select(F.explode("pairs").alias("pair")).distinct().collect()}
    of_templates = {r.w for r in templates.select(F.explode("words").alias("w")).distinct().collect()}
    # Sampled paragraphs that hold a template's text would be taught as unknown: they are left out.
    known_pairs = F.split(F.lit("|".join(sorted(pairs))), r"\|")
    shared = F.size(F.array_intersect(bigrams(F.col("words")), known_pairs))
    picked_clean = picked.where((F.size("words") > 0) & ((shared < 2) | (2 * shared < F.size("words"))))
    n = max(1, picked_clean.count())
    counts = picked_clean.select(F.explode(F.array_distinct("words")).alias("w")).where(F.col("w").isin(sorted(of_templates)))
    common = {r.w for r in counts.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > COMMON * n).collect()}
    unigrams = sorted(of_templates - common)
    vocabulary = unigrams + sorted(p for p in pairs if not set(p.split(" ")) <= common)
    rows = _training(templates, picked_clean).withColumn("grams", F.concat(F.array_distinct("words"), bigrams(F.col("words"))))
    families = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN]
    label = F.array_position(F.split(F.lit("|".join(families)), r"\|"), F.col("family")).cast("double") - 1
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True)
    data = model.transform(rows.withColumn("label", label)).select("label", "features", "held_out").persist()
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, standardization=False).fit(data.where("NOT held_out"))
    raw = fitted.transform(data.where("held_out")).select(F.col("label").cast("int").alias("k"), vector_to_array("rawPrediction").alias("z"))
    loss = [
        F.avg(F.log(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max("z")) / t))) - (F.get("z", F.col("k")) - F.array_max("z")) / t)
        for t in TEMPERATURES
    ]
    losses = [x if x is not None else 0.0 for x in raw.agg(*[x.alias(str(i)) for i, x in enumerate(loss)]).first()]
    temperature = TEMPERATURES[losses.index(min(losses))]
    matrix = fitted.coefficientMatrix.toArray()
    for df in (templates, picked, data):
        df.unpersist()
    return {
        "families": families, "unigrams": unigrams, "vocabulary": vocabulary, "temperature": temperature,
        "weights": [[round(float(w), 9) for w in matrix[:, j]] for j in range(len(vocabulary))],
        "intercepts": [round(float(b), 9) for b in fitted.interceptVector],
    }


def _once(rows: DataFrame, name: str, value: Column, *drop: str) -> DataFrame:
    """A column that is computed once a row: filters on it are not moved below and repeated."""
    return rows.select("*", F.explode(F.array(value)).alias(name)).drop(*drop)


def _json(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _windows(docs: DataFrame, unigrams: Column, pairs: Column, most_words: int) -> DataFrame:
    """(__row, doc_id, paragraph, stop, __words): lines with a word of the vocabulary, and longer
    windows that begin at one and end at another with bigrams of templates in both."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    ahead = F.transform(lines, lambda x, i: F.struct(i.alias("paragraph"), F.slice(lines, i + 1, LINES).alias("lines")))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row"))
    begun = rows.select("__row", "doc_id", F.explode(ahead).alias("__a"))
    begun = begun.select("__row", "doc_id", "__a.paragraph", "__a.lines").where(F.get("lines", F.lit(0)) != "")
    begun = _once(begun, "__first", words(F.get("lines", F.lit(0))))
    # Every gram of the vocabulary has a unigram of it, so the other lines have none.
    begun = begun.where(F.arrays_overlap("__first", unigrams))
    # Stored twice: small plans, whose generated code compiles in little memory, and each column
    # computed once.
    begun = stored(begun, "licence-lines")
    more = F.arrays_overlap(bigrams(F.col("__first")), pairs)
    begun = _once(begun, "__all", F.when(more, F.transform("lines", words)).otherwise(F.array("__first")), "lines", "__first")
    blank = F.array_position(F.transform("__all", F.size), 0)
    begun = _once(begun, "__run", F.when(blank > 0, F.slice("__all", F.lit(1), (blank - 1).cast("int"))).otherwise(F.col("__all")), "__all")
    before = lambda k: F.size(F.flatten(F.slice("__run", F.lit(1), k - 1)))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("__run")),
        lambda k: (k == 1) | ((before(k) < most_words) & F.arrays_overlap(bigrams(F.get("__run", k - 1)), pairs)),
    )
    cut = begun.select("__row", "doc_id", "paragraph", "__run", F.explode(ends).alias("__k"))
    return cut.select(
        "__row", "doc_id", "paragraph", (F.col("paragraph") + F.col("__k")).alias("stop"),
        F.flatten(F.slice("__run", F.lit(1), F.col("__k"))).alias("__words"),
    )


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """A row per paragraph and family that it is taken for a licence notice of.

    doc_id, paragraph (its first line, from 0), family (`unknown` if no template confirms it),
    predicted, probability (calibrated; of further confirmed families, against the unknown
    class alone), template (number of the likest one of that family), similarity (share of
    its bigrams that the paragraph has), confirmed. A confirmed family needs no least
    probability, but one whose template another confirmed family's explains is left out.
    Unconfirmed are single lines that overlap no confirmed window. Null, empty and wordless
    texts give no rows, nor do paragraphs without any word of the vocabulary: those are
    unknown. Repeated rows repeat their rows; a null doc_id stays null; other columns are
    ignored; empty in, empty out. Without `model` one is trained on `docs`.
    """
    model = model or train(docs)
    unigrams = F.split(F.lit("|".join(model["unigrams"])), r"\|")
    vocabulary = F.split(F.lit("|".join(model["vocabulary"])), r"\|")
    families = F.split(F.lit("|".join(model["families"])), r"\|")
    of_templates = _template_pairs(docs.sparkSession)
    known = F.split(F.lit("|".join(sorted({p for t in of_templates for p in t["pairs"]}))), r"\|")
    found = _windows(docs, unigrams, known, max(t["words"] for t in of_templates))
    found = stored(found, "licence-words")
    found = found.withColumn("__pairs", bigrams(F.col("__words")))
    grams = F.concat(F.array_distinct("__words"), F.col("__pairs"))
    weights = _json(model["weights"], "array<array<double>>")
    start = _json(model["intercepts"], "array<double>")
    logits = F.aggregate(
        F.array_intersect(grams, vocabulary), start,
        lambda z, h: F.zip_with(z, F.get(weights, (F.array_position(vocabulary, h) - 1).cast("int")), lambda a, b: a + b),
    )
    found = stored(found.select("__row", "doc_id", "paragraph", "stop", "__pairs", logits.alias("__z")), "licence-logits")
    most = F.array_max("__z")
    total = F.aggregate(F.transform("__z", lambda x: F.exp((x - most) / model["temperature"])), F.lit(0.0), lambda s, x: s + x)
    predicted = F.get(families, (F.array_position("__z", most) - 1).cast("int"))
    found = found.withColumn("__p", 1 / total).withColumn("__predicted", predicted)
    pairs = _json(of_templates, "array<struct<family: string, template: int, pairs: array<string>>>")
    alike = F.transform(pairs, lambda t: F.struct(
        t["family"].alias("family"), t["template"].alias("template"), t["pairs"].alias("pairs"),
        F.array_intersect(t["pairs"], F.col("__pairs")).alias("has"),
    ))
    alike = F.transform(alike, lambda t: F.struct(
        (F.size(t["has"]) / F.size(t["pairs"]) >= LEAST_SIMILARITY).alias("confirmed"), F.size(t["has"]).alias("n"),
        (F.size(t["has"]) / F.size(t["pairs"])).alias("similarity"), (-t["template"]).alias("number"), *[t[c].alias(c) for c in ("family", "pairs", "has")],
    ))
    found = _once(found, "__alike", alike)
    # The template of each family that most is there of, if it is confirmed or predicted.
    order = lambda t: F.struct(t["confirmed"], t["n"], t["similarity"], t["number"])
    likely = (F.col("__predicted") != UNKNOWN) & (F.col("__p") >= LEAST_PROBABILITY) & (F.col("stop") == F.col("paragraph") + 1)
    able = F.filter("__alike", lambda t: t["confirmed"] | (likely & (t["family"] == F.col("__predicted"))))
    found = _once(found, "__able", able, "__alike").where(F.size("__able") > 0)
    best = F.filter("__able", lambda t: ~F.exists("__able", lambda o: (o["family"] == t["family"]) & (order(o) > order(t))))
    found = found.select("__row", "doc_id", "paragraph", "stop", "__z", "__p", "__predicted", F.explode(best).alias("__t"))
    family = F.col("__t.family")
    z = F.get("__z", (F.array_position(families, family) - 1).cast("int"))
    against = 1 / (1 + F.exp((F.get("__z", F.lit(model["families"].index(UNKNOWN))) - z) / model["temperature"]))
    rows = found.select("__row", "doc_id", F.struct(
        "paragraph", "stop", family.alias("predicted"),
        F.when(family == F.col("__predicted"), F.col("__p")).otherwise(against).alias("probability"),
        (-F.col("__t.number")).alias("template"), *[F.col(f"__t.{c}").alias(c) for c in ("similarity", "confirmed", "n", "pairs", "has")],
    ).alias("w"))
    # The windows of one document, without those that a window within holds as much as.
    rows = rows.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("w").alias("__ws"))
    within = lambda w, o: (o["predicted"] == w["predicted"]) & (o["paragraph"] >= w["paragraph"]) & (o["stop"] <= w["stop"]) & (
        o["stop"] - o["paragraph"] < w["stop"] - w["paragraph"]) & o["confirmed"] & (o["n"] >= w["n"])
    rows = _once(rows, "__least", F.filter("__ws", lambda w: ~F.exists("__ws", lambda o: within(w, o))), "__ws")
    rank = lambda w: F.struct(w["n"], w["similarity"], w["paragraph"] - w["stop"], -w["paragraph"], -w["template"])
    # What a template has besides the pairs of a likelier one of another family must be there too.
    own = lambda w, o: F.array_except(w["pairs"], o["pairs"])
    explained = lambda w, o: (
        F.size(F.array_intersect(own(w, o), w["has"])) < LEAST_SIMILARITY * F.greatest(F.lit(1), F.size(own(w, o)))
    )
    beaten = lambda w, o: (o["paragraph"] < w["stop"]) & (w["paragraph"] < o["stop"]) & o["confirmed"] & (
        ~w["confirmed"] | ((rank(o) > rank(w)) & ((o["predicted"] == w["predicted"]) | explained(w, o)))
    )
    stands = F.filter("__least", lambda w: ~F.exists("__least", lambda o: beaten(w, o)))
    rows = rows.select("doc_id", F.explode(stands).alias("w")).select("doc_id", "w.*")
    return rows.select(
        "doc_id", "paragraph", F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN).alias("family"), "predicted",
        F.round("probability", 6).alias("probability"), "template", F.round("similarity", 6).alias("similarity"), "confirmed",
    )


def _template_pairs(spark: SparkSession) -> list[dict]:
    rows = _templates(spark).orderBy("template").collect()
    return [{"family": r.family, "template": r.template, "pairs": list(r.pairs), "words": len(r.words)} for r in rows]
