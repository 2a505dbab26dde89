"""License scan by diagonal voting.

Every rolling k-gram of words of every text is joined by its hash to the places of that k-gram in the templates. A
match at word p of the text and word t of the template votes for the diagonal p - t: matches of one place of the
template in the text share it. Votes are counted by (text, template, diagonal); neighbouring diagonals, which
insertions and omissions part, are merged. A merged span is verified: the longest run of its votes whose template places
rise with the words of the text, within ``STRETCHED`` lengths of the template, must hold enough of the template's
k-grams, so a gram that is repeated, or grams in another order, count once.

Phrases are templates of few words with 2-grams: all of them must vote on one diagonal, so the words stand there one
after another. License texts have 5-grams. Hashes only find candidates: words are compared before a vote counts.

Templates are the only broadcast data: a fixed list of some thousand k-grams. Text words stay within their row; only
votes are shuffled, counted in each task first. Built-in functions throughout.

Null texts count as empty; an empty text has no words, places or labels and score 0. Rows alike in id and text give
one result row, rows that share an id but not the text one each; null ids count as an id. Further columns of the
input are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm import columns as C

PHRASE_GRAM, TEXT_GRAM = 2, 5
SLACK = 8  # words by which neighbouring diagonals may differ
LEAST_COVERED = 0.5
STRETCHED = 2  # lengths of a template that its words may be spread over

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words that speak of a license. ``base`` phrases are counted place by place."""

    label: str
    text: str
    base: bool = False


# Phrases, and notices as their licenses print them.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("reserved", "all rights reserved"),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    ),
    Template(
        "apache",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    ),
    Template(
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    Template(
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at""",
    ),
    Template(
        "cc-by",
        """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    ),
    Template(
        "public-domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
    ),
)


def template_words(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


def grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``(gram_hash, gram, template, place, k)``: each k-gram of each template at its place."""
    rows = []
    for number, template in enumerate(templates):
        words = template_words(template.text)
        k = PHRASE_GRAM if len(words) <= TEXT_GRAM else TEXT_GRAM
        rows += [(number, place, k, words[place : place + k]) for place in range(len(words) - k + 1)]
    found = spark.createDataFrame(rows, "template int, place int, k int, gram array<string>")
    return found.select(F.xxhash64("gram").alias("gram_hash"), "gram", "template", "place", "k")


def facts(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``(template, label, is_base, phrase, n_grams)``."""
    rows = []
    for number, template in enumerate(templates):
        n = len(template_words(template.text))
        phrase = n <= TEXT_GRAM
        rows.append((number, template.label, template.base, phrase, n - (PHRASE_GRAM if phrase else TEXT_GRAM) + 1))
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, phrase boolean, n_grams int")


def votes(docs: DataFrame, templates: tuple[Template, ...], key: str, text: str) -> DataFrame:
    """``(key, row, n_words, template, diagonal, n, first, last)``; a text's row with a null template tells its words."""
    texts = docs.select(F.col(key), F.xxhash64(text).alias("row"), C.whole(text).alias("t"))
    cut = F.array_remove(F.split(C.ascii_lower(F.col("t")), _BREAK), "")
    texts = texts.select(key, "row", cut.alias("w")).select(key, "row", "w", F.size("w").alias("n_words"))
    # Two k-grams begin at each word; place -1 stands for the text itself.
    at = F.explode(F.sequence(F.lit(-1), 2 * F.col("n_words") - 1))
    places = texts.select(key, "row", "w", "n_words", at.alias("at"))
    k = F.when(F.col("at") % 2 == 0, F.lit(PHRASE_GRAM)).otherwise(F.lit(TEXT_GRAM))
    places = places.select(key, "row", "w", "n_words", "at", F.floor(F.col("at") / 2).cast("int").alias("p"), k.alias("long"))
    rolled = F.when(F.col("at") < 0, F.lit(0).cast("bigint")).when(
        F.col("p") + F.col("long") <= F.col("n_words"), F.xxhash64(F.slice("w", F.col("p") + 1, F.col("long")))
    )
    known = grams(docs.sparkSession, templates)
    itself = docs.sparkSession.createDataFrame([(0, [], None, -1, 0)], known.schema)
    hits = places.withColumn("rolled", rolled).join(F.broadcast(known.unionByName(itself)), F.col("rolled") == F.col("gram_hash"))
    words_equal = F.slice("w", F.col("p") + 1, F.col("k")) == F.col("gram")
    hits = hits.where(F.when(F.col("at") < 0, F.col("k") == 0).otherwise((F.col("k") > 0) & words_equal))
    return hits.groupBy(key, "row", "n_words", "template", (F.col("p") - F.col("place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("n"), F.min("p").alias("first"), F.max(F.col("p") + F.col("k")).alias("last"),
        F.collect_list("place").alias("places"),  # at most one vote for each place of the template
    )


def in_order(hits: Column, n_grams: Column) -> Column:
    """Of ``(p, place)`` in the order of p: how many places the longest rising run has, where it starts and ends.

    The best run that ends at each place is kept; of equally long ones the one that starts last.
    """

    def run(n: Column, start: Column, end: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    none = run(F.lit(0), F.lit(0), F.lit(0))

    def step(best: Column, hit: Column) -> Column:
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), hit["place"])), none)
        longer = C.let(before, lambda b: run(b["n"] + 1, F.when(b["n"] == 0, hit["p"]).otherwise(b["start"]), hit["p"]))
        return C.let(longer, lambda x: F.transform(best, lambda old, i: F.when(i == hit["place"], F.greatest(old, x)).otherwise(old)))

    return F.array_max(F.aggregate(hits, F.array_repeat(none, n_grams), step))


def spans(counted: DataFrame, templates: tuple[Template, ...], key: str) -> DataFrame:
    """Merged and verified spans: ``(key, row, n_words, label, is_base, first, last, covered)``, label null for the text itself."""
    told = counted.join(F.broadcast(facts(counted.sparkSession, templates)), "template", "left")
    along = Window.partitionBy(key, "row", "template").orderBy("diagonal")
    away = F.col("diagonal") - F.lag("diagonal").over(along) > SLACK
    begins = (F.coalesce(away, F.lit(True)) | F.col("phrase")).cast("int")
    placed = F.transform("places", lambda t: F.struct((F.col("diagonal") + t).alias("p"), t.alias("place")))
    merged = (
        told.select("*", begins.alias("begins"))
        .select("*", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("span"))
        .groupBy(key, "row", "n_words", "template", "label", "is_base", "phrase", "n_grams", "span")
        .agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
            F.flatten(F.collect_list(F.when(~F.col("phrase"), placed))).alias("hits"),
        )
    )
    least = F.when(F.col("phrase"), F.lit(1.0)).otherwise(F.lit(LEAST_COVERED)) * F.col("n_grams")
    found = merged.where(F.col("label").isNull() | (F.col("n") >= least))
    longest = F.when(F.col("label").isNotNull() & ~F.col("phrase"), in_order(F.sort_array("hits"), F.col("n_grams")))
    found = found.withColumn("run", longest)
    near = F.col("run.end") - F.col("run.start") <= STRETCHED * F.col("n_grams") + SLACK
    n = F.when(F.col("phrase"), F.col("n")).otherwise(F.when(near, F.col("run.n")).otherwise(F.lit(0)))
    found = found.withColumn("covered", n / F.col("n_grams"))
    return found.where(F.col("label").isNull() | (n >= least)).select(
        key, "row", "n_words", "label", "is_base", "phrase", "first", "last", "covered"
    )


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per text: words, places of base phrases, first and last of them, labels and score.

    A phrase gives 0.6 to the score, a license text up to 1 by the part of it that is there; the highest counts.
    """
    found = spans(votes(docs, templates, key, text), templates, key)
    base = F.when(F.col("is_base"), F.col("first").cast("bigint"))
    listed = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    weight = F.when(F.col("phrase"), F.lit(0.6)).otherwise(F.col("covered"))
    return found.groupBy(key, "row").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        listed(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), weight)), F.lit(0.0)).alias("score"),
    ).drop("row")
