"""License scans by diagonal voting.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
The 64-bit hashes of all rolling word k-grams of every document are joined to
the places they have in the templates; k is 2, or 4 for templates of
``LONG_WORDS`` words or more, whose pairs ("of the") would meet everywhere. A
shared gram votes for a diagonal: its place in the document less its place in
the template. Votes of neighbouring diagonals are merged (up to ``SHIFT``
apart, ``LONG_SHIFT`` for long templates: words put in or left out).

A merged span is then verified. Its votes are walked in template order, each at
the earliest place behind the one before, so that what is left is an alignment
in order. It has to hold ``COVER`` of the template's grams, and, against every
template of another label that has ``SIBLING`` or more of the same grams,
``COVER`` of the grams that the other one lacks: the words that tell the two
licenses apart. Without them ("GNU General Public License" and no version) no
label of the method is given. Base phrases hold where all their pairs vote for
one diagonal, so their words stand consecutively. The score is the best share
of a template voted for (1 for a base phrase, 0 without any shared gram).

Templates may have any length from two words; shorter ones raise. Null and
empty texts have no words, labels or places. Repeated rows are reported each;
their grams count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stash

COVER = 0.75
SIBLING = 0.6
SHIFT = 2
LONG_WORDS = 24
LONG_SHIFT = 8

# Base phrases with their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Parts that several license texts share.
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_THIRD = (
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission "
)
_BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
    "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
    "of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
# License lines, headers and whole license texts, with their labels.
TEMPLATES = (
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa-4.0"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd-4.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("dedicated to the public domain under cc0", "cc0"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
        "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (_BSD_HEAD + _BSD_TAIL, "bsd-2-clause"),
    (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "bsd-3-clause"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it "
        "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "general public license for more details",
        "gpl-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
        "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "general public license for more details",
        "gpl-3.0",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
)


def license_words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def gram_length(words: list[str]) -> int:
    return 4 if len(words) >= LONG_WORDS else 2


def grams(words: list[str]) -> list[tuple[str, ...]]:
    k = gram_length(words)
    if len(words) < k:
        raise ValueError(f"a template needs two words or more: {' '.join(words)!r}")
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def template_grams(spark: SparkSession, templates=TEMPLATES, base=BASE_PHRASES) -> DataFrame:
    """_hash, template, at: one row per gram of a template, from constants."""
    rows = [(list(g), number, at) for number, (text, _) in enumerate([*base, *templates]) for at, g in enumerate(grams(text.split()))]
    w = [F.get("_gram", F.lit(i)) for i in range(4)]
    table = spark.createDataFrame(rows, "_gram array<string>, template int, at int")
    return table.select(F.when(F.size("_gram") == 2, F.xxhash64(*w[:2])).otherwise(F.xxhash64(*w)).alias("_hash"), "template", "at")


def template_facts(spark: SparkSession, templates=TEMPLATES, base=BASE_PHRASES) -> DataFrame:
    """template, label, is_base, n_grams, reach (of merged diagonals), and per
    sibling of another label the places of the grams that it lacks."""
    every = [(text.split(), label) for text, label in [*base, *templates]]
    sets = [set(grams(w)) for w, _ in every]
    rows = []
    for number, (w, label) in enumerate(every):
        own, is_base = grams(w), number < len(base)
        lacks = []
        for other in range(len(base), len(every)):
            missing = [at for at, g in enumerate(own) if g not in sets[other]]
            if not is_base and every[other][1] != label and 0 < len(missing) <= (1 - SIBLING) * len(own):
                lacks.append(missing)
        rows.append((number, label, is_base, len(own), 0 if is_base else SHIFT if gram_length(w) == 2 else LONG_SHIFT, lacks))
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, n_grams int, reach int, lacks array<array<int>>")


def _rolling(w: Column, k: int) -> Column:
    place = F.sequence(F.lit(0), F.size(w) - k)
    rows = F.transform(place, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("_hash")))
    return F.when(F.size(w) >= k, rows).otherwise(F.array().cast("array<struct<place:int,_hash:bigint>>"))


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Per document, template and diagonal: the template places voted for."""
    rolling = let(license_words(F.col("text")), lambda w: F.concat(_rolling(w, 2), _rolling(w, 4)))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mark"), F.inline(rolling))
    hits = rows.join(F.broadcast(table), "_hash")
    return hits.groupBy("doc_id", "_mark", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))


def _in_order(merged: Column) -> Column:
    """Template places of the votes left by the walk described above."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("place"), F.array().cast("array<int>").alias("taken"))

    def step(s, v):
        on = F.struct(v["at"].alias("at"), v["place"].alias("place"), F.concat(s["taken"], F.array(v["at"])).alias("taken"))
        return F.when((v["at"] > s["at"]) & (v["place"] > s["place"]), on).otherwise(s)

    return F.aggregate(F.array_sort(merged), start, step, lambda s: s["taken"])


def spans(found: DataFrame, facts: DataFrame, cover: float = COVER) -> DataFrame:
    """The votes with ``share`` (of the template's grams, over neighbouring
    diagonals), ``taken`` (verified template places of a span that has enough
    votes, else null) and ``holds``."""
    rows = found.join(F.broadcast(facts), "template")
    near = Window.partitionBy("doc_id", "_mark", "template").orderBy("diagonal").rangeBetween(-max(SHIFT, LONG_SHIFT), max(SHIFT, LONG_SHIFT))
    around = F.filter(F.collect_list(F.struct("diagonal", "ats")).over(near), lambda v: F.abs(v["diagonal"] - F.col("diagonal")) <= F.col("reach"))
    rows = rows.withColumn("around", around)
    rows = rows.withColumn("share", F.size(F.array_distinct(F.flatten(F.col("around.ats")))) / F.col("n_grams"))
    least = F.when(F.col("is_base"), F.lit(1.0)).otherwise(F.lit(cover))
    places = F.flatten(F.transform("around", lambda v: F.transform(v["ats"], lambda a: F.struct(a.alias("at"), (v["diagonal"] + a).alias("place")))))
    rows = rows.withColumn("taken", F.when(F.col("share") >= least, _in_order(places)))
    telling = F.forall("lacks", lambda m: F.size(F.array_intersect("taken", m)) >= F.size(m) * F.lit(cover))
    return rows.withColumn("holds", F.coalesce((F.size("taken") >= F.col("n_grams") * least) & telling, F.lit(False)))


def scan(docs: DataFrame, cover: float = COVER, templates=TEMPLATES, base=BASE_PHRASES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    spark = docs.sparkSession
    found = spans(votes(docs, template_grams(spark, templates, base)), template_facts(spark, templates, base), cover)
    place = F.when(F.col("is_base") & F.col("holds"), F.col("diagonal").cast("long"))
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    per = found.groupBy("doc_id", "_mark").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        names(F.col("is_base") & F.col("holds")).alias("base_labels"),
        names(F.col("holds")).alias("labels"),
        F.max("share").alias("score"),
    )
    per = stash(per, "license-hits").withColumnsRenamed({"doc_id": "_id", "_mark": "_m"})
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mark"), F.size(license_words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m")), "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
