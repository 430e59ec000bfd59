"""Licence notices in texts: a trained paragraph classifier whose predictions templates confirm.

Marks of comments at the begin of lines go first, and a paragraph ends at a blank line. What is classified are its lines of up
to `WINDOW` words and, of paragraphs of several lines or of more words, windows of `WINDOW` words every `STRIDE`, which is no
more than what a window has beyond the longest template: each notice lies whole in one. An SPDX expression is
as many lines as it names licences. The words and word pairs of such a unit are hashed into a sparse vector; a multinomial
logistic regression, trained from a small labelled table of notices and of prose (`training_rows`), gives a score for each
licence family and for the unknown class. Scores are calibrated by a temperature fitted on notices and prose that training
doesn't see (`held_rows`), and a unit that is unknown with more than 1 - `LEAST_PROBABILITY` holds none.

Templates are compared by their three-word shingles that hold a word of `TELLING`, a number or "version". Of those that have
`LEAST_SHARE` of their shingles in the unit, in order of their share and then their length, one is taken if most of what it has
there isn't in those taken before: so a version's template goes before those of other versions, which share its words, and two
licences side by side are both taken. Where equal templates of different families have the same words, none is. What is taken
confirms the prediction if the classes of these families, with their versions, have `LEAST_PROBABILITY` together. A family
without a version isn't listed beside a version of it.

A unit without a word of `TELLING` can't hold `LEAST_SHARE` of any template's shingles; such units are unknown before they are
made into vectors, which changes no result.

All of it is DataFrame functions and Spark ML transformers, which run in the JVM. Paragraphs are never shuffled: only
confirmed ones, a few words each, are gathered by document.

Defined results: a null or blank text has no paragraphs; a document without notices gets an empty list; a null doc_id
is kept; repeated rows get equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, quoted

FEATURES, LEAST_PROBABILITY, LEAST_SHARE, WINDOW, STRIDE = 1 << 13, 0.5, 0.67, 64, 20
#: Words that a template has at most.
LONGEST = WINDOW - STRIDE
UNKNOWN = "unknown"
#: Words by which notices tell themselves from prose.
TELLING = tuple("license licence licensed gnu gpl lgpl agpl gplv2 gplv3 lgplv2 lgplv3 agplv3 bsd isc cc cc0 commons apache mozilla mpl eclipse epl boost zlib spdx domain unlicense unencumbered rights copyright permission redistribution permitted endorse warranty liable software hereby granted waived".split())
CUE = "(?<![\\p{L}\\p{N}])(?:" + "|".join(TELLING) + ")(?![\\p{L}\\p{N}])"
GNU_NAMES = (("gpl", "General Public License", "GPL"), ("lgpl", "Lesser General Public License", "LGPL"), ("agpl", "Affero General Public License", "AGPL"))
GNU_VERSIONS = {"gpl": ("2.0", "3.0"), "lgpl": ("2.1", "3.0"), "agpl": ("3.0",)}
#: Families of which others are versions.
BASES = ("gpl", "lgpl", "agpl", "bsd")
#: Families: SPDX identifier, and names that follow "under".
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache-2.0", "the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license"),
    "mit": ("MIT", "the MIT License", "an MIT license", "the MIT licence"),
    "isc": ("ISC", "the ISC License"),
    "bsd": ("", "the BSD License", "a BSD-style license"),
    "bsd-2-clause": ("BSD-2-Clause", "the 2-Clause BSD License", "the BSD 2-Clause License", "the Simplified BSD License"),
    "bsd-3-clause": ("BSD-3-Clause", "the 3-Clause BSD License", "the BSD 3-Clause License", "the New BSD License"),
    **{base: ("", f"the GNU {name}", f"the GNU {short}", f"the {short} license") for base, name, short in GNU_NAMES},
    **{
        f"{base}-{v}": (f"{short}-{v}-only", *(f"the GNU {name}{form}" for form in (f", version {v}", f", version {v.removesuffix('.0')}", f" v{v}", f" v{v.removesuffix('.0')}", f" {v}")), *(f"the {gnu}{short}{form}" for gnu in ("GNU ", "") for form in (f", version {v.removesuffix('.0')}", f" v{v.removesuffix('.0')}", f" {v}")), f"the terms of {short}v{v.removesuffix('.0')}")
        for base, name, short in GNU_NAMES for v in GNU_VERSIONS[base]
    },
    "mpl-2.0": ("MPL-2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "the MPL 2.0"),
    "epl-2.0": ("EPL-2.0", "the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0", "the EPL 2.0"),
    "bsl-1.0": ("BSL-1.0", "the Boost Software License, Version 1.0", "the Boost Software License 1.0"),
    "zlib": ("Zlib", "the zlib License", "the zlib/libpng license"),
    "cc0": ("CC0-1.0", "CC0 1.0 Universal", "the Creative Commons CC0 1.0 license"),
    "cc-by": ("CC-BY-4.0", "CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 License"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike 4.0 License"),
    "cc-by-nd": ("CC-BY-ND-4.0", "CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "the Creative Commons Attribution-NoDerivatives 4.0 License"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial 4.0 License"),
    "cc-by-nc-sa": ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd": ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "public-domain": ("Unlicense", "the Unlicense license"),
    "reserved": ("",),
}
#: Notices that are no phrase with a name. @ stands for a version.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
VERSIONED = GNU + ", either version {} of the License, or (at your option) any later version"
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-3-clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "gpl": (GNU.format("General Public License"),),
    "gpl-2.0": (VERSIONED.format("General Public License", "2"),),
    "gpl-3.0": (VERSIONED.format("General Public License", "3"),),
    "lgpl": (GNU.format("Lesser General Public License"), GNU.format("Lesser General Public License").replace("program", "library")),
    "lgpl-2.1": (VERSIONED.format("Lesser General Public License", "2.1"), VERSIONED.format("Lesser General Public License", "2.1").replace("program", "library")),
    "lgpl-3.0": (VERSIONED.format("Lesser General Public License", "3"), VERSIONED.format("Lesser General Public License", "3").replace("program", "library")),
    "agpl": (GNU.format("Affero General Public License"),),
    "agpl-3.0": (VERSIONED.format("Affero General Public License", "3"),),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "public-domain": ("This work is in the public domain", "This is free and unencumbered software released into the public domain", "released into the public domain by its author"),
    "reserved": ("All rights reserved", "Copyright 2020 The Authors. All rights reserved"),
}
#: Marks of comments before a line's text.
COMMENT = "(?m)^[\\x20\\t]*(?:(?:/\\*+|\\*+/?|//+!?|#+|;+|--+|<!--+|%+|[\"]{3}|[']{3}|dnl(?=\\s)|REM(?=\\s)|[.]{2}(?=\\s))[\\x20\\t]*)+"
SPDX = "(?i)spdx-license-identifier:?\\s*"
#: What goes around a short name.
FIELDS = ("License: {}", "Licence: {}", "{} licensed")
#: What goes before a name in training, and in calibration.
PHRASES = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "Distributed under {}", "under the terms of {}")
HELD_PHRASES = ("Available under {}", "This file is covered by {}", "You may use it under {}", "The code is published under {} today")
PROSE = (
    "The river was high that spring and the fields lay under water until May", "He lost his driving license and had to walk to work", "She was released from prison under strict conditions",
    "Version 2 of the report is due on Friday", "The general public was not told of it", "Parking is permitted on this side with a permit", "You may use the file on the table", "They keep the right to a reserved seat",
    "The works of the author were published in three volumes", "A fishing licence costs ten a year", "Of the and to in that it was for on are as with his they at be this from", "Die Leute kamen aus der Stadt und gingen durch den Wald nach Hause",
    "Les gens de la ville sont venus par la forêt et ils ont mangé", "La gente de la ciudad vino por el camino y comió en la plaza", "In the morning we copied the documentation by hand", "The terms of the peace were hard but free of hate",
    "An apache helicopter flew over the hills", "My students at MIT like the lake", "Gnu and zebra graze on the same plain", "Common people create more than they are given credit for", "A", "The", "Read more about the software foundation in the news",
    "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose", "See the license for details", "You should have received a copy of the license along with this program",
    "the city licensed under new rules ten more bars", "The film was released under another title in France", "The park is in the public eye", "The mozilla browser and the eclipse editor were open on both screens", "The boost in sales came in version 4",
    "He wrote a long paper on the MIT License and its history", "Lawyers argue about the GPL to this day", "What is the difference between the Apache License and the BSD License", "They asked whether all rights were theirs",
    "A talk on why the Mozilla Public License was written and who reads it", "The book compares the GNU General Public License and the MIT License at length", "He prefers the Apache License to the MIT License and says so", "Is the ISC License older than the BSD License", "She compared both licences in class and found the Boost Software License shorter",
)
HELD_PROSE = (
    "The ferry was late and the people on the pier told stories of other ferries", "Her licence to drive a truck was renewed in March", "The book was released under the old name", "All seats are reserved for members of the club", "Version 3 of the plan has more details", "The public library keeps a copy of every work",
    "He was permitted to use the lab under the terms of his visit", "Der alte Mann und seine Tochter wohnten am Rand des Dorfes", "Elle a copié le document et elle est partie", "The code of the safe was known to three people", "Software and hardware were bought in the same year", "An eclipse was seen over the general's house",
    "She compared the MIT License with the Apache License in her talk", "The GPL was written in the eighties", "Released under the Artistic License 2.0", "Licensed under the SIL Open Font License, Version 1.1", "This work is licensed under the Open Database License", "Distributed under the Sleepycat License",
    "A license is required to use the software of the bank", "The software is licensed under terms that nobody has read", "Version 3 of the license was never published", "All rights to the film are with the studio", "Permission to park here is granted to guests", "Redistribution of land was not permitted",
    "The commons of the village are under water", "Copyright lasts for seventy years after the death of the author", "Licensed under patent 5,123,456 and version 2.0 of the treaty", "GNU software is made by volunteers",
)
#: What is put around notices for training.
AROUND = (("", ""), ("the", ""), ("", "today and so on"), ("page 3 note that in fact", "as of now for all of us"))


def phrased(phrases: tuple[str, ...], spdx: bool) -> list[tuple[str, str]]:
    """(family, notice) of every name in every phrase."""
    return [(f, p.format(n)) for f, (_, *names) in NAMES.items() for n in names for p in phrases] + [(f, f"SPDX-License-Identifier: {i}") for f, (i, *_) in NAMES.items() if i and spdx]


def short_names() -> list[tuple[str, str]]:
    """(family, name): identifiers, and names without their article."""
    out = []
    for family, (spdx, *names) in NAMES.items():
        base, dash, version = family.partition("-")
        gnu = [f"{base}v{version.removesuffix('.0')}", f"{base}-{version}"] if dash and base in GNU_VERSIONS else []
        bare = [re.sub("^(?:the terms of|the|an?) ", "", n) for n in names]
        cc = [n.removesuffix(" License").removesuffix(" International") for n in bare if "Commons" in n]
        out += [(family, n) for n in dict.fromkeys([spdx, *gnu, *bare[:1], *cc]) if n]
    return out


def fielded() -> list[tuple[str, str]]:
    return [(f, p.format(n)) for f, n in short_names() for p in FIELDS]


def notices() -> list[tuple[str, str]]:
    return [(f, n) for f, some in NOTICES.items() for n in some]


def templates() -> list[tuple[str, str]]:
    """(family, text): the names alone, short names in fields, and the longer notices."""
    return phrased(("{}",), True) + fielded() + notices()


def training_rows() -> list[tuple[str, str]]:
    return [(f, f"{a} {p} {b}") for f, p in [*phrased(PHRASES, True), *fielded(), *notices(), *((UNKNOWN, p) for p in PROSE)] for a, b in AROUND]


def held_rows() -> list[tuple[str, str]]:
    return phrased(HELD_PHRASES, False) + [(UNKNOWN, p) for p in HELD_PROSE]


def words_of(paragraph: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(paragraph, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def terms_of(words: Column) -> Column:
    """Words, and pairs of words side by side."""
    return bound(words, lambda w: F.concat(w, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))))


def shingles_of(words: Column) -> Column:
    """Hashes of three words, of which one at least is telling or of a version; of fewer words, all together."""
    telling = lambda x: F.coalesce(x.isin(*TELLING, "version") | x.rlike("[0-9]"), F.lit(False))

    def three(w: Column) -> Column:
        each = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(1))), lambda x, i: F.when(telling(x) | telling(F.get(w, i + 1)) | telling(F.get(w, i + 2)), F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
        return F.array_distinct(F.array_compact(each))

    return bound(words, three)


def values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small table (family, paragraph)."""
    return spark.createDataFrame(rows, "family string, paragraph string")


def units(docs: DataFrame) -> DataFrame:
    """docs(text, ...) -> a row for each unit that can hold a notice: the other columns, `nth` (its paragraph) and `paragraph`."""
    may = lambda x: x.rlike(CUE)
    keep = [c for c in docs.columns if c != "text"]
    plain = docs.where(may(F.lower("text"))).withColumn("text", F.regexp_replace("text", COMMENT, ""))
    blocks = plain.select(*keep, F.posexplode(F.split("text", "\\n[\\x20\\t\\x0B-\\x0D]*(?=\\n)")).alias("nth", "block")).where(may(F.lower("block")))
    lines = F.filter(F.split("block", "\\n"), lambda x: may(F.lower(x)))
    # of an SPDX expression each licence by itself
    named = lambda x: F.when(x.rlike(SPDX), F.transform(F.filter(F.split(F.regexp_replace(x, f"^.*?{SPDX}", ""), "(?i)\\s+(?:or|and|with)\\s+|[()]"), lambda y: F.trim(y) != ""), lambda y: F.concat(F.lit("SPDX-License-Identifier: "), y))).otherwise(F.array(x))
    few = F.flatten(F.transform(F.filter(lines, lambda x: F.size(F.split(F.trim(x), "\\s+")) <= WINDOW), named))

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (WINDOW - STRIDE), F.lit(1)), F.lit(STRIDE))
        return F.filter(F.transform(starts, lambda a: F.array_join(F.slice(words, a, F.lit(WINDOW)), " ")), may)

    several = F.col("block").rlike("\\S[^\\n]*\\n[\\s\\S]*\\S") | (F.size(F.split(F.trim("block"), "\\s+")) > WINDOW)
    wide = F.when(several, bound(words_of(F.col("block")), windows)).otherwise(F.array().cast("array<string>"))
    return blocks.select(*keep, "nth", F.explode(F.concat(few, wide)).alias("paragraph"))


class Classifier:
    """A trained model, its classes, its temperature and the templates."""

    def __init__(self, spark: SparkSession):
        self.names = sorted({*NAMES, UNKNOWN})
        self.hashing = HashingTF(inputCol="terms", outputCol="vector", numFeatures=FEATURES, binary=True)
        number = F.array_position(F.lit(self.names), F.col("family")).cast("double") - 1
        vectors = self.vectors(values(spark, training_rows())).withColumn("label", number).coalesce(1).cache()
        self.model: LogisticRegressionModel = LogisticRegression(featuresCol="vector", labelCol="label", family="multinomial", regParam=0.0005, maxIter=60, tol=1e-4).fit(vectors)
        self.model = self.model.setRawPredictionCol("raw").setProbabilityCol("").setPredictionCol("")
        vectors.unpersist()
        scored = self.raw(values(spark, held_rows())).withColumn("label", number.cast("int")).select("raw", "label").collect()  # the labelled table's rows
        self.temperature = min((0.05 * 1.15**k for k in range(40)), key=lambda t: self.loss(scored, t))
        rows = values(spark, templates()).select("family", shingles_of(words_of(F.col("paragraph"))).alias("s")).collect()  # the templates
        self.template_families, self.template_shingles = [r.family for r in rows], [list(r.s) for r in rows]

    @staticmethod
    def loss(rows: list, t: float) -> float:
        total = 0.0
        for raw, label in rows:
            m = max(raw)
            total += math.log(sum(math.exp((x - m) / t) for x in raw)) - (raw[label] - m) / t
        return total

    def vectors(self, paragraphs: DataFrame) -> DataFrame:
        return self.hashing.transform(paragraphs.withColumn("terms", terms_of(words_of(F.col("paragraph"))))).drop("terms")

    def raw(self, paragraphs: DataFrame) -> DataFrame:
        return self.model.transform(self.vectors(paragraphs)).withColumn("raw", vector_to_array("raw")).drop("vector")

    def predicted(self, paragraphs: DataFrame) -> DataFrame:
        """The paragraphs that aren't unknown, with the calibrated probabilities `odds` of the classes."""
        scored = self.raw(paragraphs)
        each = F.transform("raw", lambda x: F.exp((x - F.array_max("raw")) / F.lit(self.temperature)))
        scored = scored.withColumn("odds", bound(each, lambda e: bound(F.aggregate(e, F.lit(0.0), lambda t, x: t + x), lambda total: F.transform(e, lambda x: x / total))))
        return scored.where(F.get("odds", F.lit(self.names.index(UNKNOWN))) <= 1 - LEAST_PROBABILITY).drop("raw")

    def confirmed(self, paragraphs: DataFrame) -> DataFrame:
        """Of predicted paragraphs those that templates confirm: a row a family, with the families' `probability` and its template's `share`."""
        known = sorted({h for s in self.template_shingles for h in s})
        members = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(len(s)).alias("n"), F.lit(s).alias("s")) for f, s in zip(self.template_families, self.template_shingles, strict=True)])
        bases = F.array(*[F.lit(next((b for b in BASES if n.startswith(f"{b}-")), n)) for n in self.names])

        def candidates(own: Column) -> Column:
            """Templates by share and length, of those that have the least share."""
            each = F.transform(members, lambda t: bound(F.array_intersect(t["s"], own), lambda h: F.struct((F.size(h) / t["n"]).alias("share"), F.size(h).alias("hit"), t["family"].alias("family"), F.array_sort(h).alias("s"))))
            return F.sort_array(F.filter(each, lambda t: t["share"] >= LEAST_SHARE), asc=False)

        def taken(some: Column) -> Column:
            """Of the candidates those that are mostly their own, one after another."""
            even = lambda t: F.exists(some, lambda u: (u["share"] == t["share"]) & (u["s"] == t["s"]) & (u["family"] != t["family"]))
            start = F.struct(F.array().cast("array<struct<family:string,share:double>>").alias("out"), F.array().cast("array<bigint>").alias("seen"))
            step = lambda acc, t: F.when(
                ~even(t) & (2 * F.size(F.array_except(t["s"], acc["seen"])) > t["hit"]),
                F.struct(F.concat(acc["out"], F.array(F.struct(t["family"].alias("family"), t["share"].alias("share")))).alias("out"), F.array_union(acc["seen"], t["s"]).alias("seen")),
            ).otherwise(acc)
            return F.aggregate(some, start, step)["out"]

        own = F.array_intersect(F.lit(known), shingles_of(words_of(F.col("paragraph"))))
        scored = self.predicted(paragraphs).withColumn("found", F.when(F.size(own) > 0, bound(own, lambda o: bound(candidates(o), taken)))).where(F.size("found") > 0)
        theirs = F.transform("found", lambda f: base_of(f["family"]))
        scored = scored.withColumn("probability", bound(theirs, lambda t: F.aggregate(F.zip_with("odds", bases, lambda p, b: F.when(F.array_contains(t, b), p).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)))
        each = scored.where(F.col("probability") >= LEAST_PROBABILITY).withColumn("_f", F.explode("found"))
        return each.withColumns({"family": F.col("_f.family"), "share": F.col("_f.share")}).drop("_f", "found", "odds")


def base_of(family: Column) -> Column:
    """The family of which this one may be a version."""
    return F.when(F.split(family, "-")[0].isin(*BASES), F.split(family, "-")[0]).otherwise(family)


def listed(families: Column) -> Column:
    """Families in order, without those of which a version is among them."""
    return F.filter(F.array_sort(families), lambda f: ~(f.isin(*BASES) & F.exists(families, lambda v: (base_of(v) == f) & (v != f))))


def licences(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, licences (families, sorted, comma-joined), n_notices (paragraphs with a notice) of each document."""
    classifier = classifier or Classifier(docs.sparkSession)
    ids = docs.select(quoted("doc_id").alias("doc_id"), F.xxhash64(quoted("text")).alias("page"))
    rows = docs.select(quoted("doc_id").alias("doc_id"), F.xxhash64(quoted("text")).alias("page"), quoted("text").cast("string").alias("text"))
    found = classifier.confirmed(units(rows))
    by = found.groupBy("doc_id", "page").agg(F.array_join(listed(F.collect_set("family")), ",").alias("licences"), F.count_distinct("nth").alias("n_notices"))
    match = ids["doc_id"].eqNullSafe(by["doc_id"]) & (ids["page"] == by["page"])
    return ids.join(by, match, "left").select(ids["doc_id"], F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
