"""Licence scans with a trained paragraph classifier, in DataFrame expressions only.

Paragraphs are lines; a line that ends without punctuation goes on in the next one if
that begins in lower case, so hard-wrapped notices are one paragraph. Their features are
the words and word pairs of the training rows, the paragraph's start and end counted as
words, and how many of their words no such row has. A multinomial logistic regression over
families and an unknown class is fitted, on the driver, to a fixed set: the notices below
and their sentences, the names of licences in frames that say that one holds, and, as
unknown, sentences without a licence and the names in frames that only speak of them. The
temperature that calibrates its probabilities is fitted to notices with words left out. A
prediction is confirmed by comparison: a notice of the family, one of its sentences or one
of its names with a word such as "licensed" must have at least ``CONFIRM`` of its features
in the paragraph. A paragraph that names two licences has the likelier one.

Words are runs of a-z and 0-9 after lowering A-Z; words of STOP alone are no feature,
so paragraphs without a pair that is one are unknown and make no rows. Null and empty
texts have no paragraph. Null ids are carried. Repeated rows count once; rows that share
an id but not the text each have theirs. Of families with equal scores the last by name
is taken. Other columns are ignored.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

# Short public notices by family.
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.", "Licensed under the GNU Affero General Public License version 3.", "Released under the AGPL 3.0 license.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution license."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0, for noncommercial use."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, dedicated to the public domain.", "CC0 1.0 Universal Public Domain Dedication."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2.", "Released under the GPL v3 license.", "Licensed under the GPLv3.", "Licensed under GPL 2.0 or later.", "SPDX-License-Identifier: GPL-3.0-only"],
    "bsl": ["Distributed under the Boost Software License, Version 1.0.", "Released under the Boost Software License.", "SPDX-License-Identifier: BSL-1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License v2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "eupl": ["Licensed under the EUPL.", "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL 3.0.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.", "Released under the MIT License.", "Licensed under the MIT License.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "mit-0": ["Released under the MIT-0 License.", "Licensed under MIT No Attribution.", "SPDX-License-Identifier: MIT-0"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.", "SPDX-License-Identifier: Unlicense"],
}
# Sentences that share words with notices and are none.
OTHER = ["The driver lost his license after the accident.", "The software was released in version 2 last year.", "You need a permission slip from the school.", "The general public is welcome at the library.", "They work under difficult conditions.", "A copy of the book is in the source room.", "The apache helicopter flew over the valley.", "She studied at MIT and works on software.", "The warranty of the car covers all parts.", "Please distribute the notes to any person in the class.", "The files are in binary form.", "Copyright law is taught in the second year.", "The terms of the contract were published.", "Free software foundation members met in Boston.", "The international creative commons summit was held in Lisbon.", "Use the following list of names.", "The public domain of the function is the real line.", "Version 3 of the form is used for any purpose.", "All rights of the workers are reserved in law.", "The notice appears on page 4 of the file.", "Our MIT license review is released under embargo.", "The license was released last week.", "He has a license to fish.", "An apache license plate is red.", "The creative work is licensed under a secret contract.", "The software license of the vendor costs more in version 2.", "The public license office is closed.", "All rights were granted to the publisher of the work.", "The general terms of the license are under review.", "The commons is open to the public under the terms of the city."]
# What licences are called in short, SPDX ids included.
NAMES = {
    "agpl": ["AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL v3", "GNU Affero General Public License v3.0", "GNU Affero GPL"],
    "apache": ["Apache", "Apache 2", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "ASL 2.0", "Apache v2"],
    "bsd": ["BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD 3-Clause", "3-clause BSD", "2-clause BSD", "New BSD", "modified BSD", "simplified BSD", "BSD-style"],
    "bsl": ["BSL-1.0", "Boost Software License", "Boost Software License 1.0"],
    "cc-by": ["CC BY", "CC-BY", "CC-BY-4.0", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International", "Creative Commons BY"],
    "cc-by-nc": ["CC BY-NC", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons BY-NC"],
    "cc-by-sa": ["CC BY-SA", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons BY-SA"],
    "cc0": ["CC0", "CC0-1.0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons Zero v1.0"],
    "epl": ["EPL", "EPL-2.0", "EPL 1.0", "Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v1.0"],
    "eupl": ["EUPL", "EUPL-1.2", "EUPL 1.2", "European Union Public Licence", "European Union Public License 1.2"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GPL v3", "GPL-2.0", "GPL-2.0-only", "GPL-3.0", "GPL-3.0-or-later", "GPL version 2", "GPL version 3", "GNU GPL", "GNU GPL v3", "GNU General Public License", "GNU General Public License v2.0", "GNU General Public License v3.0", "GNU General Public License version 3"],
    "isc": ["ISC"],
    "lgpl": ["LGPL", "LGPLv2", "LGPLv3", "LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0", "GNU LGPL", "GNU Lesser General Public License", "GNU Lesser General Public License v2.1", "GNU Library General Public License"],
    "mit": ["MIT", "MIT/X11", "MIT (Expat)", "Expat MIT", "MIT-style"],
    "mit-0": ["MIT-0", "MIT No Attribution"],
    "mpl": ["MPL", "MPL-2.0", "MPL 2.0", "MPL 1.1", "Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "zlib": ["zlib", "zlib/libpng"],
}
# How a paragraph says which licence holds, and how one speaks of a name without saying so.
FRAMES = ["{}", "{} license", "The {} license", "{} licensed", "License: {}", "Licence: {}", "license {}", "SPDX-License-Identifier: {}", "Licensed under {}.", "Licensed under the {}.", "Licensed under the {} license.", "Released under {}.", "Released under the {} license.", "Distributed under the terms of the {} license.", "This project is {} licensed.", "This project is licensed under the {} license.", "This software is licensed under {}.", "See the LICENSE file for the {} license text.", "The code is available under the {}.", "The data are made available under {}.", "This is free software under the {}.", "This work is licensed under a {} license.", "Published under {}.", "{} or later", "Copyright 2020 the authors. {} license.", "You may use it under the terms of the {}.", "Ce document est mis à disposition sous licence {}.", "Lizenziert unter der {}.", "Publicado bajo la licencia {}.", "Code: {}", "Documentation: {}.", "Everything here is {}.", "The package is distributed under the {}.", "It is free to use under {}.", "Released into the world under {}."]
OTHER_FRAMES = ["She studied {} for a year.", "Our {} license review is late.", "This is part of a {} project.", "We compared {} with three others in the survey.", "The {} team met in the morning.", "He gave a talk on {} and its history.", "What does {} mean?", "The article on the {} license was released last week.", "Lawyers argue about {} in court.", "They left {} years ago.", "{} announced a new product.", "{} is a company in the city.", "The {} license was changed after a long debate.", "In the survey the {} license came first."]
OTHER += ["All rights reserved by the tenants of the house.", "All rights of the owner are reserved by the court.", "All human rights are reserved for people.", "A fishing license is available under the terms of the city.", "The license of the public was general.", "The terms of use were published.", "License", "The license", "See the license file.", "The project is licensed.", "Copyright 2020 the authors.", "The code is available.", "The data are made available on request.", "The text is available in the library.", "You may use it in the morning.", "The attribution of the painting is contested.", "The commons voted on the bill.", "Public", "Version 2.0", "Free software is a matter of liberty.", "The house is released under bail.", "The ship was licensed in 1920.", "A license number is needed.", "The software is distributed to schools.", "Boost your sales with a new version.", "The eclipse was seen in public.", "The modified file was copied."]
NOTICES["proprietary"] += ["All rights reserved.", "Copyright 2020 the company. All rights reserved.", "Proprietary and confidential.", "This is proprietary software. All rights reserved."]
# Names of one word that mean nothing else.
PLAIN = frozenset("agpl agplv3 cc0 eupl gpl gplv2 gplv3 lgpl lgplv2 lgplv3".split())
#: A German word that is no licence's name.
WITH = r"(?<![A-Za-z0-9])Mit(?![A-Za-z0-9]|[ -]?[Ll]icen[sc])"
#: A paragraph's start and end.
START, END = "^", "$"
STOP = frozenset("a all an and any any appear are as at be by can for form forms from has have he her his if in into is it its may more need needs new no not of on one or other part she such than that the their they this to under up used use was were which who will with you your 0 1 2 3 4 5 v".split()) | {START, END}

#: Least probability of a family, and least share of a notice's features that the paragraph has.
LEAST, CONFIRM = 0.5, 0.75
#: Features for paragraphs with words that no notice has, by their share.
FEW, MANY, SHARE = "#few", "#many", 0.34


def words_of(text: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(WITH, " ", text))) if x]


def grams(text: str, known: frozenset[str] | None = None) -> list[str]:
    """Features of a text, with repetition; ``known`` are the notices' words."""
    w = words_of(text)
    bounded = [START, *w, END]
    pairs = [f"{a} {b}" for a, b in zip(bounded[:-1], bounded[1:], strict=True) if not (a in STOP and b in STOP)]
    foreign = len(set(w) - known) / len(set(w)) if w and known is not None else 0
    return [x for x in w if x not in STOP] + pairs + ([MANY if foreign > SHARE else FEW] if foreign else [])


def sentences(notice: str) -> list[str]:
    """The notice and its sentences."""
    return list(dict.fromkeys([notice, *re.split(r"(?<=[.;])\s+", notice)]))


KNOWN = frozenset(w for ts in [*NOTICES.values(), *NAMES.values(), FRAMES] for t in ts for w in words_of(t)) | STOP


def _rows() -> tuple[list[list[str]], list[str], list[list[str]], list[str], int]:
    """Rows to fit and their labels, rows with words left out and theirs, and how many of the first, at the end, are about names."""
    fit, label, held, held_label = [], [], [], []
    parts = [(c, part) for c, ts in [*NOTICES.items(), ("unknown", OTHER)] for t in ts for part in sentences(t)]
    for family, part in parts:
        g = grams(part, KNOWN)
        bare = [x for x in g if x not in (FEW, MANY)]
        for row in [g, bare] if family == "unknown" else [g, [*g, FEW], [*g, MANY]]:  # a notice with a name or a file around it is one too
            fit.append(row), label.append(family)
        for k in range(3):
            if len(rest := [x for i, x in enumerate(g) if (i + k) % 3]) > 1:
                held.append(rest), held_label.append(family)
    first = len(fit)
    for family, names in NAMES.items():
        for i, name in enumerate(names):
            for j, frame in enumerate(FRAMES):
                g = grams(frame.format(name), KNOWN)
                inside = [x for x in g if START not in x and END not in x]
                for row in ([*g, FEW] if (i + j) % 2 else g, [*inside, MANY]):  # alone, and within more text
                    fit.append(row), label.append(family)
            for frame in OTHER_FRAMES:
                fit.append(grams(frame.format(name), KNOWN)), label.append("unknown")
    return fit, label, held, held_label, len(fit) - first


def templates() -> list[tuple[str, int, frozenset[str]]]:
    """Family, number and features of every notice, of its sentences of three features or more, and of the names with the words that make them a licence's."""
    inner = lambda t: frozenset(g for g in grams(t) if START not in g and END not in g)
    parts = [(c, inner(t)) for c, ts in sorted(NOTICES.items()) for whole in ts for t in sentences(whole) if t == whole or len(inner(t)) >= 3]
    parts += [(c, inner(cue.format(n))) for c, ns in sorted(NAMES.items()) for n in ns for cue in ("{} license", "{} licensed", "license {}", "under {}", "licensed under the {}", "released under the {}", "terms of the {}", "licence {}")]
    # a name that is an ordinary word as well must stand alone, or with such words
    parts += [(c, inner(n) if len(inner(n)) > 1 or n.lower() in PLAIN else frozenset(grams(n))) for c, ns in sorted(NAMES.items()) for n in ns]
    return [(c, i, g) for i, (c, g) in enumerate(dict.fromkeys(parts))]


class Classifier:
    """Weights of a multinomial logistic regression; ``unknown`` is the last class."""

    def __init__(self, rounds: int = 300, rate: float = 0.6, decay: float = 1e-3):
        fit, label, held, held_label, about = _rows()
        self.classes = [*sorted(NOTICES), "unknown"]
        self.vocabulary = sorted({g for f, y in zip(fit, label, strict=True) if y != "unknown" for g in f})
        y = np.array([self.classes.index(c) for c in label])
        row, gram = self._entries(fit)
        by_gram = np.argsort(gram, kind="stable")
        used, starts = np.unique(gram[by_gram], return_index=True)
        w, b = np.zeros((len(self.vocabulary), len(self.classes))), np.zeros(len(self.classes))
        b[-1] = 2.0  # no feature: unknown
        one = np.eye(len(self.classes))[y]
        # families weigh the same; sentences without a name weigh as much as two families, those about a name as half of one
        named = np.array([c == "unknown" and k >= len(fit) - about for k, c in enumerate(label)])
        group = np.where(named, len(self.classes), y)
        share = (np.array([1.0] * (len(self.classes) - 1) + [2.0, 0.5]) / np.maximum(np.bincount(group, minlength=len(self.classes) + 1), 1))[group][:, None]
        for _ in range(rounds):
            d = (one - self._softmax(self._sums(w, row, gram, len(fit)) + b)) * share
            w *= 1 - rate * decay
            w[used] += rate * np.add.reduceat(d[row[by_gram]], starts)
            b[:-1] += rate * 0.05 * (d.sum(0)[:-1] - d.sum(0)[-1])
        hz, hy = self._sums(w, *self._entries(held), len(held)) + b, np.array([self.classes.index(c) for c in held_label])
        loss = lambda t: -np.log(self._softmax(hz * t)[np.arange(len(hy)), hy] + 1e-12).mean()
        self.scale = float(min(np.geomspace(0.25, 4, 33), key=loss))
        self.w, self.b = w * self.scale, b * self.scale

    def _entries(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature number of each feature that a row has, by row."""
        at = {g: i for i, g in enumerate(self.vocabulary)}
        found = [(r, at[g]) for r, row in enumerate(rows) for g in dict.fromkeys(row) if g in at]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    @staticmethod
    def _sums(w: np.ndarray, row: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """The sum of its features' weights for each row."""
        out = np.zeros((n, w.shape[1]))
        if len(row):
            some, starts = np.unique(row, return_index=True)
            out[some] = np.add.reduceat(w[gram], starts)
        return out

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, text: str) -> tuple[str, float]:
        p = self._softmax(self._sums(self.w, *self._entries([grams(text, KNOWN)]), 1) + self.b)[0]
        return self.classes[int(p.argmax())], float(p.max())

    def weights(self, spark: SparkSession) -> DataFrame:
        """gram, family, weight: a few thousand rows, as large as the notices."""
        rows = [(g, c, float(self.w[i, k])) for i, g in enumerate(self.vocabulary) for k, c in enumerate(self.classes)]
        return spark.createDataFrame(rows, "gram string, family string, weight double")


def paragraph_grams(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, t (the text's hash), paragraph (number from 0), gram: the distinct features of each paragraph that has any."""
    words = [g for g in vocabulary if " " not in g and g not in (FEW, MANY)]
    pairs = [g for g in vocabulary if " " in g]
    known = sorted(KNOWN)
    joined = F.regexp_replace("text", r"([^.!?:;\s])[ \t]*\r?\n[ \t]*(?=[a-z(])", "$1 ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.posexplode(F.split(joined, "\n")).alias("paragraph", "line"))
    key = ["doc_id", "t", "paragraph"]
    rows = rows.select(*key, F.array_remove(F.split(F.translate(F.regexp_replace("line", WITH, " "), ascii_uppercase, ascii_lowercase), "[^a-z0-9]+"), "").alias("w"))
    rows = rows.select(*key, "w", F.array_distinct(F.filter("w", lambda x: x.isin(words))).alias("one"))
    # every pair has a word that is a feature itself, so a paragraph without one has none
    both = F.zip_with(F.concat(F.array(F.lit(START)), "w"), F.concat("w", F.array(F.lit(END))), lambda x, y: F.concat_ws(" ", x, y))
    rows = rows.select(*key, "w", "one", F.when(F.size("one") > 0, F.array_distinct(F.filter(both, lambda x: x.isin(pairs)))).alias("two"))
    foreign = F.size(F.array_distinct(F.filter("w", lambda x: ~x.isin(known)))) / F.size(F.array_distinct("w"))
    mark = F.when(foreign == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(foreign > SHARE, MANY).otherwise(FEW)))
    # explode_outer: a filter before it would be pushed down and evaluate the word array once an element
    rows = rows.select(*key, F.explode_outer(F.when(F.size("two") > 0, F.concat("one", "two", mark))).alias("gram"))
    return rows.where("gram is not null").distinct()


def scan(docs: DataFrame, least: float = LEAST, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, paragraph, family, probability, confirmed_share of each paragraph whose licence is predicted and confirmed."""
    spark = docs.sparkSession
    model = Classifier()
    key = ["doc_id", "t", "paragraph"]
    found = materialize(paragraph_grams(docs, model.vocabulary))
    scores = found.join(F.broadcast(model.weights(spark)), "gram").groupBy(*key, "family").agg(F.sum("weight").alias("z"))
    bias = spark.createDataFrame([(c, float(v)) for c, v in zip(model.classes, model.b, strict=True)], "family string, b double")
    scores = scores.join(F.broadcast(bias), "family").withColumn("z", F.col("z") + F.col("b"))
    best = scores.groupBy(*key).agg(F.max(F.struct("z", "family")).alias("m"), F.sum(F.exp("z")).alias("total"))
    best = best.select(*key, F.col("m.family").alias("family"), (F.exp("m.z") / F.col("total")).alias("probability"))
    best = best.where(F.col("family") != "unknown").where(F.col("probability") >= least)
    notices = spark.createDataFrame([(c, i, g, len(gs)) for c, i, gs in templates() for g in sorted(gs)], "family string, notice int, gram string, size int")
    # null-safe, so that paragraphs of a null id meet their own features
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    likely = found.alias("f").join(best.alias("b"), same).select(*(f"b.{c}" for c in key), "family", "probability", "gram")
    shares = likely.join(F.broadcast(notices), ["family", "gram"]).groupBy(*key, "family", "probability", "notice").agg((F.count("*") / F.first("size")).alias("share"))
    out = shares.groupBy(*key, "family", "probability").agg(F.max("share").alias("confirmed_share"))
    return out.where(F.col("confirmed_share") >= confirm).select("doc_id", "paragraph", "family", "probability", "confirmed_share")


def op5_license_scans(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
