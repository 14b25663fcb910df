"""Licence scans by a trained paragraph classifier, confirmed by comparison with licence templates.

A multinomial logistic regression over sparse word n-grams (one to three words) tells licence families from ordinary
paragraphs and from licences of no family here (class "unknown"). It is trained here: positives are the paragraphs of
the templates, windows of them as wrapped text has them, and rendered statements; ordinary paragraphs are a bounded
sample of the corpus. A temperature fitted on held-out rows calibrates the scores. The bar `sure` is calibrated too: the
least probability at which few statements of licences that training never saw pass for a known family.

A prediction stands when the paragraph agrees with the family's templates: it holds one of the family's names, or
half of its word pairs are the templates' word pairs. Otherwise the family is "unknown".

Every paragraph is scored. A paragraph's words bound how far any label can rise above "none", as each n-gram's weight is put
on one of its words; where the bound is under what the bias gives "none", the paragraph is "none" and its n-grams needn't be
formed. So scoring is one pass of built-in functions, without a shuffle.
"""

from __future__ import annotations

import itertools
import json
import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walkspark.llm.common import let, stored, words_of

#: Names by which licence families go.
FAMILIES = {
    "apache": ["apache license", "apache license version 2.0", "apache license 2.0", "apache software license", "apache-2.0 license", "apache-2.0"],
    "bsd": ["bsd license", "bsd 3-clause license", "bsd 2-clause license", "new bsd license", "simplified bsd license", "bsd-3-clause", "bsd-2-clause"],
    "cc-by": ["cc by 4.0", "cc by 3.0", "cc-by-4.0", "creative commons attribution license", "creative commons attribution 4.0 international license", "creative commons attribution 4.0"],
    "cc-by-nc": ["cc by-nc 4.0", "cc by-nc 3.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial license", "creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["cc by-sa 4.0", "cc by-sa 3.0", "cc-by-sa-4.0", "creative commons attribution-sharealike license", "creative commons attribution-sharealike 4.0 international license"],
    "cc0": ["cc0 1.0", "cc0 1.0 universal", "cc0-1.0", "cc0 public domain dedication"],
    "gpl": ["gnu general public license", "gnu general public license version 3", "gnu general public license version 2", "gnu gpl", "gpl version 3", "gpl v2", "gpl v3", "gplv3", "gpl-3.0", "gpl-2.0"],
    "isc": ["isc license"],
    "lgpl": ["gnu lesser general public license", "gnu lgpl", "lgpl version 2.1", "lgpl-2.1", "gnu lesser general public license version 3"],
    "mit": ["mit license", "mit licence", "expat license", "mit open source license"],
    "mpl": ["mozilla public license", "mozilla public license version 2.0", "mpl 2.0", "mpl-2.0"],
}
#: Licences of no family, to learn the class "unknown" from, and others that only calibrate the bar.
OTHERS = ["zlib license", "boost software license 1.0", "eclipse public license 2.0", "artistic license 2.0", "european union public license", "academic free license", "microsoft public license", "proprietary license", "commercial license", "site license"]
UNSEEN = ["python software foundation license", "common development and distribution license", "sil open font license 1.1", "open data commons license", "end user license", "custom source license", "vendor license 3.1", "research license"]
STATEMENTS = [
    "this work is licensed under the {}", "licensed under the {}", "licensed under {}", "released under the {}", "released under {}", "distributed under the terms of the {}", "this software is available under the {}",
    "this program is free software under the {}", "use of this source code is governed by the {}", "permission is granted under the {}", "see the {} for details", "the content is available under {}", "{}", "license: {}",
]
#: Paragraphs of the licences' own texts and of the notices that they ask for.
TEMPLATES = {
    "apache": [
        "you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.",
        "subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, sublicense, and distribute the work and such derivative works in source or object form.",
    ],
    "bsd": [
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ],
    "cc-by": ["you are free to share, copy and redistribute the material in any medium or format, and adapt, remix, transform, and build upon the material for any purpose, even commercially, under the creative commons attribution terms"],
    "cc-by-nc": ["you may not use the material for commercial purposes under the creative commons attribution-noncommercial terms"],
    "cc-by-sa": ["if you remix, transform, or build upon the material, you must distribute your contributions under the same creative commons attribution-sharealike license as the original"],
    "cc0": ["to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "gpl": [
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        "you should have received a copy of the gnu general public license along with this program. if not, see <https://www.gnu.org/licenses/>.",
        "the gnu general public license is a free, copyleft license for software and other kinds of works.",
    ],
    "isc": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version.",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ],
    "mit": [
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
        "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/."],
}
UNKNOWN, NONE = "unknown", "none"
MARKS = ",;:()\"'<>"
WINDOW = 12


def plain(text: Column) -> Column:
    """Lower-case text without the punctuation around words."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, ""), r"\.+(?=\s|$)", "")


def plain_words(text: str) -> list[str]:
    """The words of plain(text)."""
    low = text.lower().translate(str.maketrans("", "", MARKS))
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"\.+(?=\s|\Z)", "", low, flags=re.A))


def ngrams(words: Column, n: int = 3) -> Column:
    """Distinct word n-grams of one to n words."""
    return F.array_distinct(F.concat(*[_grams(words, k) for k in range(1, n + 1)]))


def _grams(words: Column, k: int) -> Column:
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))


def _said(names: list[str], statements: list[str]) -> list[str]:
    return [s.format(name) for name, s in itertools.product(names, statements)]


def _windows(paragraph: str) -> list[str]:
    """The paragraph, and its runs of WINDOW words as lines of wrapped text have them."""
    w = paragraph.split()
    return [paragraph, *[" ".join(w[i : i + WINDOW]) for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]]


def positives() -> list[tuple[str, bool, str]]:
    """(label, held_out, paragraph) of licences; every fifth row only calibrates."""
    rows = [(f, s) for f in FAMILIES for s in [*_said(FAMILIES[f], STATEMENTS), *[x for p in TEMPLATES[f] for x in _windows(p)]]]
    rows += [(UNKNOWN, s) for s in _said(OTHERS, STATEMENTS)]
    return [(label, k % 5 == 0, s) for k, (label, s) in enumerate(rows)]


def margin(model: dict) -> float:
    """How far the bias alone puts "none" above all other labels."""
    none = model["labels"].index(NONE)
    return model["bias"][none] - max(b for c, b in enumerate(model["bias"]) if c != none)


def bounds(model: dict) -> dict[str, float]:
    """For words of the model's n-grams a bound: no label gains more on "none" than the sum over a paragraph's distinct words.

    What an n-gram gives a label over "none" at most is put on the word of it that gives most by itself: such words are rare elsewhere.
    """
    none = model["labels"].index(NONE)
    gains = {g: max(x - w[none] for c, x in enumerate(w) if c != none) for g, w in model["weights"].items()}
    out: dict[str, float] = {}
    for g, gain in gains.items():
        if gain > 0:
            word = max(g.split(" "), key=lambda w: (gains.get(w, 0.0), w))
            out[word] = out.get(word, 0.0) + gain
    return out


def train(spark: SparkSession, documents: DataFrame, text: str = "text", sample: int = 1000, paragraphs: int = 10_000, max_features: int = 2048, iterations: int = 40, mistaken: float = 0.05) -> dict:
    """labels, bias, weights by n-gram (one value a label), temperature, sure, cues (words without which no paragraph is above "none").

    documents: ordinary paragraphs are the `paragraphs` of smallest hash among those of the `sample` documents of smallest
    hash (bounds on labelled rows); those with the word licen[cs]e or a family's name stay out. max_features: n-grams of the
    model, the commonest in training. mistaken: the share of statements of unseen licences that may pass for a family.
    Null and empty texts give no paragraphs; repeated rows count once; ties are settled by the text; an empty table gives a
    model of licences alone.
    """
    labels = [*sorted(FAMILIES), UNKNOWN, NONE]
    said = positives()
    hashed = documents.select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    # hashes are even, so those below this bound belong to about four times the sample, whatever the number of documents
    share = min(1.0, 4 * sample / max(1, documents.count()))
    low = hashed.filter(F.col("t").isNotNull() & (F.col("h") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True)))
    some = low.distinct().orderBy("h", "t").limit(sample)
    named = "|".join(re.escape(n) for names in FAMILIES.values() for n in names)
    lines = some.select(F.explode(F.split("t", "\n")).alias("paragraph")).filter(F.col("paragraph").rlike(r"[^\x20\x09-\x0D]") & ~F.lower("paragraph").rlike(f"licen[cs]e|{named}"))
    ordinary = stored(lines.distinct().orderBy(F.xxhash64("paragraph"), "paragraph").limit(paragraphs), "licence-ordinary")
    negatives = ordinary.select(F.lit(NONE).alias("label"), (F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0).alias("held_out"), "paragraph")
    grams = let(words_of(plain(F.col("paragraph"))), lambda w: ngrams(w)).alias("grams")
    rows = spark.createDataFrame(said, "label string, held_out boolean, paragraph string").union(negatives)
    rows = stored(rows.select("label", "held_out", grams).filter(F.size("grams") > 0), "licence-rows")
    counted = rows.filter("not held_out").select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.count_if(F.col("label") != NONE).alias("licences"))
    vocabulary = [r["gram"] for r in counted.filter("n >= 3 and licences > 0").orderBy(F.desc("licences"), "gram").limit(max_features).collect()]
    model = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(spark.createDataFrame([(vocabulary,)], "grams array<string>"))
    known = model.vocabulary
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    data = model.transform(rows).select(number.cast("double").alias("label"), "features", "held_out").coalesce(2)
    sizes = {r["label"]: r["n"] for r in data.filter("not held_out").groupBy("label").agg(F.count("*").alias("n")).collect()}
    balance = F.coalesce(*[F.when(F.col("label") == c, 100.0 / n) for c, n in sizes.items()], F.lit(1.0))  # classes count alike
    data = data.withColumn("weight", balance).persist()
    lr = LogisticRegression(family="multinomial", maxIter=iterations, regParam=0.0005, elasticNetParam=0.2, standardization=False, weightCol="weight").fit(data.filter("not held_out"))
    weights, bias = lr.coefficientMatrix.toArray().tolist(), [float(x) for x in lr.interceptVector.toArray()]
    if len(bias) < len(labels):  # no ordinary paragraph in the sample: a class without evidence
        weights, bias = weights + [[0.0] * len(known)] * (len(labels) - len(bias)), bias + [0.0] * (len(labels) - len(bias))
    data.unpersist()
    made = {"labels": labels, "bias": bias, "weights": {g: [weights[c][j] for c in range(len(labels))] for j, g in enumerate(known) if any(abs(weights[c][j]) > 1e-4 for c in range(len(labels)))}, "temperature": 1.0, "sure": 0.0}
    made["cues"] = sorted(bounds(made))
    held = [(labels.index(label), logits(made, plain_words(s))) for label, out, s in said if out]
    held += [(labels.index(NONE), logits(made, plain_words(r["paragraph"]))) for r in negatives.filter("held_out").collect()]  # a fifth of `paragraphs`
    made["temperature"] = min((0.25 * 1.25**k for k in range(16)), key=lambda t: sum(_loss(raw, y, t) for y, raw in held))
    passed = sorted((p for p, family in (probability(made, plain_words(s)) for s in _said(UNSEEN, STATEMENTS)) if family not in (UNKNOWN, NONE)), reverse=True)
    allowed = int(mistaken * len(UNSEEN) * len(STATEMENTS))
    made["sure"] = max(0.5, passed[allowed] + 1e-9 if len(passed) > allowed else 0.0)
    return made


def logits(model: dict, words: list[str]) -> list[float]:
    """The classifier's scores of one paragraph, for calibration and tests."""
    grams = {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}
    out = list(model["bias"])
    for g in grams & model["weights"].keys():
        out = [a + b for a, b in zip(out, model["weights"][g])]
    return out


def probability(model: dict, words: list[str]) -> tuple[float, str]:
    """(probability, label) of the likeliest label."""
    z = logits(model, words)
    top = max(z)
    return 1.0 / sum(math.exp((x - top) / model["temperature"]) for x in z), model["labels"][z.index(top)]


def _loss(raw: list[float], label: int, t: float) -> float:
    top = max(raw)
    return math.log(sum(math.exp((x - top) / t) for x in raw)) - (raw[label] - top) / t


def template_pairs() -> dict[str, list[str]]:
    """Word pairs of each family's templates."""
    words = {f: [plain_words(p) for p in TEMPLATES[f]] for f in FAMILIES}
    return {f: sorted({f"{a} {b}" for w in ps for a, b in zip(w, w[1:])}) for f, ps in words.items()}


def scan(documents: DataFrame, model: dict, text: str = "text", agreement: float = 0.5) -> DataFrame:
    """documents without their text, with `n_paragraphs` and `licences`: array of struct<paragraph, family, probability, confirmed>.

    A paragraph is a line with a word, numbered from 0 among the text's lines. One entry for each paragraph whose
    likeliest label isn't "none"; family is "unknown" when that is the label, when its probability is under the
    model's `sure`, or when neither a name of the family is in the paragraph nor `agreement` of its word pairs in the
    family's templates. Of equally likely labels the first counts. Null and empty texts have none; texts of any length are
    read whole; repeated rows get equal answers. Columns of those names are replaced. An empty table gives no rows.
    """
    labels, t = model["labels"], F.lit(model["temperature"])
    table = F.from_json(F.lit(json.dumps(model["weights"])), "map<string,array<double>>")
    pairs = F.from_json(F.lit(json.dumps(template_pairs())), "map<string,array<string>>")
    names = F.from_json(F.lit(json.dumps({f: [f" {' '.join(plain_words(n))} " for n in ns] for f, ns in FAMILIES.items()})), "map<string,array<string>>")
    bias = F.array(*[F.lit(b) for b in model["bias"]])
    bound_of, least = bounds(model), margin(model) - 1e-9  # sums in another order differ in their last digits
    bound = F.from_json(F.lit(json.dumps(bound_of)), "map<string,double>")
    firsts = {g.split(" ")[0] for g in model["weights"] if " " in g}

    def agrees(words, family):
        name = F.exists(F.element_at(names, family), lambda n: F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), n))
        share = let(F.array_distinct(_grams(words, 2)), lambda g: F.size(F.array_intersect(g, F.element_at(pairs, family))) / F.greatest(F.size(g), F.lit(1)))
        return F.when(family.isin(UNKNOWN, NONE), F.lit(False)).otherwise(F.coalesce(name, F.lit(False)) | F.coalesce(share >= agreement, F.lit(False)))

    def known(words):
        """The distinct n-grams that the model has weights for."""
        starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(firsts)), i)), lambda i: i.isNotNull())
        longer = lambda at: [F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])) for k in (2, 3)]
        return F.array_distinct(F.filter(let(starts, lambda at: F.concat(words, *longer(at))), lambda g: g.isin(list(model["weights"]))))

    def judged(words, index):
        found = F.aggregate(known(words), bias, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))

        def with_logits(z):
            best = F.array_max(z)
            label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(z, best).cast("int"))
            return F.struct(label.alias("label"), (1.0 / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp((x - best) / t))).alias("p"))

        def named(s):
            confirmed = agrees(words, s["label"])
            family = F.when(s["label"] == NONE, NONE).when(confirmed & (s["p"] >= model["sure"]), s["label"]).otherwise(UNKNOWN)
            return F.struct(index.alias("paragraph"), family.alias("family"), s["p"].alias("probability"), confirmed.alias("confirmed"))

        return let(let(found, with_logits), named)

    none = F.struct(F.lit(None).cast("int").alias("paragraph"), F.lit(NONE).alias("family"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("boolean").alias("confirmed"))
    open_ = lambda w: F.aggregate(F.array_distinct(F.filter(w, lambda x: x.isin(list(bound_of)))), F.lit(0.0), lambda total, x: total + F.element_at(bound, x)) >= least
    one = lambda line, i: let(words_of(plain(line)), lambda w: F.when((F.size(w) > 0) & open_(w), judged(w, i)).otherwise(none))
    found = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), one), lambda x: x["family"] != NONE)
    lines = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*"))
    return documents.withColumns({"n_paragraphs": lines, "licences": found}).drop(text)
