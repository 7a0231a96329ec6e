"""Licence scans: a trained paragraph classifier whose predictions are confirmed by template comparison.

A paragraph is a block of adjacent lines, so a notice that is wrapped over lines is one paragraph; comment marks at the
beginning of its lines don't count. Blocks of more than WINDOW words are read in windows that overlap by half. Features
are the presence of word 1- to 3-grams that occur in the licence templates and hold a telling word (not a function word),
so a window without telling words is background at once. A softmax regression over the licence families, an unknown
licence and background is trained on variations of the templates (whole, wrapped, cut to their beginning or end, with
words lost and words of other paragraphs around them) and on a bounded sample of the corpus's own paragraphs. Its
probabilities are calibrated by a temperature fitted on a fold of other variations, and of frames and paragraphs that the
weights haven't seen. A predicted family is confirmed if a template of it is there: CONFIRMED of its word 3-grams, or of the paragraph's own
3-grams where it is a piece of a template of at least LEAST_PIECE of them. What isn't confirmed, or not sure enough,
counts as `unknown`. Tags that name a licence by its identifier are read as templates of their own.

Defined results: a null or empty text has no paragraph and no licence; very long texts and lines are read whole, window
by window; of families of equal probability the one listed first is predicted, of templates confirmed alike the last in
order; a paragraph has the families of all its windows, each once; repeated rows get a result each; null ids are kept, ids
are cast to long; an empty table gives an empty result (the classifier then trains on templates alone); other columns are
ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import ready, table, text_or_empty

# Notices by which the licences are known.
TEMPLATES = {
    "agpl": (
        "licensed under the agpl",
        "spdx license identifier agpl 3.0",
        "this work is licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    "apache-2.0": (
        "released under the apache license",
        "spdx license identifier apache 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
    ),
    "bsd": (
        "spdx license identifier bsd 3 clause",
        "spdx license identifier bsd 2 clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ),
    "cc-by": (
        "spdx license identifier cc by 4.0",
        "available under the creative commons attribution 4.0 license",
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ),
    "cc-by-nc": (
        "spdx license identifier cc by nc 4.0",
        "available under the creative commons attribution noncommercial 4.0 license",
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    ),
    "cc-by-sa": (
        "spdx license identifier cc by sa 4.0",
        "available under the creative commons attribution sharealike 4.0 license",
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    ),
    "cc0": (
        "spdx license identifier cc0 1.0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "dedicated to the public domain under cc0 1.0",
    ),
    "gpl": (
        "spdx license identifier gpl 3.0",
        "spdx license identifier gpl 2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "isc": (
        "released under the isc license",
        "spdx license identifier isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "lgpl": (
        "spdx license identifier lgpl 3.0",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "this library is licensed under the gnu lesser general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    "mit": (
        "spdx license identifier mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    ),
    "mpl-2.0": (
        "spdx license identifier mpl 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0",
    ),
    "proprietary": (
        "all rights reserved",
        "all rights reserved no part of this publication may be reproduced without prior written permission",
        "this document is proprietary and confidential unauthorized copying is strictly prohibited",
    ),
}
# Function words, which tell no licence.
FUNCTION_WORDS = frozenset(
    "a all an and any are as at be but by do either even for from has have if in is it its may more no not of on one or other part person persons provided related see should so that the these this to under unless use used was whom will with without work you your".split()
)
UNKNOWN, BACKGROUND = "unknown", "none"
#: Bounds of the training data: variations of a template, paragraphs of the corpus and the documents they come from.
VARIATIONS, MOST_PARAGRAPHS, MOST_DOCUMENTS = 60, 4000, 400
#: Words of a window; windows of a block overlap by half.
WINDOW = 120
#: Share of 3-grams that confirms a family, of its template's or, of a piece of so many 3-grams at least, of the piece's;
#: least calibrated probability of a family.
CONFIRMED, LEAST_PIECE, LEAST_PROBABILITY = 0.6, 6, 0.5
#: Share of a template's 3-grams that shows a family beside the predicted one.
ALSO = 0.9
STEPS, RATE, RIDGE = 300, 0.5, 1e-3
_words = re.compile(r"[^\W_]+(?:\.[0-9]+)*").findall


def words(paragraph: str) -> list[str]:
    return _words(paragraph.lower())


def grams(ws: list[str], n: int) -> set[str]:
    return {" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)}


@dataclass
class Model:
    classes: list[str]
    features: dict[str, int]
    telling: frozenset[str]
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float

    def probabilities(self, ws: list[str]) -> np.ndarray:
        found = [i for n in (1, 2, 3) for g in grams(ws, n) if (i := self.features.get(g)) is not None]
        z = (self.bias + self.weights[found].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, paragraph: str) -> tuple[str, float, str] | None:
        """(family or unknown, calibrated probability, confirming template), or None for background: the first family."""
        return next(iter(self._found(paragraph)), None)

    def all(self, paragraph: str) -> list[tuple[str, float, str]]:
        """What is found in the windows of a paragraph, each family once, by name; unknown only if no family is."""
        return sorted(self._found(paragraph))

    def _found(self, paragraph: str) -> list[tuple[str, float, str]]:
        ws = words(paragraph)
        if self.telling.isdisjoint(ws):
            return []
        best: dict[str, tuple[str, float, str]] = {}
        for a in range(0, max(1, len(ws) - WINDOW // 2), WINDOW // 2):
            for found in self._window(ws[a : a + WINDOW]):
                if found[0] not in best or found[1] > best[found[0]][1]:
                    best[found[0]] = found
        if len(best) > 1:
            best.pop(UNKNOWN, None)
        return list(best.values())

    def _window(self, ws: list[str]) -> list[tuple[str, float, str]]:
        if self.telling.isdisjoint(ws):
            return []
        p = self.probabilities(ws)
        licence = float(1 - p[self.classes.index(BACKGROUND)])
        best = int(p.argmax())
        name = self.classes[best]
        if name in TEMPLATES and p[best] >= LEAST_PROBABILITY and (text := confirm(ws, name)) is not None:
            # others that the window names whole beside it, with the probability that it names any licence
            also = [(f, licence, t) for f in TEMPLATES if f != name and (t := confirm(ws, f, ALSO, False)) is not None and not grams(words(t), 3) <= grams(words(text), 3)]
            return [(name, float(p[best]), text), *also]
        return [] if name == BACKGROUND else [(UNKNOWN, licence, "")]


_template_grams: dict[str, list[tuple[str, frozenset[str]]]] = {}


def templates(family: str) -> list[tuple[str, frozenset[str]]]:
    """The family's templates with their 3-grams; those of fewer words count whole."""
    if family not in _template_grams:
        _template_grams[family] = [(t, frozenset(grams(w, min(3, len(w))))) for t in TEMPLATES[family] if (w := words(t))]
    return _template_grams[family]


def confirm(ws: list[str], family: str, least: float = CONFIRMED, pieces: bool = True) -> str | None:
    """The template of the family that is most contained in the words, or contains most of them, if enough of it is."""
    have = grams(ws, 3)
    best = (0.0, "")
    for text, t in templates(family):
        both = len(have & t)
        # a short notice must be there whole
        share = both / len(t) if len(t) > 4 or both == len(t) else 0.0
        piece = both / len(have) if pieces and len(have) >= LEAST_PIECE else 0.0
        best = max(best, (max(share, piece), text))
    return best[1] if best[0] >= least else None


FRAMES = (
    "released under the {} license", "licensed under the {} license version {}", "this work is licensed under the {} public license", "{} license terms apply copyright {}",
    "spdx license identifier {} {}", "distributed under the terms of the {} licence", "see the file license for the {} license", "you may copy and use this software under the {} agreement version {}",
)


def _variations(ws: list[str], around, rng: random.Random) -> list[str]:
    """A template as it is met: whole, or its beginning or end where it is long, with words lost and others around it."""
    if len(ws) > 16 and rng.random() < 0.5:
        n = rng.randrange(12, len(ws))
        ws = ws[:n] if rng.random() < 0.5 else ws[-n:]
    return around() + [w for w in ws if rng.random() > 0.08] + around()


def _examples(background: list[list[str]], rng: random.Random) -> tuple[list[tuple[list[str], str]], list[tuple[list[str], str]]]:
    """(for the weights, for the temperature): the second are other variations of a template of each family, and frames and
    paragraphs that the first lack."""
    filler = [w for ws in background for w in ws] or ["text"]
    around = lambda: [rng.choice(filler) for _ in range(rng.randrange(6))]
    fit: list[tuple[list[str], str]] = []
    held: list[tuple[list[str], str]] = []
    for family, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            ws = words(text)
            fit += [(_variations(ws, around, rng), family) for _ in range(VARIATIONS)]
            if i == 0:
                held += [(_variations(ws, around, rng), family) for _ in range(VARIATIONS // 4)]
    for i, frame in enumerate(FRAMES):
        for _ in range(VARIATIONS):
            name = "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(3))
            (held if i % 4 == 3 else fit).append((around() + words(frame.format(name, rng.randrange(1, 9))) + around(), UNKNOWN))
    for i, ws in enumerate(background):
        (held if i % 4 == 3 else fit).append((ws, BACKGROUND))
    for i in range(10 * VARIATIONS):  # a telling word or two among others is no licence
        tell = [rng.choice(words(rng.choice(TEMPLATES[rng.choice(list(TEMPLATES))]))) for _ in range(rng.randrange(1, 3))]
        (held if i % 4 == 3 else fit).append((around() + tell + around(), BACKGROUND))
    return fit, held


# Words that speak of licences; sampled paragraphs with them don't teach background.
LICENCE_WORDS = frozenset("license licence licensed licensing copyright copyrighted spdx redistribution redistribute copyleft reserved warranty".split())


def train(background: list[str], seed: int = 7) -> Model:
    """Softmax regression by gradient descent, then the temperature on examples of other templates and paragraphs."""
    rng = random.Random(seed)
    clean = [ws[:WINDOW] if len(ws) > WINDOW else ws for p in background if (ws := words(p)) and LICENCE_WORDS.isdisjoint(ws)]
    fit, later = _examples(clean, rng)
    rng.shuffle(fit)
    examples = fit + later
    all_grams = {g for texts in TEMPLATES.values() for t in texts for n in (1, 2, 3) for g in grams(words(t), n)}
    features = {g: i for i, g in enumerate(sorted(g for g in all_grams if not FUNCTION_WORDS.issuperset(g.split())))}
    classes = [*TEMPLATES, UNKNOWN, BACKGROUND]
    x = np.zeros((len(examples), len(features)), np.float32)
    y = np.array([classes.index(c) for _, c in examples])
    for r, (ws, _) in enumerate(examples):
        x[r, [i for n in (1, 2, 3) for g in grams(ws, n) if (i := features.get(g)) is not None]] = 1
    cut = len(fit)
    w, b = np.zeros((len(features), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    target = np.eye(len(classes), dtype=np.float32)[y]
    weight = (1 / np.bincount(y[:cut], minlength=len(classes)).clip(1))[y[:cut]]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(STEPS):
        error = (softmax(x[:cut] @ w + b) - target[:cut]) * weight
        w -= RATE * 20 * (x[:cut].T @ error + RIDGE * w)
        b -= RATE * 20 * error.sum(axis=0)
    held = x[cut:] @ w + b
    loss = lambda t: -np.log(softmax(held / t)[np.arange(len(held)), y[cut:]].clip(1e-12)).mean()
    temperature = min((0.25 * 1.1**i for i in range(40)), key=loss)
    telling = frozenset(w_ for g in features for w_ in g.split() if w_ not in FUNCTION_WORDS)
    return Model(classes, features, telling, w.astype(np.float64), b.astype(np.float64), float(temperature))


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of the blocks of adjacent lines that aren't blank, without comment marks."""
    at, start, lines = 0, 0, []
    for line in [*text.split("\n"), ""]:
        bare = line.strip(_MARKS)
        if bare:
            if not lines:
                start = at
            lines.append(bare)
            end = at + len(line)
        elif lines:
            yield start, end, " ".join(lines)
            lines = []
        at += len(line) + 1


_MARKS = " \t\r\f\v/*#;%<>!-|"


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [p for t in batch.column("t").to_pylist() for _, _, p in blocks(t)]
        # a window anywhere in the paragraph, chosen by the hash of its words, stands for it
        out = []
        for p in found:
            ws = words(p)
            a = zlib.crc32(p.encode("utf-8", "surrogatepass")) % max(1, len(ws) - WINDOW + 1)
            out.append(" ".join(ws[a : a + WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["p"])


def background(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """A bounded sample of the corpus's paragraphs: windows of those of least hash in the documents of least hash."""
    ready(docs.sparkSession)
    hashed = docs.select(F.xxhash64(id_col).alias("h"), text_or_empty(text_col).alias("t"))
    # the least hashes are found without texts; as few rows may be broadcast
    least = hashed.select("h").distinct().orderBy("h").limit(MOST_DOCUMENTS)
    chosen = hashed.join(F.broadcast(least), "h", "left_semi").select("t")
    rows = chosen.mapInArrow(_paragraphs, "p string").where("p <> ''").orderBy(F.xxhash64("p"), "p").limit(MOST_PARAGRAPHS)
    return [r["p"] for r in rows.collect()]  # at most MOST_PARAGRAPHS rows of WINDOW words


_OUT = "doc_id long, n_paragraphs long, n_licenses long, families string, probability double, spans string"


def _scanner(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        telling = m.telling
        for batch in batches:
            out = []
            for doc, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                n, hits = 0, []
                lower = t.lower()
                # most texts have no telling word at all
                some = any(w in lower for w in telling)
                for start, end, block in blocks(t):
                    n += 1
                    hits += [(start, end, *found) for found in m.all(block)] if some else []
                families = ",".join(sorted({h[2] for h in hits}))
                spans = ",".join(f"{h[2]}:{h[0]}:{h[1]}:{h[3]:.3f}" for h in hits)
                out.append((doc, n, len(hits), families, round(max((h[3] for h in hits), default=0.0), 6), spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _OUT.split(", ")])

    return scan


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its licence paragraphs, families, greatest probability and spans (code points)."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or train(background(docs, id_col, text_col)))  # as large as the templates
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(_scanner(shared), _OUT)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
