"""Licence notices in paragraphs: a sparse n-gram logistic regression, calibrated, with templates confirming it.

Lines are taken in overlapping windows, and so is the whole text regardless of newlines, as notices are often wrapped and
stand behind comment marks. The classifier is multinomial logistic regression on
the presence of word 1-, 2- and 3-grams, fitted on notices made from the families' templates and on a bounded sample of
paragraphs of the corpus as the unknown class. A temperature fitted on examples held back calibrates its probabilities;
what is unknown or not sure enough is no notice. A predicted family stands only if one of its templates is found in the
window; places of one family that overlap or touch are one notice.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.llm.common import text_only
from tianguis.llm.ragged import PLAIN, Powers, Words, steps

# Customary wordings of the notices, one list per family.
TEMPLATES = {
    "agpl": (
        "licensed under the GNU Affero General Public License version 3",
        "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD License",
        "Use of this source code is governed by a BSD-style license",
    ),
    "cc": (
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-SA 4.0",
        "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "released under the Creative Commons Zero license",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL version 2",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
}
FAMILIES = tuple(sorted(TEMPLATES))
UNKNOWN = len(FAMILIES)

#: Words of a paragraph's window, and between the beginnings of two windows.
WINDOW, STEP = 48, 24
NGRAMS = 3
#: Texts of the sample (those with the smallest hashes), windows of each, and notices made per family.
SAMPLE_TEXTS, SAMPLE_WINDOWS, PER_FAMILY = 400, 8, 160
EPOCHS, RATE, DECAY = 120, 0.3, 1e-4
#: Calibrated probability from which a family is reported, and the share of a template's word pairs that confirms it.
SURE, CONFIRMED = 0.6, 0.75
SEED = 5

#: Lower case, punctuation as spaces, every digit as 0: versions of one licence look alike.
_FOLD = PLAIN.copy()
_FOLD[48:58] = 48
_SLOTS = 1 << 20
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def _grams(words: Words) -> list[np.ndarray]:
    """Hashes of the n-grams that begin at each word, for n = 1 to NGRAMS (ends run over into what follows)."""
    out, h = [], words.hash
    for n in range(NGRAMS):
        if n:
            later = np.zeros_like(h)
            later[: len(h) - n] = words.hash[n:]
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ later
        out.append(h ^ np.uint64(n + 1))
    return out


class Windows:
    """Windows of the lines of some texts, or of the whole texts, each as a range of words."""

    def __init__(self, texts: list[bytes], powers: Powers, lines: bool = True):
        self.words = Words(texts, _FOLD, powers)
        if lines:
            breaks = np.flatnonzero(np.frombuffer(b"\n".join(texts), dtype=np.uint8) == 10) if texts else np.empty(0, dtype=np.int64)
        else:
            breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        self.line = np.searchsorted(breaks, self.words.starts)
        first = np.flatnonzero(np.append(True, self.line[1:] != self.line[:-1])) if len(self.line) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(first, len(self.line)))
        n = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)
        base = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(base, n)
        self.begin = np.repeat(first, n) + k * STEP
        self.end = np.minimum(self.begin + WINDOW, np.repeat(first + size, n))
        self._first, self._size, self._n, self._base = first, size, n, base

    def hits(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, feature) of all known n-grams that lie within a window; ``known``: sorted hashes."""
        slot = np.zeros(_SLOTS, dtype=bool)
        slot[(known & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        windows, features = [], []
        row = np.repeat(np.arange(len(self._first)), self._size)
        for n, h in enumerate(_grams(self.words), start=1):
            at = np.flatnonzero(slot[(h & np.uint64(_SLOTS - 1)).astype(np.int64)])
            if not len(at) or not len(known):
                continue
            index = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            right = known[index] == h[at]
            at, index = at[right], index[right]
            line = row[at]
            place = at - self._first[line]
            for back in range(-(-WINDOW // STEP)):
                w = np.minimum(place // STEP, self._n[line] - 1) - back
                inside = (w >= 0) & (place >= w * STEP) & (place + n <= np.minimum(w * STEP + WINDOW, self._size[line]))
                windows.append((self._base[line] + w)[inside])
                features.append(index[inside])
        if not windows:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        pair = np.unique(np.concatenate(windows) * (len(known) + 1) + np.concatenate(features))
        return pair // (len(known) + 1), pair % (len(known) + 1)


def _pairs(text: bytes) -> list[bytes]:
    words = bytes(_FOLD[np.frombuffer(text, dtype=np.uint8)]).split()
    return [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


_TEMPLATE_PAIRS = {f: [set(_pairs(t.encode())) for t in TEMPLATES[f]] for f in FAMILIES}


def likeness(text: bytes, family: str) -> float:
    """The largest share of a template's word pairs that the text holds."""
    there = set(_pairs(text))
    return max(len(t & there) / len(t) for t in _TEMPLATE_PAIRS[family])


def _tightest(pairs: list[bytes], wanted: set[bytes]) -> tuple[int, int]:
    """The shortest range of ``pairs`` that holds all of ``wanted``, which are all there; the first one of equals."""
    seen: dict[bytes, int] = {}
    best = (0, len(pairs))
    for i, p in enumerate(pairs):
        if p in wanted:
            seen.pop(p, None)
            seen[p] = i
            if len(seen) == len(wanted) and i + 1 - (first := next(iter(seen.values()))) < best[1] - best[0]:
                best = (first, i + 1)
    return best


def places(text: bytes, family: str) -> list[tuple[int, int, float]]:
    """Begin, end and likeness of every place in ``text`` where a template of the family is confirmed."""
    words = list(_WORD.finditer(_FOLD[np.frombuffer(text, dtype=np.uint8)].tobytes()))
    pairs = [a.group() + b" " + b.group() for a, b in zip(words, words[1:], strict=False)]
    out, parts = [], [(0, len(pairs))]
    while parts:
        low, high = parts.pop()
        there = set(pairs[low:high])
        alike, template = max(((len(t & there) / len(t), i) for i, t in enumerate(_TEMPLATE_PAIRS[family])), key=lambda x: (x[0], -x[1]))
        if alike >= CONFIRMED:
            a, b = _tightest(pairs[low:high], _TEMPLATE_PAIRS[family][template] & there)
            out.append((words[low + a].start(), words[low + b].end(), alike))
            parts += [(low, low + a), (low + b, high)]
    return out


@dataclass
class Classifier:
    known: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, windows: Windows) -> np.ndarray:
        w, f = windows.hits(self.known)
        out = np.tile(self.bias, (len(windows.begin), 1))
        np.add.at(out, w, self.weights[f])
        return out

    def probabilities(self, windows: Windows) -> np.ndarray:
        z = self.logits(windows) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _notices(fillers: list[bytes], rng: random.Random) -> tuple[list[bytes], list[int]]:
    """Notices made from the templates: words left out or cut off, and words of the corpus around them."""
    texts, labels = [], []
    pool = b" ".join(fillers).split() or [b"work"]
    for label, family in enumerate(FAMILIES):
        for _ in range(PER_FAMILY):
            words = rng.choice(TEMPLATES[family]).encode().split()
            words = [w for w in words if rng.random() > 0.04] or words
            around = [rng.choice(pool) for _ in range(rng.choice([0, 0, 2, 6, 16]))]
            cut = rng.randrange(len(around) + 1)
            texts.append(b" ".join([*around[:cut], *words, *around[cut:]]))
            labels.append(label)
    return texts, labels


def fit(sample: list[bytes]) -> Classifier:
    """Fit on notices made from the templates and on sampled paragraphs, in which no template is found, as unknown."""
    rng = random.Random(SEED)
    others = sorted({s for s in sample if s and max(likeness(s, f) for f in FAMILIES) < 0.5})
    texts, labels = _notices(others, rng)
    texts, labels = texts + others, labels + [UNKNOWN] * len(others)
    order = list(range(len(texts)))
    rng.shuffle(order)
    windows = Windows([b" ".join(texts[i].split()[:WINDOW]) for i in order], Powers())
    # a window per example that has words; an example of punctuation may give several, which count alike
    example = np.searchsorted(windows.words.ends_of, windows.begin, side="right")
    y = np.array([labels[i] for i in order])[example]
    grams = np.concatenate(_grams(windows.words))
    known, seen = np.unique(grams, return_counts=True)
    known = known[seen >= 3]
    w, f = windows.hits(known)
    n = len(windows.begin)
    held = np.arange(n) % 5 == 0
    model = Classifier(known, np.zeros((len(known), UNKNOWN + 1)), np.zeros(UNKNOWN + 1))
    train = ~held[w]
    tw, tf = w[train], f[train]
    target = np.zeros((n, UNKNOWN + 1))
    target[np.arange(n), y] = 1
    mean = 1 / max(1, int((~held).sum()))
    squares = np.full_like(model.weights, 1e-6)
    for _ in range(EPOCHS):
        z = np.tile(model.bias, (n, 1))
        np.add.at(z, tw, model.weights[tf])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - target) * mean
        d[held] = 0
        g = np.stack([np.bincount(tf, weights=d[tw, c], minlength=len(known)) for c in range(UNKNOWN + 1)], axis=1) + DECAY * model.weights
        squares += g * g
        model.weights -= RATE * g / np.sqrt(squares)
        model.bias -= RATE * d.sum(axis=0)
    z = model.logits(windows)[held]
    truth = y[held]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    model.temperature = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0), key=loss) if len(truth) else 1.0
    return model


def sampled(documents: DataFrame) -> list[bytes]:
    """Windows of lines of the texts with the smallest hashes: at most SAMPLE_TEXTS * SAMPLE_WINDOWS.

    The hashes alone are ranked, so a task sends numbers; then the few texts up to the last of them are read. Copies of
    a text share its hash and give one row.
    """
    lines = F.transform(F.slice(F.split("text", "\n"), 1, SAMPLE_WINDOWS), lambda x: F.substring(x, 1, 16 * WINDOW))
    some = text_only(documents).where("text is not null").withColumn("h", F.xxhash64("text"))
    last = some.select("h").orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).first()[0]
    if last is None:
        return []
    rows = some.where(F.col("h") <= last).groupBy("h").agg(F.min(lines).alias("lines")).orderBy("h").collect()
    return [x for r in rows for x in _apart([b" ".join(x.encode().split()[:WINDOW]) for x in r["lines"]])]


def _apart(lines: list[bytes]) -> list[bytes]:
    """The lines that are no part of a notice wrapped over them and their neighbours."""
    out = []
    for i, line in enumerate(lines):
        near = [x for x in (b" ".join(lines[max(0, i - 2) : i + 1]), b" ".join(lines[i : i + 3]), b" ".join(lines[max(0, i - 1) : i + 2])) if x != line]
        rest = [b" ".join(lines[max(0, i - 2) : i]), b" ".join(lines[i + 1 : i + 3])]
        if not any((n := max(likeness(x, f) for x in near)) >= 0.5 and n > max(likeness(x, f) for x in rest) for f in FAMILIES if near):
            out.append(line)
    return out


_NOTICE = "array<struct<family:string,start:int,end:int,probability:double,likeness:double>>"
_NOTICE_TYPE = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("likeness", pa.float64())]))


_TEMPLATE_HASHES = {f: [np.unique(_grams(Words([t.encode()], _FOLD, Powers()))[1][:-1]) for t in TEMPLATES[f]] for f in FAMILIES}
_ALL_HASHES = np.unique(np.concatenate([t for f in FAMILIES for t in _TEMPLATE_HASHES[f]]))


def _held(windows: Windows) -> list[tuple[int, str]]:
    """(window, family) of all windows that hold enough word pairs of one of the family's templates."""
    w, f = windows.hits(_ALL_HASHES)
    n, out = len(windows.begin), []
    for family in FAMILIES:
        enough = np.zeros(n, dtype=bool)
        for t in _TEMPLATE_HASHES[family]:
            enough |= np.bincount(w[np.isin(f, np.searchsorted(_ALL_HASHES, t))], minlength=n) >= CONFIRMED * len(t)
        out += [(int(x), family) for x in np.flatnonzero(enough)]
    return out


def _closest(cuts: set[tuple[int, str, int, int, float]]) -> list[tuple[int, str, int, int, float]]:
    """(text, family, begin, end, likeness): of places of several families that overlap, those closest to a template."""
    runs: list[list] = []
    reach = (-1, -1)
    for cut in sorted(cuts, key=lambda c: (c[0], c[2], c[3], c[1])):
        if (cut[0], cut[2]) >= reach:
            runs.append([])
        runs[-1].append(cut)
        reach = max(reach, (cut[0], cut[3]))
    out = []
    for run in runs:
        kept: list = []
        for cut in sorted(run, key=lambda c: (-c[4], c[2] - c[3], c)):
            if not any(k[1] != cut[1] and k[2] < cut[3] and cut[2] < k[3] for k in kept):
                kept.append(cut)
        out += kept
    return sorted(out)


def _notices_of(data: list[bytes], model: Classifier, powers: Powers) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in data]
    offsets = np.cumsum([0, *(len(t) + 1 for t in data)])
    found: dict[tuple[int, str], dict[tuple, tuple]] = {}

    def place(windows: Windows, w: int) -> tuple[int, int, int]:
        a, b = int(windows.words.starts[windows.begin[w]]), int(windows.words.ends[windows.end[w] - 1])
        t = int(np.searchsorted(offsets, a, side="right")) - 1
        return t, a - int(offsets[t]), b - int(offsets[t])

    def add(t: int, family: str, key: tuple[int, int], what: tuple) -> None:
        held = found.setdefault((t, family), {})
        held[key] = max(held.get(key, (False,)), what)

    windows = Windows(data, powers)
    if not len(windows.begin):
        return out
    p = model.probabilities(windows)
    alone = np.bincount(windows.line[windows.begin])[windows.line[windows.begin]] == 1
    for w in np.flatnonzero((p.argmax(axis=1) != UNKNOWN) & (p.max(axis=1) >= SURE)):
        t, a, b = place(windows, w)
        family = FAMILIES[int(p[w].argmax())]
        at = places(data[t][a:b], family)
        for start, end, alike in at:
            # a notice that is the only one of a short line is shown with the line
            whole = bool(alone[w]) and len(at) == 1
            add(t, family, (a + start, a + end), (whole, float(p[w].max()), alike, *((a, b) if whole else (a + start, a + end))))
    # regardless of newlines: where the words of a template are, they alone are judged
    across = Windows(data, powers, lines=False)
    cuts = set()
    for w, family in _held(across):
        t, a, b = place(across, w)
        cuts |= {(t, family, a + start, a + end, alike) for start, end, alike in places(data[t][a:b], family)}
    cuts = _closest(cuts)
    # words alone, so that each is one window
    judged = model.probabilities(Windows([b" ".join(data[t][a:b].split()) for t, _, a, b, _ in cuts], powers, lines=False)) if cuts else []
    for (t, family, a, b, alike), q in zip(cuts, judged, strict=True):
        if q.argmax() == FAMILIES.index(family) and q.max() >= SURE:
            add(t, family, (a, b), (False, float(q.max()), alike, a, b))
    for (t, family), held in found.items():
        run: list[tuple[int, int, tuple]] = []
        for (a, b), what in sorted(held.items()):
            if run and a <= run[-1][1]:
                run[-1] = (run[-1][0], max(b, run[-1][1]), max(what, run[-1][2]))
            else:
                run.append((a, b, what))
        for a, b, (whole, probability, alike, *place) in run:
            a, b = place if whole else (a, b)
            start = len(data[t][:a].decode(errors="ignore"))
            end = start + len(data[t][a:b].decode(errors="ignore"))
            out[t].append({"family": family, "start": start, "end": end, "probability": probability, "likeness": alike})
    return [sorted(x, key=lambda n: (n["start"], n["family"])) for x in out]


def notices(documents: DataFrame) -> DataFrame:
    """(doc_id, notices) for every row: family, place in code points, calibrated probability, likeness to the template.

    Every line of the whole text is looked at, and the text regardless of its lines; a notice of a short line has the line as
    its place, any other one the words that confirm it. Null and empty texts hold none; without any sampled paragraph the unknown
    class is left with its prior alone. Repeated rows stay repeated rows, a null doc_id is carried along, other columns play
    no part, an empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(sampled(documents)))

    def run(batches):
        powers = Powers()
        for batch in batches:
            data = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            out: list[list[dict]] = []
            for a, b in steps([len(t) for t in data]):
                out += _notices_of(data[a:b], model.value, powers)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _NOTICE_TYPE)], names=["doc_id", "notices"])

    docs = text_only(documents, F.col("doc_id").cast("long").alias("doc_id"))
    return docs.mapInArrow(run, f"doc_id long, notices {_NOTICE}")


def summary(documents: DataFrame) -> DataFrame:
    """(doc_id, n_notices, families, places): families in order, without repeats; places as family:start:end."""
    places = F.transform("notices", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string")))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"])))
    return notices(documents).select("doc_id", F.size("notices").alias("n_notices"), F.array_join(families, ",").alias("families"), F.array_join(places, ",").alias("places"))
