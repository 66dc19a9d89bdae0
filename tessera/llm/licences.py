"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines between blank ones, so notices may be wrapped at any column. Every line of up to
``WINDOW`` words and every overlapping window of so many words of a paragraph become sparse counts of word unigrams
and bigrams, hashed. Multinomial logistic regression is trained on perturbed templates of each family, alone and inside
running text, against windows of the corpus (the class ``unknown``), and calibrated by one temperature on held-out
ones of both kinds. A window is a notice if the calibrated probability of all families together reaches ``CONFIDENT``;
of the families with a probability of ``LIKELY`` or more it counts for the one of whose templates it holds most, at
least ``CONFIRM`` of one's word pairs (families may differ in a single word). As the model is linear, prefix sums over a text's
words score all of its windows in one pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.decontaminate import _Hasher, words
from tessera.plans.session import cut

# Notices by family, as their licences word them.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "bsd": ["Released under the BSD License.", "This software is released under the 3-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "reserved": ["All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved."],
}
UNKNOWN = "unknown"
#: Sentences of the kind that a licence scan must leave alone.
DECOYS = ("a driving license was issued last year", "all seats are reserved for members", "the public may visit the general store", "permission to land was granted free of delay", "the apache helicopter landed at version two of the field", "the software was released in march under pressure", "rights and duties of tenants", "this work is under review")
BUCKETS = 1 << 15
CONFIDENT, LIKELY, CONFIRM = 0.7, 0.04, 0.7
#: Words of a window and between the starts of two: any run of WINDOW - STEP words lies whole in some window.
WINDOW, STEP = 48, 16
#: Documents whose windows stand for the unknown class, about; chosen by a hash of their id.
FIT_ROWS = 2_000
#: Their distinct windows that are trained on, about; chosen by a hash of their words.
FIT_WINDOWS = 30_000
#: Words scored at once.
_BLOCK = 100_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def windows(text: str | None) -> tuple[list[bytes], list[tuple[int, int, int]], int]:
    """A text's words, its windows as ``(first word, end, line)``, and its number of paragraphs with words."""
    tokens, starts, numbers, found, paragraphs = [], [], [], [], 0
    first = lines = 0

    def close() -> None:
        nonlocal paragraphs
        paragraphs += len(tokens) > first
        if lines > 1 or len(tokens) - first > WINDOW:
            for at in range(first, max(first + 1, len(tokens) - WINDOW + STEP), STEP):
                found.append((at, min(at + WINDOW, len(tokens)), numbers[bisect_right(starts, at) - 1]))

    for k, raw in enumerate((text or "").split("\n")):
        line = words(raw)
        if line:
            starts.append(len(tokens))
            numbers.append(k)
            tokens += line
            lines += 1
            if len(line) <= WINDOW:
                found.append((starts[-1], len(tokens), k))
        elif not raw.strip():
            close()
            first, lines = len(tokens), 0
    close()
    return tokens, found, paragraphs


def _buckets(tokens: list[bytes], hasher: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and of the pairs that begin at each word but the last."""
    h = hasher(tokens)
    pairs = h[:-1] * _PAIR + h[1:] * np.uint64(31)
    return (h >> np.uint64(64 - 15)).astype(np.int64), (pairs >> np.uint64(64 - 15)).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, tokens: list[bytes], spans: np.ndarray, hasher: _Hasher) -> np.ndarray:
        """Class probabilities of the windows ``(first word, end)`` of a list of words, by prefix sums."""
        single, pair = (np.cumsum(np.vstack([np.zeros_like(self.bias)[None], self.weights[x]]), axis=0) for x in _buckets(tokens, hasher))
        a, b = spans[:, 0], spans[:, 1]
        z = single[b] - single[a] + pair[b - 1] - pair[a]
        return _softmax((z / np.sqrt(2 * (b - a) - 1)[:, None] + self.bias) / self.temperature)


def _pairs(line: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(line, line[1:]))


_TEMPLATE_PAIRS = {f: [_pairs(words(t)) for t in ts] for f, ts in TEMPLATES.items()}
_ALL_PAIRS = set().union(*(t for ts in _TEMPLATE_PAIRS.values() for t in ts))


def confirmed(line: list[bytes], family: str) -> float:
    """The largest share of one of the family's templates that the paragraph holds, in word pairs."""
    own = _pairs(line)
    return max(len(own & t) / len(t) for t in _TEMPLATE_PAIRS[family])


def _perturbed(rng: np.random.Generator, template: list[bytes], filler: list[bytes], room: int) -> list[bytes]:
    """A template with words lost and up to ``room`` words of running text around it."""
    kept = [w for w in template if rng.random() > 0.06] or template
    size = int(rng.integers(0, room + 1))
    at = int(rng.integers(max(1, len(filler) - size)))
    around = filler[at : at + size]
    cut_at = int(rng.integers(len(around) + 1))
    return around[:cut_at] + kept + around[cut_at:]


def _unlabelled(docs: DataFrame, id_col: str, text_col: str, fit_rows: int, fit_windows: int) -> list[list[bytes]]:
    """About ``fit_windows`` distinct windows of about ``fit_rows`` documents, but those that hold half a template."""
    share = int(min(1.0, fit_rows / max(1, docs.count())) * 1_000_000)
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share).select(F.col(text_col).cast("string").alias("t"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = set()
            for text in part["t"]:
                tokens, spans, _ = windows(text)
                for a, b, _ in spans:
                    held = _pairs(tokens[a:b]) & _ALL_PAIRS
                    if not held or all(len(held & t) < 0.5 * len(t) for ts in _TEMPLATE_PAIRS.values() for t in ts):
                        out.add(b" ".join(tokens[a:b]))
            yield pd.DataFrame({"w": list(out)})

    rows = cut(sample.mapInPandas(split, "w binary").distinct())
    keep = int(min(1.0, fit_windows / max(1, rows.count())) * 1_000_000)
    return [bytes(r.w).split() for r in rows.where(F.pmod(F.xxhash64("w"), F.lit(1_000_000)) < keep).orderBy("w").collect()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, fit_windows: int = FIT_WINDOWS, copies: int = 100, epochs: int = 12) -> Model:
    """A model from templates and a bounded sample of the corpus's windows.

    The bounds are ``fit_rows`` documents and ``fit_windows`` windows, about; what reaches the driver does not grow
    beyond them. Documents without an id may be drawn like any other; null texts have no windows.
    """
    other = _unlabelled(docs, id_col, text_col, fit_rows, fit_windows)
    rng = np.random.default_rng(7)
    rng.shuffle(other)
    filler = [w for x in other[:3000] for w in x] or [b"word"]
    other += [words(d) for d in DECOYS] * 20
    families = [*sorted(TEMPLATES), UNKNOWN]
    data = [(x, len(families) - 1) for x in other]
    for k, f in enumerate(families[:-1]):
        for t in map(words, TEMPLATES[f]):
            data += [(_perturbed(rng, t, filler, 6 if i % 2 else WINDOW - len(t)), k) for i in range(copies)]
    data = [data[i] for i in rng.permutation(len(data))]
    held = len(data) // 5
    hasher = _Hasher(1)
    weights, bias = _train(data[held:], len(families), hasher, epochs, rng)
    slots, ends = _rows([x for x, _ in data[:held]], hasher)
    z = _sums(weights, bias, slots, ends)
    y = np.array([k for _, k in data[:held]])
    cost = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    return Model(families, weights.astype(np.float32), bias, float(min(np.geomspace(0.2, 5, 60), key=cost)))


def _rows(data: list[list[bytes]], hasher: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all windows one after the other, and where each window's end."""
    parts = [np.concatenate(_buckets(x, hasher)) for x in data]
    return np.concatenate(parts), np.cumsum([len(x) for x in parts])


def _sums(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class scores by window; features are scaled to unit length, as if no count repeated."""
    starts = np.concatenate([[0], ends[:-1]])
    return np.add.reduceat(weights[slots], starts, axis=0) / np.sqrt(ends - starts)[:, None] + bias


def _train(data: list, classes: int, hasher: _Hasher, epochs: int, rng: np.random.Generator, batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad in small batches with a small ridge; classes weigh alike."""
    y = np.array([k for _, k in data])
    weigh = (len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1)))[:, None]
    buckets = [np.concatenate(_buckets(x, hasher)) for x, _ in data]
    w, b = np.zeros((BUCKETS, classes)), np.zeros(classes)
    sw, sb = np.full_like(w, 1e-6), np.full(classes, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = np.array([len(buckets[i]) for i in rows])
            used, slot = np.unique(np.concatenate([buckets[i] for i in rows]), return_inverse=True)
            g = (_softmax(_sums(w[used], b, slot, np.cumsum(sizes))) - np.eye(classes)[y[rows]]) * weigh[y[rows]] / len(rows)
            part = np.repeat(g / np.sqrt(sizes)[:, None], sizes, axis=0)
            gw = np.stack([np.bincount(slot, part[:, k], minlength=len(used)) for k in range(classes)], axis=1) + 1e-6 * w[used]
            gb = g.sum(axis=0)
            sw[used] += gw * gw
            sb += gb * gb
            w[used] -= 0.5 * gw / np.sqrt(sw[used])
            b -= 0.1 * gb / np.sqrt(sb)
    return w, b


def _apart(hits: list[tuple]) -> list[tuple]:
    """Hits ``(first word, end, line, family, probability, confirmation)`` of which no two of a family overlap."""
    kept: list[tuple] = []
    for hit in sorted(hits, key=lambda h: (-h[5], h[1] - h[0], h[0])):
        if all(hit[3] != k[3] or hit[1] <= k[0] or k[1] <= hit[0] for k in kept):
            kept.append(hit)
    return sorted(kept)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id, licence, probability, families, hits, n_paragraphs``.

    ``hits`` lists ``line:family:probability:confirmation``, the best of windows that overlap; ``families`` their
    families; ``licence`` is that of the likeliest hit, or ``unknown`` with probability 0. Null and empty texts have
    no paragraphs. Repeated rows each give a row. Other columns are left out. String ids must be numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(tokens: list[bytes], spans: list[tuple[int, int, int]], hasher: _Hasher) -> list[tuple]:
        own, out, at = shared.value, [], 0
        spans = sorted(spans)
        while at < len(spans):  # windows that begin within the next block of words
            low = spans[at][0]
            end = bisect_right(spans, low + _BLOCK, lo=at, key=lambda s: s[0])
            part = np.array([s[:2] for s in spans[at:end]]) - low
            p = own.probabilities(tokens[low : low + int(part.max())], part, hasher)
            for i in np.flatnonzero(1 - p[:, -1] >= CONFIDENT):
                a, b, line = spans[at + i]
                likely = [own.families[k] for k in np.flatnonzero(p[i, :-1] >= LIKELY)]
                sure, q, family = max(((confirmed(tokens[a:b], f), float(p[i, own.families.index(f)]), f) for f in likely), default=(0.0, 0.0, UNKNOWN))
                if sure >= CONFIRM:
                    out.append((a, b, line, family, q, sure))
            at = end
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher(1)
        for part in batches:
            out, texts = [], part["t"].tolist()
            for at in range(0, len(texts), 100):
                tokens, spans, ends, counts = [], [], [], []
                for text in texts[at : at + 100]:
                    w, s, n = windows(text)
                    spans += [(a + len(tokens), b + len(tokens), k) for a, b, k in s]
                    tokens += w
                    ends.append(len(tokens))
                    counts.append(n)
                hits: dict[int, list] = {}
                for hit in found(tokens, spans, hasher):
                    hits.setdefault(bisect_right(ends, hit[0]), []).append(hit)
                for d, n in enumerate(counts):
                    mine = _apart(hits.get(d, []))
                    top = max(mine, key=lambda h: (h[4], -h[0]), default=(0, 0, 0, UNKNOWN, 0.0, 0.0))
                    out.append((top[3], top[4], ",".join(sorted({h[3] for h in mine})), ",".join(f"{k}:{f}:{q:.4f}:{c:.4f}" for _, _, k, f, q, c in mine), n))
            rows = pd.DataFrame(out, columns=["licence", "probability", "families", "hits", "n_paragraphs"])
            rows.insert(0, "id", part["id"].to_numpy())
            yield rows

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(run, "id long, licence string, probability double, families string, hits string, n_paragraphs long").withColumnRenamed("id", id_col)
