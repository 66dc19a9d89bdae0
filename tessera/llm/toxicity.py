"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers case, drops invisible characters, maps look-alike letters and digits inside words to the letters they
stand for, and closes up words whose letters are set apart by dots or dashes. Accents tell words apart in many
languages, so they stay, but for words that are a listed one without them. The lexicon
(whole words, and word beginnings marked ``*``) is learned from labelled rows by grouped counts: terms that stand
mostly in rejected texts, the one that explains most of them first. A term next to a neighbour with which it
stands only in accepted texts is an exception phrase and does not count. A logistic curve over the summed weights,
their density per hundred words, the number of distinct words matched and the heaviest of them gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import cut

#: Labelled rows that the fit reads, about; chosen by a hash of their id.
FIT_ROWS = 20_000
FOLDS = 5
STEMS = range(4, 9)
MIN_DOCS = 3
#: A term's log odds between rejected and accepted texts, at least.
LEAST_ODDS = 2.5
#: Terms of such odds, in such a share of the rejected texts, are listed even where others explain the same texts.
STRONG_ODDS, STRONG_SHARE = 4.0, 0.01
# Characters that stand for Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɩ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Marks that make no letter of their own with what they stand on, and characters without width.
_MARKS = re.compile("[\u0300-\u036f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_FOLD = str.maketrans({**{chr(c): None for c in range(0x10000) if _MARKS.match(chr(c))}, **LOOKALIKES})
#: Three or more single letters with dots, dashes, stars or low lines between them.
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*·][^\W_]){2,}(?![^\W_])")
_GAPS = re.compile(r"[.\-_*·]")
#: A letter between two of these, without which there is no such word.
_GAPPED = re.compile(r"[.\-_*·][^\W_][.\-_*·]")
_MIXED = re.compile(r"(?<![\w@$!])[\w@$!]*[0-9@$!][\w@$!]*")
_DIGIT = str.maketrans(DIGITS)
_EDGE = re.compile(r"\w+")
_ACCENTED = re.compile(r"(?<!\w)[A-Za-z0-9_]*+[^\W\x00-\x7f]\w*+")


def _letters(match: re.Match) -> str:
    core = match[0].rstrip("@$!")
    return core.translate(_DIGIT) + match[0][len(core) :] if any(c.isalpha() for c in core) else match[0]


def fold(text: str | None) -> str:
    """Folded text. Digits and signs turn into letters only in a run that has a letter; signs that end a run stay."""
    low = (text or "").lower()
    if not low.isascii():
        low = (low if unicodedata.is_normalized("NFKC", low) else unicodedata.normalize("NFKC", low).lower()).translate(_FOLD)
    if _GAPPED.search(low):
        low = _SPELLED.sub(lambda m: _GAPS.sub("", m[0]) if any(c.isalpha() for c in m[0]) else m[0], low)
    if any(d in low for d in DIGITS):
        low = _MIXED.sub(_letters, low)
    return low


@lru_cache(1 << 16)
def _bare(word: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", word))


@dataclass
class Model:
    """Weights by term (``stem*`` for word beginnings), exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.5, 0.5)

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in self.weights:
            found.add_word(term.rstrip("*"), term)
        found.make_automaton()
        return found

    def folded(self, text: str | None) -> str:
        """Folded text in which accented spellings of listed words are plain."""

        def plain(match: re.Match) -> str:
            bare = _bare(match[0])
            return bare if bare in self.weights else match[0]

        low = fold(text)
        return low if low.isascii() else _ACCENTED.sub(plain, low)

    def hits(self, folded: str, matcher) -> list[tuple[str, str, str]]:
        """``(term, previous word + term word, term word + next word)`` for each match at a word's edges, one per word."""
        if not self.weights:
            return []
        best: dict[int, tuple[str, int]] = {}
        for end, terms in matcher.iter(folded):
            size = len(terms.rstrip("*"))
            start = end - size + 1
            if start and (folded[start - 1].isalnum() or folded[start - 1] == "_"):
                continue
            if not terms.endswith("*") and end + 1 < len(folded) and (folded[end + 1].isalnum() or folded[end + 1] == "_"):
                continue
            if start not in best or self.weights[terms] > self.weights[best[start][0]]:
                best[start] = (terms, size)
        out = []
        for start, (term, _) in sorted(best.items()):
            word = _EDGE.match(folded, start)
            before = _EDGE.findall(folded[max(0, start - 40) : start])
            after = _EDGE.search(folded[: word.end() + 40], word.end())
            out.append((term, f"{before[-1] if before else ''} {word[0]}", f"{word[0]} {after[0] if after else ''}"))
        return out

    def features(self, text: str | None, matcher) -> tuple[float, ...]:
        folded = self.folded(text)
        kept = [(t, b.split(" ")[0]) for t, a, b in self.hits(folded, matcher) if a not in self.exceptions and b not in self.exceptions]
        total = sum(self.weights[t] for t, _ in kept)
        n = folded.count(" ") + folded.count("\n") + 1
        return math.log1p(total), math.log1p(100 * total / n), math.log1p(len({w for _, w in kept})), max((self.weights[t] for t, _ in kept), default=0.0)

    def score(self, features: tuple[float, ...]) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], features))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0. A row without an id is not one."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _words(text: str | None) -> set[str]:
    return set(_EDGE.findall(fold(text)))


def _terms(words: set[str]) -> set[str]:
    return {w for w in words if 3 <= len(w) <= 30} | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled rows outside the held-out fold, about ``fit_rows`` of them by a hash of their id.

    Ids with differing labels count as rejected if any says so. Without labels of both kinds the model has no terms.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, fit_rows / max(1, marks.count()))
    marks = cut(marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))))
    held = F.broadcast(marks) if marks.count() <= 4 * fit_rows else marks  # about fit_rows ids by the hash
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(held, "id").select("y", "t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yes, no = Counter(), Counter()
            for y, t in zip(part["y"], part["t"]):
                (yes if y else no).update(_terms(_words(t)))
            keys = yes.keys() | no.keys()
            if keys:  # an empty column of strings has no type
                yield pd.DataFrame({"term": list(keys), "yes": [yes[k] for k in keys], "no": [no[k] for k in keys]})

    counts = rows.mapInPandas(count, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    whole = marks.groupBy().agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).first()
    n_yes, n_no = whole.yes or 0, whole.no or 0
    if not n_yes or not n_no:
        return Model()
    odds = F.log((F.col("yes") + 0.5) / (n_yes + 1)) - F.log((F.col("no") + 0.5) / (n_no + 1))
    found = counts.where(F.col("yes") >= MIN_DOCS).select("term", "yes", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).collect()
    seen, support = {r.term: r.odds for r in found}, {r.term: r.yes for r in found}
    if not seen:
        return Model()
    share_terms = docs.sparkSession.sparkContext.broadcast(frozenset(seen))  # of the bounded sample

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"terms": [sorted(_terms(_words(t)) & share_terms.value) for t in part["t"]]})

    left = [set(r.terms) for r in rows.where("y = 1").mapInPandas(listed, "terms array<string>").collect()]
    weights: dict[str, float] = {}
    while left:  # the term that explains most texts is next; a word before a stem that explains no more
        cover = Counter(t for s in left for t in s)
        if not cover:
            break
        term = max(cover, key=lambda t: (cover[t] * seen[t], not t.endswith("*"), len(t), t))
        if cover[term] < MIN_DOCS:
            break
        weights[term] = round(seen[term], 6)
        left = [s for s in left if term not in s]
    spelled = Counter()  # the most texts of any one word under a stem
    for word in (t for t in support if not t.endswith("*")):
        for k in STEMS:
            spelled[word[:k] + "*"] = max(spelled[word[:k] + "*"], support[word])
    for term in sorted((t for t in seen if seen[t] >= STRONG_ODDS), key=lambda t: (not t.endswith("*"), len(t), t)):
        inside = any(t.endswith("*") and term.startswith(t[:-1]) for t in weights)
        if support[term] >= max(10, STRONG_SHARE * n_yes, 1.5 * spelled[term]) and not inside:
            weights[term] = round(seen[term], 6)
    return _curve(Model(weights), rows)


def _curve(model: Model, rows: DataFrame) -> Model:
    """Exception phrases and the logistic curve, from the matches in the sampled rows."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = model.matcher()
        for part in batches:
            contexts = [[c for h in model.hits(model.folded(t), matcher) for c in h[1:]] for t in part["t"]]
            features = [model.features(t, matcher) for t in part["t"]]
            yield pd.DataFrame({"y": part["y"], "contexts": contexts, "x": [list(f) for f in features]})

    found = rows.mapInPandas(measure, "y int, contexts array<string>, x array<double>").collect()
    yes = Counter(c for r in found if r.y for c in set(r.contexts))
    no = Counter(c for r in found if not r.y for c in set(r.contexts))
    model.exceptions = model.exceptions | {c for c, n in no.items() if n >= 2 and not yes[c]}
    x = np.array([[1.0, *r.x] for r in found])
    y = np.array([r.y for r in found], dtype=float)
    w = np.array(model.curve)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.diag([1e-4, 1e-2, 1e-2, 1e-2, 1e-2])
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    model.curve = tuple(round(float(v), 6) for v in w)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id, held_out, score, predicted, terms``. A null text counts as empty; every text gets a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        matcher = own.matcher()
        for part in batches:
            features = [own.features(t, matcher) for t in part["t"]]
            scores = [own.score(f) for f in features]
            yield pd.DataFrame({"id": part["id"], "held_out": part["h"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects, all columns as they were.

    Null and empty texts are clean unless the model says otherwise; repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        own = shared.value
        matcher = own.matcher()
        return pd.Series([own.score(own.features(t, matcher)) < 0.5 for t in texts], dtype=bool)

    return docs.where(clean(F.col(text_col).cast("string")))
