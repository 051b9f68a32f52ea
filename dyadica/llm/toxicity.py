"""Toxicity by a weighted lexicon.

A text is folded first: lower case, compatibility forms, accents off, look-alike letters of other alphabets
to Latin, digits and signs that stand for letters inside a word ("1d10t") to those letters, ``l`` and ``i``
to one letter (a ``1`` may mean either), everything else to single spaces. An Aho-Corasick automaton then
finds the lexicon's entries, whole words (" idiot ") or stems (" idio"), in one pass whatever their number.
A hit inside an exception phrase does not count. A word counts once, by its heaviest entry. The sum of
weights, as it is and per word of the text, gives the score through a logistic curve.

The lexicon is learnt, not given. Of the labelled rows with crc32(id) mod 4 in (0, 1) each word and each stem of
``STEMS`` letters gets the log ratio of its document frequencies in both classes; significant ones stay.
Exception phrases are pairs of words with an entry that only clean documents have. The curve is fitted on
the rows with remainder 3, which the lexicon has not seen. Remainder 2 is never looked at. Both samples are
bounded by ``SAMPLE`` rows (chosen by a digest of the id) and the lexicon by ``ENTRIES``; scoring reads every
whole text.

Defined results: a null text is an empty one; texts without words get the score of no hits; labels that are
null, or of unknown documents, are ignored; without both classes in a sample nothing can be learnt and
every score is 0; repeated rows get the same score; other columns are never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_digest, table

SAMPLE = 20_000
ENTRIES = 5_000
STEMS = (4, 5, 6)
THRESHOLD = 0.3
LEAST_DOCUMENTS, LEAST_Z = 6, 3.2

_LOOKALIKES = str.maketrans(
    "абвгеёзікмнорстухѕјһԁԛԝαβεηικνορτυχω", "abbreesikmhopctyxsjhdqwabenikvoptuxw")
_FOLD = _LOOKALIKES | {c: None for c in range(0x300, 0x370)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)}
_DIGITS = str.maketrans("0134578@$!|", "oieastbasii")
_SIGNED = re.compile(r"[a-z0-9@$!|]*[0-9@$!|][a-z0-9@$!|]*")
_GAPS = re.compile(r"[\W\d_]+")


def _as_letters(found: re.Match) -> str:
    word = found.group().strip("@$!|")
    return word.translate(_DIGITS) if any("a" <= c <= "z" for c in word) else " "


def fold(text: str | None) -> str:
    """The text's words, folded, each between single spaces."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_FOLD)
    text = _GAPS.sub(" ", _SIGNED.sub(_as_letters, text)).replace("l", "i")
    return f" {text.strip()} " if text.strip() else " "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] | None = None

    def automaton(self):
        import ahocorasick
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found


def _features(folded: str, automaton) -> tuple[float, float, float]:
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
    for low, high in spared:
        for start in [s for s in hits if low <= s < high]:
            del hits[start]
    total, words = sum(hits.values()), folded.count(" ") - 1
    return math.log1p(total), math.log1p(100 * total / (max(words, 0) + 20)), math.log1p(len(hits))


def _labelled(docs: DataFrame, labels: DataFrame, remainders: tuple[int, ...], bound: int) -> DataFrame:
    """(text, toxic) of at most about ``bound`` labelled rows with these remainders of crc32(id) mod 4."""
    known = (labels.where("toxic is not null and doc_id is not null")
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).isin(*remainders)))
    share = min(1.0, bound / max(1, known.count()))
    cut = f"{min(int(share * 16 ** 8), 16 ** 8 - 1):08x}"
    sample = known.where(F.substring(id_digest(F.col("doc_id")), 1, 8) <= cut)
    # The sample is bounded by its parameter, so it is safe to broadcast and no text is shuffled.
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def _entries(words: list[str]) -> set[str]:
    found = {f" {w} " for w in words}
    for n in STEMS:
        found.update(f" {w[:n]}" for w in words if len(w) > n)
    return found


def _counted(sample: DataFrame, terms) -> DataFrame:
    """Documents of either class by term, where ``terms(words)`` gives the terms of a document."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by_class = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"]):
                by_class[int(toxic > 0)].update(terms(fold(text).split()))
            keys = list(by_class[0].keys() | by_class[1].keys())
            if not keys:
                continue
            yield pd.DataFrame({"term": keys, "clean": [by_class[0][k] for k in keys],
                                "toxic": [by_class[1][k] for k in keys]})

    return (sample.mapInPandas(count, "term string, clean long, toxic long")
            .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge; the intercept comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([0.0] + [0.1] * (x.shape[1] - 1))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Lexicon:
    seen = _labelled(docs, labels, (0, 1), sample)
    classes = {r["toxic"]: r["n"] for r in seen.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = classes.get(True, 0), classes.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    z = F.col("weight") / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = (_counted(seen, _entries).where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("weight", weight)
           .withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.col("weight") > math.log(4)))
           .orderBy(F.desc("z"), "term").limit(entries).collect())
    weights = {r["term"]: r["weight"] for r in top}
    # A word or stem says nothing beyond a shorter stem that weighs as much.
    lexicon = Lexicon({t: w for t, w in weights.items() if not any(
        weights.get(t[:n + 1], -1.0) >= w - 0.7 for n in STEMS if n + 1 < len(t.rstrip()))})
    held = frozenset(lexicon.weights)

    def phrases(words: list[str]) -> set[str]:
        hit = [any(e in held for e in _entries([w])) for w in words]
        return {f" {words[i]} {words[i + 1]} " for i in range(len(words) - 1) if hit[i] or hit[i + 1]}

    spared = (_counted(seen, phrases).where((F.col("clean") >= LEAST_DOCUMENTS) & (F.col("toxic") == 0))
              .orderBy(F.desc("clean"), "term").limit(entries).collect())
    lexicon.exceptions = sorted(r["term"] for r in spared)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = [_features(fold(t), automaton) for t in batch["text"]]
            yield pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=(batch["toxic"].to_numpy() > 0).astype(float))

    held_back = _labelled(docs, labels, (3,), sample).mapInPandas(measured, "a double, b double, c double, y double")
    found = np.array([tuple(r) for r in held_back.orderBy("a", "b", "c", "y").collect()])
    if len(found) and 0 < found[:, 3].sum() < len(found):
        lexicon.curve = _logistic(found[:, :3], found[:, 3])
    return lexicon


def toxicity(lexicon: Lexicon, text: str | Column = "text") -> Column:
    """The score, 0 to 1, of a text column."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for batch in batches:
            if lexicon.curve is None:
                yield pd.Series(np.zeros(len(batch)))
                continue
            x = np.array([_features(fold(t), automaton) for t in batch], dtype=float).reshape(-1, 3)
            logit = lexicon.curve[0] + x @ np.array(lexicon.curve[1:])
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return score(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    return docs.where(toxicity(learn_lexicon(docs, labels)) < threshold)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(docs, table(spark, folder, "labels"))
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    return (docs.select("doc_id", held_out, toxicity(lexicon).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
