"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle).

A profile is the list of a language's most frequent letter n-grams, n = 1 to 3,
with a blank at either end of a word.  A document's own list is compared to
each profile: an n-gram costs the difference of its two ranks, or the length of
the profile if it is missing there.  The least total wins, by code point on a
tie.

Profiles are learned from a bounded sample: about ``per_language`` documents of
each language, chosen by a hash of the id.  Everything else covers whole texts
of all documents.

Defined results: a null text or one without a letter is ``und`` with score 0.
Without anything to learn from every document is ``und``.  Repeated rows get
equal results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import ship_code

#: Documents of each language that profiles are learned from, in expectation.
PER_LANGUAGE = 3000
#: n-grams in a profile.
TOP = 300
BLANK = 1
#: Code points worked on at a time, so that a very long text takes bounded memory.
PART = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def ngrams(text: str, part: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, ascending, and how often each occurs.  An n-gram is its code points in 21 bits each.

    ``part`` characters are worked on at a time, with the last two marks of the
    row before them, and the counts of the parts are merged.
    """
    part = part or PART
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    tail, seen = np.full(1, BLANK, np.int64), False
    for a in range(0, len(text) + 1, part):
        last = a + part > len(text)
        points = np.frombuffer(text[a : a + part].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        letter = _letters()[points]
        seen = seen or bool(letter.any())
        row = np.concatenate([tail, np.where(letter, points, BLANK), np.full(int(last), BLANK, np.int64)])
        keep = np.ones(len(row), dtype=bool)
        keep[1:] = (row[1:] != BLANK) | (row[:-1] != BLANK)  # one blank between words
        x = row[keep]
        old = min(len(tail), len(x))  # marks that were counted by themselves
        two = (x[:-1] << 21) | x[1:]
        three = (two[:-1] << 21) | x[2:]
        fresh = [x[old:][x[old:] != BLANK], two[max(old - 1, 0) :], three[x[1:-1] != BLANK]]
        own, n = np.unique(np.concatenate(fresh), return_counts=True)
        if len(codes):
            codes, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)
        else:
            codes = own
        counts, tail = n, x[-2:]
    return (codes, counts) if seen else (np.empty(0, np.int64), np.empty(0, np.int64))


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, first the most frequent, ties by number."""
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Rank lists of languages, as one matrix over the n-grams of all of them."""

    def __init__(self, lists: dict[str, list[int]], top: int = TOP):
        self.names = sorted(lists)
        self.top = top
        self.codes = np.unique(np.array([c for x in lists.values() for c in x], dtype=np.int64))
        self.ranks = np.full((len(self.names), len(self.codes)), -1, dtype=np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.codes, lists[name])] = np.arange(len(lists[name]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language with the least out-of-place distance, and 1 less that distance as a share of the most it can be."""
        if not text or not self.names:
            return "und", 0.0
        own = ranked(*ngrams(text), self.top)
        if not len(own):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        ranks = self.ranks[:, at]
        away = np.where(known & (ranks >= 0), np.minimum(np.abs(ranks - np.arange(len(own))), self.top), self.top).sum(axis=1)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (self.top * len(own)))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, top: int = TOP, seed: int = 7) -> Profiles:
    """Profiles of every non-null ``lang`` in ``docs``, from about ``per_language`` documents each."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL")
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.collect()  # a row for each language
    if not sizes:
        return Profiles({}, top)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["n"]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t:
                    mine = total.setdefault(name, {})
                    for c, n in zip(*(x.tolist() for x in ngrams(t)), strict=True):
                        mine[c] = mine.get(c, 0) + n
        for name, mine in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(mine)), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["lang", "code", "n"])

    grams = picked.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    lists: dict[str, list[int]] = {}
    for r in grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).orderBy("lang", "rank").collect():  # top rows for each language
        lists.setdefault(r["lang"], []).append(r["code"])
    return Profiles(lists, top)


def identify(text: Column, profiles: Profiles) -> Column:
    """A struct (lang_pred, score) for each text."""

    ship_code()

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([profiles.nearest(x) for x in texts], columns=["lang_pred", "score"])

    return of(text)


