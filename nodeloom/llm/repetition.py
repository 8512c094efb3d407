"""Repetition inside a single document.

The features of a text are its word n-grams, hashed, each with whether it occurred before in the
same text: ``BUCKETS`` buckets of first and as many of further occurrences. Two multinomials are
counted over all documents:

- *raw*: the whole corpus;
- *trusted target*: the documents in which no n-gram occurs twice.

A document's score is the log-likelihood ratio of its features, target against raw, divided by
their number. Every document whose score is not above :func:`threshold` is a candidate, and only
candidates have their words compared one by one.

No case is lost. With T and R features in target and raw, counts t <= r in a bucket and a
pseudo-count a, each feature adds log((t + a) / (r + a)) + K, where K = log((R + 2Ba) / (T + 2Ba)).
A first occurrence adds K at most; a further one has t = 0 and r >= 1 and adds K - log((1 + a) / a)
at most. If a share s of a text's words stands in repeated runs, at least s / n of its n-grams are
further occurrences (each covers n words), so its score is at most K - s / n * log((1 + a) / a):
the threshold. It depends on the corpus's two totals only.

The occurrence belongs to the feature because corpus-wide n-gram counts alone can't tell a text
that says an ordinary paragraph three times from one that says it once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.session import spread

# Characters that are words of their own (Han, Hiragana, Katakana and its half-width form).
_CJK = "⺀-⿟々-〇〡-〩぀-゚ゝ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_CJK}]|[^\\W\\d_{_CJK}]+")
#: Buckets of first occurrences, and of further ones; bounds what is collected and broadcast.
BUCKETS = 1 << 16
#: Pseudo-count of each bucket in both multinomials.
PRIOR = 1e-3
_MULTIPLIER, _APART = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


_ASCII_WORD, _LETTERS, _HIGH = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+"), re.compile("[\u2e80-\U0010ffff]")


def words(text: str) -> list[str]:
    """Words of a text: runs of letters, Chinese and Japanese characters one by one."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = unicodedata.normalize("NFC", text).casefold()
    return (_WORD if _HIGH.search(text) else _LETTERS).findall(text)


class _Numbers(dict):
    """64-bit numbers of words, the same in every task; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        got = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return got


def gram_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, given as numbers; none for a shorter text."""
    m = max(0, len(a) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ a[k : k + m]) * np.uint64(_MULTIPLIER)
        h ^= h >> np.uint64(32)
    return h


def features(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram: below ``BUCKETS`` at its first occurrence in its text, else above."""
    key = h ^ (doc.astype(np.uint64) * np.uint64(_APART))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(h), np.int64)
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return (h % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS * again


def _parts(batches: Iterator[pa.RecordBatch], n: int, step: int = 512) -> Iterator[tuple[pa.RecordBatch, list[list[str]], np.ndarray, np.ndarray]]:
    """(rows, their words, features of all their n-grams, row of each), some hundred texts at a time."""
    numbers = _Numbers()
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            texts = [words(t or "") for t in part.column(1).to_pylist()]
            sizes = np.array([len(ws) for ws in texts])
            flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.uint64, sizes.sum())
            doc = np.repeat(np.arange(len(texts)), sizes)
            h = gram_hashes(flat, n)
            whole = doc[: len(h)] == doc[n - 1 :][: len(h)]
            doc = doc[: len(h)][whole]
            yield part, texts, features(h[whole], doc), doc


def repeated_words(ws: list[str], n: int = 8) -> int:
    """How many words stand in runs of n or more words that occurred earlier in the text as well.

    Exact: runs are compared word by word wherever their hashes agree."""
    ids: dict[str, int] = {}
    return _covered(np.array([ids.setdefault(w, len(ids)) for w in ws], np.uint64), n)


def _covered(a: np.ndarray, n: int) -> int:
    h = gram_hashes(a, n)
    m, order = len(h), np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    later, earlier = order[1:][same], order[:-1][same]
    equal = np.ones(len(later), bool)
    for k in range(n):
        equal &= a[later + k] == a[earlier + k]
    if not equal.all():  # two runs share a hash: tell them apart by their words
        first: dict[bytes, int] = {}
        later = np.array([i for i in range(m) if first.setdefault(a[i : i + n].tobytes(), i) != i], np.int64)
    edge = np.zeros(len(a) + 1, np.int64)
    np.add.at(edge, later, 1)
    np.add.at(edge, later + n, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


@dataclass
class Multinomials:
    """Counts of all feature buckets in the raw corpus and in the trusted target."""

    raw: np.ndarray
    target: np.ndarray

    @property
    def total(self) -> float:
        """K of the module's text."""
        size = len(self.raw) * PRIOR
        return math.log((self.raw.sum() + size) / (self.target.sum() + size))

    def ratios(self) -> np.ndarray:
        """Log-likelihood ratio of each bucket."""
        return np.log((self.target + PRIOR) / (self.raw + PRIOR)) + self.total

    def threshold(self, share: Fraction, n: int) -> float:
        return self.total - float(share) / n * math.log((1 + PRIOR) / PRIOR)


def count_features(docs: DataFrame, n: int = 8, key: str = "doc_id") -> Multinomials:
    """Both multinomials over all documents: added up per task, then per bucket; what reaches the
    driver is at most ``2 * BUCKETS`` rows whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for part, _, at, doc in _parts(batches, n):
            raw += np.bincount(at, minlength=len(raw))
            trusted = np.bincount(doc, at >= BUCKETS, part.num_rows) == 0
            target += np.bincount(at[trusted[doc]], minlength=len(target))
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(raw[there]), pa.array(target[there])], ["bucket", "r", "t"])

    counts = spread(docs.select(key, "text")).mapInArrow(run, "bucket long, r long, t long")
    rows = counts.groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).toArrow()
    got = Multinomials(np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64))
    at = rows.column("bucket").to_numpy()
    got.raw[at], got.target[at] = rows.column("r").to_numpy(), rows.column("t").to_numpy()
    return got


def scored(docs: DataFrame, share: Fraction = Fraction(2, 5), n: int = 8, key: str = "doc_id", every: bool = True, counted: Multinomials | None = None) -> DataFrame:
    """(key, n_words, n_repeated, share, llr, threshold, flagged), one row per row of ``docs``.

    ``flagged``: the score is not above the threshold and, word by word, at least ``share`` of the
    words are repeated. Texts of fewer than n words, empty and null ones have no score and no
    flag. ``every`` gives the exact share of all rows; without it, n_repeated and share are null
    where the score settles the matter. ``counted``: multinomials of an earlier count."""
    counted = counted or count_features(docs, n, key)
    limit = counted.threshold(share, n)
    table = docs.sparkSession.sparkContext.broadcast(counted.ratios())
    low = limit + 1e-9 * (1 + abs(limit))  # sums of floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = table.value
        for part, texts, at, doc in _parts(batches, n):
            sums, counts = np.bincount(doc, ratios[at], part.num_rows), np.bincount(doc, minlength=part.num_rows)
            rows = []
            for ws, total, count in zip(texts, sums.tolist(), counts.tolist()):
                llr = total / count if count else None
                candidate = llr is not None and llr <= low
                repeated = repeated_words(ws, n) if candidate or every else None
                flagged = candidate and repeated > 0 and repeated * share.denominator >= len(ws) * share.numerator
                rows.append((len(ws), repeated, None if repeated is None else repeated / max(1, len(ws)), llr, flagged))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], [key, "n_words", "n_repeated", "share", "llr", "flagged"])

    rows = spread(docs.select(key, "text")).mapInArrow(run, f"{key} long, n_words long, n_repeated long, share double, llr double, flagged boolean")
    return rows.select(key, "n_words", "n_repeated", "share", "llr", F.lit(limit).alias("threshold"), "flagged")
