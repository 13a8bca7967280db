"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent letter n-grams (n = 1 to 3, words padded with a boundary mark) of a language,
most frequent first. A document's own most frequent n-grams are compared with each profile by the out-of-place
distance: the sum over its n-grams of how far their rank is from the rank in the profile, with a fixed penalty for
n-grams that the profile lacks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts, slices, small_batches, tidy

#: N-grams in a profile, of a language and of a document.
PROFILE = 400
#: Profile entries that are sent to the executors at once (24 bytes each).
MAX_PROFILE_ROWS = 2_000_000
#: Characters of which the n-grams are counted at a time.
CHUNK = 1 << 20
#: Distinct n-grams of all languages that a training task holds before it passes its counts on.
HELD = 1_000_000
BOUNDARY = 1
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def codes_of(lower: str) -> np.ndarray:
    """The letters of a text in lower case; every other character is a boundary."""
    code = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(letters()[code], code, BOUNDARY)


def joined(ahead: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The codes behind those ahead, runs of boundaries drawn together."""
    code = np.concatenate((ahead, code))
    return code[np.concatenate(([True], (code[1:] != BOUNDARY) | (code[:-1] != BOUNDARY)))]


def keys_of(code: np.ndarray, before: int = 0) -> np.ndarray:
    """N-grams that end after the first `before` codes (0 to 2), each as a 63-bit integer."""
    one = code[before:]
    two = (code[:-1] << 21 | code[1:])[max(0, before - 1) :]
    at = max(0, before - 2)
    a, b, c = code[at:-2], code[at + 1 : -1], code[at + 2 :]
    three = (a << 42 | b << 21 | c)[b != BOUNDARY]
    return np.concatenate((one[one != BOUNDARY], two, three))


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text in ascending order, and how often each occurs; the start and the end are boundaries. The
    text is taken in parts of CHUNK characters, so that of a long text only the counts are held."""
    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
    lower, ahead = (text or "").lower(), np.array([BOUNDARY])
    for i in range(0, len(lower), CHUNK):
        own = codes_of(lower[i : i + CHUNK])
        code = joined(ahead, np.append(own, BOUNDARY) if i + CHUNK >= len(lower) else own)
        if len(code) > len(ahead):
            got = np.unique(keys_of(code, len(ahead)), return_counts=True)
            keys, n = summed([(keys, n), got]) if len(keys) else got
            ahead = code[-2:]
    return keys, n


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, np.concatenate([p[1] for p in parts]))
    return keys, out


def ranked(keys: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by n-gram."""
    if len(n) > 2 * size:  # only those that can be among them
        least = np.partition(n, len(n) - size)[len(n) - size]
        keys, n = keys[n >= least], n[n >= least]
    return keys[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    """Ranks of the n-grams of all languages: a row for each n-gram that some profile has."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), size, np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, key, rank in rows:
            self.rank[np.searchsorted(self.keys, key), at[lang]] = rank

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance to each language as a share of the largest possible one; None without letters."""
        keys, n = counts_of(text)
        if not len(keys) or not self.langs:
            return None
        top = ranked(keys, n, self.size)
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        at = np.where(self.keys[at] == top, at, len(self.keys))
        rank = self.rank[at]
        gap = np.where(rank < self.size, np.abs(rank - np.arange(len(top))[:, None]), self.size)
        return gap.sum(0) / (len(top) * self.size)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, confidence and distance: the confidence is how much nearer the best language is than the second."""
        d = self.distances(text)
        if d is None:
            return "und", 0.0, 1.0
        best = int(np.argmin(d))
        rest = np.delete(d, best)
        second = rest.min() if len(rest) else 1.0
        return self.langs[best], float(min(1.0, max(0.0, (second - d[best]) / second))) if second > 0 else 0.0, float(d[best])


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the `size` most frequent n-grams of each language, over all rows whose text and lang are
    not null; ties go by n-gram. Tasks add up their counts before the shuffle, which moves counts of distinct n-grams only."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size_held = 0

        def out():
            for lang, parts in held.items():
                keys, n = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    keys, n = counts_of(text)
                    if len(keys):
                        held.setdefault(lang, []).append((keys, n))
                        size_held += len(keys)
                if size_held > HELD:
                    held = {k: [summed(v)] for k, v in held.items()}
                    size_held = sum(len(v[0][0]) for v in held.values())
                    if size_held > HELD // 2:
                        yield from out()
                        held, size_held = {}, 0
        yield from out()

    small_batches(docs.sparkSession)
    counts = rows.where("lang is not null and text is not null").mapInArrow(tidy(count), "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    first = total.withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod(F.hash("gram"), F.lit(64))).orderBy(*order))).where(F.col("r") <= size)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < size)
    return last.select("lang", "gram", "rank")


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = PROFILE, keep: list[str] | None = None) -> DataFrame:
    """docs (columns in `keep`, or all) plus lang_pred, score (0 to 1, how much nearer the best language is than the
    second) and distance (0 to 1).

    Null texts and texts without a letter give `und`, 0 and 1, and so does everything when there are no profiles. Ties
    go to the language that comes first by name. Columns of docs with the new names give way. No shuffle. Profiles
    are sent to the executors after a check of their number; beyond MAX_PROFILE_ROWS they are not for broadcast
    and an error says so (that would be thousands of languages).
    """
    saved = cut(profiles)
    n = saved.count()
    if n > MAX_PROFILE_ROWS:
        raise ValueError(f"{n} profile entries; at most {MAX_PROFILE_ROWS} are sent to the executors")
    shared = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in saved.collect()], size))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("distance", T.DoubleType())]

    def make():
        model = shared.value

        def apply(texts: list) -> list[list]:
            return list(map(list, zip(*map(model.predict, texts), strict=True)))

        return apply

    return map_texts(docs, text_col, fields, make, keep)
