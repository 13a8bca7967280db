"""Text functions on columns."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

STOP_WORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
HONORIFICS_MALE = ("mr", "mister", "sir")
HONORIFICS_FEMALE = ("ms", "mrs", "miss", "madam")


def clean(c: Column) -> Column:
    """Lower case, punctuation to spaces, each word capitalised, joined without separators."""
    spaced = F.regexp_replace(F.lower(c), r"\p{Punct}", " ")
    return F.regexp_replace(F.initcap(F.trim(F.regexp_replace(spaced, " +", " "))), " +", "")


def concat_skip_empty(sep: str, *cols: Column) -> Column:
    return F.concat_ws(sep, *[F.when(c != "", c) for c in cols])


def tokenize(c: Column, min_length: int = 1, to_lower: bool = True, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Runs of letters and digits without stop words; null if nothing is left."""
    tokens = F.regexp_extract_all(F.lower(c) if to_lower else c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    kept = F.filter(tokens, lambda t: (F.length(t) >= min_length) & ~t.isin(*stop_words)) if stop_words else F.filter(tokens, lambda t: F.length(t) >= min_length)
    return F.when(F.size(kept) > 0, kept)


def strip_html(c: Column) -> Column:
    plain = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def tokenize_html(c: Column, **options) -> Column:
    return tokenize(strip_html(c), **options)


def tokenize_regex(c: Column, pattern: str, group: int = -1, min_length: int = 1, to_lower: bool = True) -> Column:
    """Split at the pattern (group -1) or take a group of each match."""
    s = F.lower(c) if to_lower else c
    tokens = F.split(s, pattern, -1) if group < 0 else F.regexp_extract_all(s, F.lit(pattern), F.lit(group))
    kept = F.filter(tokens, lambda t: F.length(t) >= min_length)
    return F.when(F.size(kept) > 0, kept)


def sentences(c: Column) -> Column:
    """Sentences by closing punctuation before white space."""
    found = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return F.when(F.size(found) > 0, found)


def is_substring(sub: Column, full: Column, to_lower: bool = True) -> Column:
    return F.contains(F.lower(full), F.lower(sub)) if to_lower else F.contains(full, sub)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; two empty sets are alike."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


#: Cells of the tables that are filled side by side.
_CELLS = 1 << 20


def _padded(texts: list[str], width: int, before: int) -> np.ndarray:
    """Code points, a row for each text, behind `before` zeros and filled up with zeros to `width` characters."""
    out = np.zeros((len(texts), before + width), np.uint32)
    for row, t in zip(out, texts, strict=True):
        row[before : before + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def _aligned(a: list[str], b: list[str], n: int) -> np.ndarray:
    """N-gram edit distances of pairs of about the same lengths: row by row of their tables, all pairs at once."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    wide, deep, every = int(la.max()), int(lb.max()), np.arange(len(a))
    left, right = _padded(a, wide, n - 1), _padded(b, deep, n - 1)
    steps = np.arange(wide + 1)
    row, out = np.tile(steps.astype(float), (len(a), 1)), np.zeros(len(a))
    for j in range(1, deep + 1):
        cost, total = np.zeros((len(a), wide)), np.full((len(a), wide), float(n))
        for k in range(n):
            x = left[:, k : k + wide]
            same = x == right[:, j - 1 + k, None]
            cost += ~same
            total -= same & (x == 0)
        new = np.empty_like(row)
        new[:, 0] = j
        # a pair of paddings alone costs nothing and counts nothing
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + cost / np.maximum(total, 1))
        row = np.minimum.accumulate(new - steps, 1) + steps
        done = lb == j
        out[done] = row[every[done], la[done]]
    return out


def ngram_scores(a: list[str], b: list[str], n: int = 3) -> np.ndarray:
    """Similarities of pairs by n-gram edit distance (Kondrak, 2005), 0 if either text is empty. Pairs of like lengths are
    compared together."""
    out, long = np.zeros(len(a)), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and x == y:
            out[i] = 1.0
        elif x and y and min(len(x), len(y)) < n:
            out[i] = sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y))
        elif x and y:
            long.append(i)
    long.sort(key=lambda i: (len(a[i]), len(b[i])))
    while long:
        many = max(1, min(len(long), _CELLS // (len(a[long[-1]]) + n)))
        some, long = long[-many:], long[:-many]
        out[some] = 1.0 - _aligned([a[i] for i in some], [b[i] for i in some], n) / np.array([max(len(a[i]), len(b[i])) for i in some])
    return out


def ngram_distance(a: str, b: str, n: int = 3) -> float:
    """Similarity of one pair."""
    return float(ngram_scores([a], [b], n)[0])


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(ngram_scores([p.strip().lower() for p in x], [q.strip().lower() for q in y], n))

    return score(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def set_ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    return ngram_similarity(F.array_join(F.coalesce(a, F.array().cast("array<string>")), " "), F.array_join(F.coalesce(b, F.array().cast("array<string>")), " "), n)


def ngrams(tokens: Column, n: int) -> Column:
    def of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams)

    return let(tokens, of)


def remove_stop_words(tokens: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*stop_words))


def token_length(tokens: Column) -> Column:
    return F.coalesce(F.aggregate(tokens, F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)).cast("double")


def list_is_null(tokens: Column) -> Column:
    return F.when(tokens.isNull() | (F.size(tokens) <= 0), 1.0).otherwise(0.0)


def gender_by_honorific(c: Column) -> Column:
    """Male or Female by a title among the words, else GenderNotAvailable."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    has = lambda titles: F.arrays_overlap(words, F.array(*[F.lit(t) for t in titles]))
    return F.when(has(HONORIFICS_MALE), "Male").when(has(HONORIFICS_FEMALE), "Female").otherwise("GenderNotAvailable")


def name_share(c: Column, names: list[str]) -> Column:
    """Share of the words of a text that a dictionary of names holds."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    known = F.filter(words, lambda w: w.isin(*[n.lower() for n in names]))
    return F.when(F.size(words) > 0, F.size(known) / F.size(words)).otherwise(0.0)


#: Languages of the stop-word lists that Spark brings, by code.
LANGUAGES = {
    "da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese",
    "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish",
}
#: Entities that have a form: tag and pattern. Others come from a dictionary.
ENTITY_PATTERNS = {
    "Date": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    "Time": r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    "Money": r"[$€£]\s?\d[\d.,]*\d|[$€£]\s?\d",
    "Percentage": r"\b\d+(?:[.,]\d+)?\s?%",
}


# Endings of Porter's stemmer (1980) and what becomes of them, by step.
_PORTER_2 = dict(x.split(":") for x in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al "
    "iviti:ive biliti:ble logi:log"
).split())
_PORTER_3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_PORTER_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split(), "")


def _letters(w: str) -> str:
    """v for vowels and c for consonants; y is a vowel behind a consonant."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    """Vowels that consonants follow, runs counting once."""
    return len(re.findall("v+c+", _letters(w)))


def _short(w: str) -> bool:
    return _letters(w).endswith("cvc") and w[-1] not in "wxy"


def _replaced(w: str, endings: dict[str, str], least: int) -> str:
    """The longest of the endings that w has, replaced if what stands before it measures at least `least`."""
    end = max((e for e in endings if w.endswith(e)), key=len, default="")
    if end in ("sion", "tion") and endings is _PORTER_4:
        return w[:-3] if _measure(w[:-3]) >= least else w
    return w[: -len(end)] + endings[end] if end and _measure(w[: -len(end)]) >= least else w


@lru_cache(1 << 16)
def stem_english(w: str) -> str:
    """The stem of a word in lower case, by Porter's five steps."""
    if len(w) < 3:
        return w
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith(("ed", "ing")):
        base = w[:-2] if w.endswith("ed") else w[:-3]
        if "v" in _letters(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-2:-1] == w[-1:] and _letters(w).endswith("c") and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _letters(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(_replaced(w, _PORTER_2, 1), _PORTER_3, 1), _PORTER_4, 2)
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stem(tokens: Column) -> Column:
    """English stems of tokens in lower case; words with other letters than a to z stay as they are."""

    @F.pandas_udf("array<string>")
    def stems(lists: pd.Series) -> pd.Series:
        plain = re.compile("[a-z]+")
        return lists.map(lambda x: None if x is None else [stem_english(t) if t and plain.fullmatch(t) else t for t in x])

    return stems(tokens)


def stop_words_of(language: str) -> tuple[str, ...]:
    """Spark's stop words of a language, by code; needs a session."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(w for w in StopWordsRemover.loadDefaultStopWords(LANGUAGES[language]) if w)


def tokenize_language(c: Column, language: str, min_length: int = 1, stems: bool = False) -> Column:
    """Tokens without the stop words of a language; stems: for English, the stems of the tokens."""
    tokens = tokenize(c, min_length, stop_words=stop_words_of(language))
    if stems and language != "en":
        raise ValueError(f"no stemmer for {language}")
    return stem(tokens) if stems else tokens


def detect_languages(c: Column, languages: tuple[str, ...] = tuple(LANGUAGES)) -> Column:
    """Language to confidence: how the words that are stop words of some language are shared out among the languages. Null if
    there are none. Everything stays in the JVM; other detectors can be plugged in by `map`."""
    lists = {k: stop_words_of(k) for k in languages}

    def shares(words: Column) -> Column:
        hits = F.array(*[F.struct(F.lit(k).alias("key"), F.size(F.filter(words, _within(own))).cast("double").alias("n")) for k, own in lists.items()])
        return let(F.filter(hits, lambda x: x["n"] > 0), shared)

    def shared(some: Column) -> Column:
        total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x["n"])
        return F.when(F.size(some) > 0, let(total, lambda t: F.map_from_entries(F.transform(some, lambda x: F.struct(x["key"], (x["n"] / t).alias("value"))))))

    return let(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}']+"), F.lit(0)), shares)


def _within(words: tuple[str, ...]):
    return lambda w: w.isin(*words)


def recognize_entities(c: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Token to its tags: dates, times, money and percentages by form; words of the dictionary (in lower case) by its tags."""
    found = [F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), _tagged(tag)) for tag, p in ENTITY_PATTERNS.items()]
    by_tag: dict[str, list[str]] = {}
    for word, tag in (dictionary or {}).items():
        by_tag.setdefault(tag, []).append(word.lower())
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))
    found += [F.transform(F.filter(words, _known(own)), _tagged(tag)) for tag, own in by_tag.items()]

    def tagged(pairs: Column) -> Column:
        tokens = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
        tags = lambda t: F.array_sort(F.transform(F.filter(pairs, lambda p: p["k"] == t), lambda p: p["v"]))
        return F.when(F.size(pairs) > 0, F.map_from_entries(F.transform(tokens, lambda t: F.struct(t, tags(t)))))

    return let(F.array_distinct(F.flatten(F.array(*found))), tagged)


def _tagged(tag: str):
    return lambda t: F.struct(t.alias("k"), F.lit(tag).alias("v"))


def _known(words: list[str]):
    return lambda w: F.lower(w).isin(*words)
