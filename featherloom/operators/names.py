"""Human names in text columns: whether a column holds names, and first name and gender of each.

The dictionaries are parameters. Detection is one aggregation; what it decides is plain JSON, and the statistics of a name are
column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HONORIFICS_FEMALE, HONORIFICS_MALE, name_share

#: Mean share of name words from which a column holds names.
MIN_SHARE = 0.5
#: Guards: a column of names has short texts, that vary in length and are not all the same.
MAX_WORDS, MAX_LENGTH, MIN_LENGTH_STD, MIN_DISTINCT = 10, 50, 0.05, 10
STRATEGIES = ("honorific", "first", "last", "after_comma")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def detect(df: DataFrame, name: str, names: list[str], genders: dict[str, str], min_share: float = MIN_SHARE, guards: bool = True) -> dict:
    """Whether the column holds names, and the strategy that tells most genders (ties in the order of STRATEGIES)."""
    c = F.col(f"`{name}`")
    n_words = F.size(_words(c))
    found = {s: F.sum((gender(c, genders, s) != "GenderNotInferred").cast("int")).alias(s) for s in STRATEGIES}
    row = df.where(c.isNotNull()).agg(
        F.avg(name_share(c, names)).alias("share"), F.avg(n_words).alias("words"), F.avg(F.length(c)).alias("length"), F.stddev_pop(F.length(c)).alias("std"),
        F.approx_count_distinct(c).alias("distinct"), *found.values(),
    ).first()
    fits = row["share"] is not None and row["share"] >= min_share
    if fits and guards:
        fits = row["words"] <= MAX_WORDS and row["length"] <= MAX_LENGTH and row["std"] >= MIN_LENGTH_STD and row["distinct"] >= MIN_DISTINCT
    return {"is_name": bool(fits), "share": row["share"] or 0.0, "strategy": max(STRATEGIES, key=lambda s: row[s] or 0), "names": names, "genders": genders}


def first_name(c: Column, strategy: str) -> Column:
    words = F.filter(_words(c), lambda w: ~w.isin(*HONORIFICS_MALE, *HONORIFICS_FEMALE))
    if strategy == "last":
        return F.get(words, F.size(words) - 1)
    if strategy == "after_comma":
        return F.get(_words(F.regexp_extract(c, r",\s*(.*)$", 1)), F.lit(0))
    return F.get(words, F.lit(0))


def gender(c: Column, genders: dict[str, str], strategy: str) -> Column:
    """Male or Female; GenderNotInferred where the strategy says nothing."""
    if strategy == "honorific":
        words = _words(c)
        has = lambda titles: F.arrays_overlap(words, F.array(*[F.lit(t) for t in titles]))
        found = F.when(has(HONORIFICS_MALE), "Male").when(has(HONORIFICS_FEMALE), "Female")
    else:
        first = first_name(c, strategy)
        found = F.when(first.isin(*[n for n, g in genders.items() if g == "Male"]), "Male").when(first.isin(*[n for n, g in genders.items() if g == "Female"]), "Female")
    return F.coalesce(found, F.lit("GenderNotInferred"))


def name_stats(c: Column, fitted: dict) -> Column:
    """Map of OriginalValue, IsName, FirstName and Gender; null where the column holds no names or the text is null."""
    if not fitted["is_name"]:
        return F.lit(None).cast("map<string,string>")
    first = F.coalesce(first_name(c, fitted["strategy"]), F.lit(""))
    stats = F.create_map(
        F.lit("OriginalValue"), c, F.lit("IsName"), F.lit("true"), F.lit("FirstName"), first, F.lit("Gender"), gender(c, fitted["genders"], fitted["strategy"])
    )
    return F.when(c.isNotNull(), stats)
