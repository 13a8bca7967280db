"""Secret scans: patterns, and sliding-window Shannon entropy per character class over candidate strings.

Everything is DataFrame functions. Offsets are code points, ends exclusive. Java's matcher gives matches but no code-point
offsets, so that a text is split at the matches and the lengths of gaps and matches are added up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, group that is measured, its least length). A shorter run of hex digits or of an access key holds no
#: longer one, so that their least length can stand in the pattern; a failing assignment uses up what it matched.
BASE = {
    "assign": (ASSIGN, 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}+", 0, 16),
    "hex": (r"[0-9a-f]{32,}+", 0, 32),
}
#: Candidate strings for entropy: runs of these characters with a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: class: (pattern of the whole candidate, alphabet, bits that a window must reach); the first class that fits counts.
CLASSES = {
    "hex": (r"^(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", 2.9),
    "HEX": (r"^(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", 2.9),
    "base32": (r"^(?=.*[A-Z])[A-Z0-9=]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789=", 3.5),
    "base64": (r"^(?=.*[a-z])(?=.*[A-Z]).+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
    "other": (r"^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
}
#: Candidates that are no secrets: UUIDs, repeats of one unit, paths and names, strings that say so. Repeated groups are
#: possessive, for which the matcher loops; others take a stack frame a repeat.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.{1,8})\1{2,}.{0,8}$",
    r"^/?+(?:[A-Za-z0-9]{1,15}+[/_-]){3,}+[A-Za-z0-9]{0,15}+$",
    r"(?i)(example|sample|dummy|placeholder|changeme)",
)
KINDS = [*BASE, "entropy"]
#: Bits of a count in a window, and counts in an integer.
BITS, IN_WORD = 5, 12
#: Matches whose offsets are added up one by one; more are added up in parts.
PART = 256


def _with_spans(df: DataFrame, text: str, out: str, pattern: str, group: int, least: int) -> DataFrame:
    """df plus `out`: array of struct(s, e, m) of all leftmost matches that do not overlap and whose group is long enough."""
    hit = F.col(text).rlike(pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(found.alias("m"), measured.alias("x"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"))
    df = df.withColumn(f"{out}_p", F.when(hit, zipped))
    pairs, size = F.col(f"{out}_p"), F.lit(PART)

    def length(x: Column) -> Column:
        return F.char_length(x["g"]) + F.char_length(x["m"])

    def part(i: Column) -> Column:
        return F.slice(pairs, i * size + 1, size)

    numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / size).cast("int"))
    sizes = F.transform(numbers, lambda i: F.aggregate(part(i), F.lit(0), lambda a, x: a + length(x)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def place(state: Column, x: Column) -> Column:
        s = state["at"] + F.char_length(x["g"])
        e = s + F.char_length(x["m"])
        own = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.char_length(x["x"]).alias("n"))
        return F.struct(e.alias("at"), F.concat(state["out"], F.array(own)).alias("out"))

    none = F.array().cast("array<struct<s:int,e:int,m:string,n:int>>")
    placed = F.transform(numbers, lambda i: F.aggregate(part(i), F.struct(F.get(starts, i).alias("at"), none.alias("out")), place, lambda r: r["out"]))
    df = df.withColumn(f"{out}_q", F.when(pairs.isNotNull(), F.flatten(placed)))
    fits = F.filter(f"{out}_q", lambda x: x["n"] >= least)
    return df.withColumn(out, F.coalesce(fits, none)).drop(f"{out}_p", f"{out}_q")


def _term(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def _entropy_spans(candidates: str, window: int) -> Column:
    """struct(s, e) of the candidates' parts inside windows with enough bits for their class.

    One pass over a candidate holds the counts of the characters in the window and the sum of n log2 n over them. A step
    takes one character in and one out, which changes two counts and two terms of the sum; the entropy of a window
    of w characters is log2(w) less the sum over w. Counts are five bits each, IN_WORD of them in an integer, so that a step
    writes a few integers and not a count for each character of the alphabet.
    """
    if not 1 <= window < 31:
        raise ValueError("a window has 1 to 30 characters")

    def one(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), ((k % IN_WORD) * BITS).cast("int"))

    def count_of(n: Column, k: Column) -> Column:
        word = F.get(n, F.floor(k / IN_WORD).cast("int"))
        return F.call_function("shiftright", word, ((k % IN_WORD) * BITS).cast("int")).bitwiseAND((1 << BITS) - 1)

    def reach(x: Column, alphabet: str, bits: float) -> Column:
        places = F.transform(F.split(x["m"], ""), lambda c: F.call_function("instr", F.lit(alphabet), c))
        start = F.struct(
            F.array_repeat(F.lit(0).cast("long"), len(alphabet) // IN_WORD + 1).alias("n"),
            F.lit(0.0).alias("sum"),
            F.lit(0).alias("i"),
            F.lit(-1).alias("lo"),
            F.lit(0).alias("hi"),
        )

        def step(st: Column, y: Column) -> Column:
            new, old = y["new"], y["old"]
            n_new = count_of(st["n"], new)
            n_old = count_of(st["n"], old) + (new == old).cast("int")
            gone = F.when(old >= 0, _term(n_old) - _term(n_old - 1)).otherwise(F.lit(0.0))
            total = st["sum"] + _term(n_new + 1) - _term(n_new) - gone
            i = st["i"] + 1
            good = (i >= window) & (F.lit(math.log2(window)) - total / window >= bits)
            into, out_of = F.floor(new / IN_WORD), F.when(old >= 0, F.floor(old / IN_WORD)).otherwise(F.lit(-1).cast("long"))
            nothing = F.lit(0).cast("long")
            counts = F.transform(st["n"], lambda c, k: c + F.when(k == into, one(new)).otherwise(nothing) - F.when(k == out_of, one(old)).otherwise(nothing))
            return F.struct(
                counts.alias("n"),
                total.alias("sum"),
                i.alias("i"),
                F.when(good & (st["lo"] < 0), i - window).otherwise(st["lo"]).alias("lo"),
                F.when(good, i).otherwise(st["hi"]).alias("hi"),
            )

        none = F.array_repeat(F.lit(-1), window)
        moves = F.zip_with(places, F.slice(F.concat(none, places), F.lit(1), F.size(places)), lambda a, b: F.struct(a.alias("new"), b.alias("old")))
        return F.aggregate(moves, start, step, lambda st: F.when(st["hi"] > 0, F.struct((x["s"] + st["lo"]).alias("s"), (x["s"] + st["hi"]).alias("e"))))

    def judged(x: Column) -> Column:
        out = F.lit(None).cast("struct<s:int,e:int>")
        for pattern, alphabet, bits in reversed(CLASSES.values()):
            out = F.when(x["m"].rlike(pattern), reach(x, alphabet, bits)).otherwise(out)
        for pattern in ALLOWED:
            out = F.when(~x["m"].rlike(pattern), out)
        return out

    return F.filter(F.transform(candidates, judged), lambda x: x.isNotNull())


def _numbered(kind: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))


def find_secrets(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of docs plus `secrets`: array of struct(kind, start, end), by start and then kind in the order of KINDS.

    assign, access and hex are the patterns' matches; entropy spans are added where they do not touch one of those. Null
    and empty texts have none; repeated rows each get theirs; a column named secrets gives way. No shuffle, no Python.
    """
    t = "__text"
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "secrets"], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(t))
    for kind, (pattern, group, least) in BASE.items():
        df = _with_spans(df, t, f"__{kind}", pattern, group, least)
    df = _with_spans(df, t, "__candidates", CANDIDATE, 0, 0)
    base = F.concat(*[F.transform(f"__{k}", _numbered(i)) for i, k in enumerate(BASE)])
    df = df.withColumn("__base", base).withColumn("__more", F.when(F.size("__candidates") > 0, _entropy_spans("__candidates", window)))
    alone = F.filter("__more", lambda x: ~F.exists("__base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    more = F.transform(alone, _numbered(len(BASE)))
    every = F.array_sort(F.concat("__base", F.coalesce(more, F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(every, lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end")))
    return df.withColumn("secrets", named).drop(t, "__base", "__more", "__candidates", *[f"__{k}" for k in BASE])


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret in the text replaced by `mark` (overlapping ones by one), and the number of characters
    brought up to date where a text changed and docs have that column. No row goes; null texts stay null."""
    hidden = "__secrets"
    found = find_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__t")), "__t")
    t, spans, size = F.col("__t"), F.col(hidden), F.lit(PART)
    # spans are taken in parts, so that a part's places are counted in its own region and not from the start of a long text
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / size).cast("int")), lambda i: F.slice(spans, i * size + 1, size))
    ends = F.transform(parts, lambda p: F.array_max(F.transform(p, lambda x: x["end"])))
    begins = F.aggregate(ends, F.array(F.lit(0)), lambda a, e: F.concat(a, F.array(F.greatest(F.element_at(a, -1), e))))

    def cleaned(p: Column, i: Column) -> Column:
        base = F.get(begins, i)
        region = F.substring(t, base + 1, F.get(begins, i + 1) - base)

        def step(st: Column, x: Column) -> Column:
            more = F.when(x["start"] >= st["at"], F.concat(F.substring(region, st["at"] - base + 1, x["start"] - st["at"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.concat(st["out"], more).alias("out"), F.greatest(st["at"], x["end"]).alias("at"))

        return F.aggregate(p, F.struct(F.lit("").alias("out"), base.alias("at")), step, lambda st: st["out"])

    clean = F.concat(F.array_join(F.transform(parts, cleaned), ""), F.substring(t, F.element_at(begins, -1) + 1, F.char_length(t)))
    found = found.withColumnRenamed("secrets", hidden).withColumn("__clean", F.when(F.size(hidden) > 0, clean))
    cols = []
    for f in docs.schema.fields:
        c = F.col("__row")[f.name]
        if f.name == text_col:
            c = F.coalesce(F.col("__clean").cast(f.dataType), c)
        elif f.name == n_chars_col:
            c = F.when(F.col("__clean").isNotNull(), F.char_length("__clean").cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return found.select(*cols)
