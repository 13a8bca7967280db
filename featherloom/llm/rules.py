"""Quality rules with host-level verdicts.

Each document is measured and judged by rules of its own; the failures are aggregated by host, each host's rate is shrunk
towards the corpus with an empirical beta prior, and hosts whose shrunk rate is too high take their documents with them.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts

MIN_WORDS = 50
#: Percent of the words that may lie in repeated windows.
MAX_REPEATED = 50
WINDOW = 3
#: Shrunk failure rate above which a host's documents go.
HOST_RATE = 0.5
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    return len(words), chars, symbols, lines.total() - len(lines), repeated_words(words)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    n = Counter(windows)
    if len(n) == len(windows):
        return 0
    covered = end = 0
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered += i + size - max(i, end)
            end = i + size
    return covered


def measured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (columns in `keep`, or all) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        return lambda texts: list(map(list, zip(*map(measure, texts), strict=True)))

    out = map_texts(docs, text_col, [T.StructField(n, T.LongType()) for n in names], make, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host_col: str, failed_col: str = "base_failed", max_rate: float = HOST_RATE) -> DataFrame:
    """(host, docs, failures, rate, shrunk_rate, host_failed) for every host that is not null.

    The beta prior has the mean and the precision that the method of moments gives for the rates of all hosts (weighted
    by documents); with one host, or rates that vary no more than chance would have it, the prior weighs as much as
    the average host. A host fails if (failures + a) / (docs + a + b) exceeds max_rate.
    """
    hosts = (
        judged.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count("*").alias("docs"), F.sum(F.col(failed_col).cast("long")).alias("failures"))
        .withColumn("rate", F.col("failures") / F.col("docs"))
    )
    hosts = cut(hosts)
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("docs").alias("n"),
        F.sum("failures").alias("k"),
        F.sum(F.col("docs") * F.col("rate") * F.col("rate")).alias("second"),
        F.sum(F.col("docs").cast("double") * F.col("docs")).alias("squares"),
    ).first()
    mean, weight = 0.5, 1.0
    if sums["n"]:
        n, mean = sums["n"], sums["k"] / sums["n"]
        spread = sums["second"] - n * mean * mean  # sum of n_i (p_i - mean)^2
        chance = (sums["hosts"] - 1) * mean * (1 - mean)
        free = n - sums["squares"] / n
        between = (spread - chance) / free if free > 0 else 0.0  # variance of true rates
        weight = mean * (1 - mean) / between - 1 if between > 0 else n / sums["hosts"]
        weight = min(max(weight, 1.0), n / sums["hosts"])
    shrunk = (F.col("failures") + mean * weight) / (F.col("docs") + weight)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_failed", F.col("shrunk_rate") > max_rate)


def judge(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_rate: float = HOST_RATE, keep: list[str] | None = None) -> DataFrame:
    """docs (columns in `keep`, or all) plus the measures, base_failed, shrunk_rate (of the host) and kept.

    kept is false if base_failed or if the host fails. A null host is judged by the document alone (shrunk_rate null);
    null and empty texts have 0 words and fail; repeated rows are rows like others; no rows give no rows. The measured
    rows are written once and aggregated in part before the shuffle; host rows are joined back
    by a join that adaptive execution can split if one host has a large share of the rows.
    """
    kept = list(docs.columns) if keep is None else keep
    hidden = "__host"
    base = docs.withColumn(hidden, F.col(f"`{host_col}`").cast("string"))
    rows = cut(measured(base, text_col, [*kept, hidden]))
    verdicts = host_verdicts(rows, hidden, max_rate=max_rate).select(F.col("host").alias(hidden), "shrunk_rate", "host_failed")
    joined = rows.drop(*[c for c in ("shrunk_rate", "host_failed", "kept") if c in kept]).join(verdicts, hidden, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).drop(hidden, "host_failed")
