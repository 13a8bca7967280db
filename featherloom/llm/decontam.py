"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Texts are normalised to lower-case words joined by single spaces. Each run of 8 consecutive item words is a pattern
(an item of fewer words is one pattern); one pass of the automaton over a document finds every occurrence of every
pattern. Word numbers of hits are mapped back to code-point offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, keeps, map_texts, slices, small_batches, tidy

WINDOW = 8
#: Bytes of item text that one automaton holds (it takes about 100 bytes for a byte of distinct windows); more items are scanned
#: for in further blocks.
BLOCK_BYTES = 4 << 20
#: Words are runs of these characters, once A-Z are lower-cased.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The automaton that a Python worker keeps from task to task, by the name of its block.
_AUTOMATA: dict[str, tuple] = {}
keeps("decontam", _AUTOMATA.clear)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def automaton(items: list[tuple[str, str]], size: int) -> tuple:
    """(automaton, patterns): patterns[i] is (length, number of words, item ids)."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    auto, patterns = ahocorasick.Automaton(), []
    for w in sorted(owners):
        auto.add_word(f" {w.decode('latin-1')} ", len(patterns))
        patterns.append((len(w) + 2, w.count(b" ") + 1, tuple(sorted(owners[w]))))
    if patterns:
        auto.make_automaton()
    return (auto if patterns else None), patterns


def cached_automaton(name: str, block, size: int) -> tuple:
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = automaton(block.value, size)
    return _AUTOMATA[name]


def scan(text: str | None, auto, patterns: list) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged [first, last) word ranges inside occurrences, and the items that occur."""
    w = words(text)
    if not w or auto is None:
        return len(w), [], set()
    found, items, starts = [], set(), None
    for end, p in auto.iter(f" {b' '.join(w).decode('latin-1')} "):
        if starts is None:
            starts = list(accumulate((len(x) + 1 for x in w), initial=0))
        length, n, owners = patterns[p]
        first = bisect_right(starts, end - length + 1) - 1
        found.append((first, first + n))
        items.update(owners)
    return len(w), merge(found), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of merged word ranges."""
    if not ranges:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in ranges]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items with words, streamed to the driver in blocks of bounded size (a single larger item is its own)."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    block, held = [], 0
    for r in rows.where("i is not null and t is not null").toLocalIterator():
        n = len(r.t.encode())
        if block and held + n > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += n
    yield block


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", _SPAN),
]
_PART = "h binary, ranges array<struct<a: long, b: long>>, items array<string>"


def _scanned(texts: list, block, name: str, size: int) -> Iterator[tuple[int, list, set]]:
    auto, patterns = cached_automaton(name, block, size)
    for t in texts:
        yield scan(t, auto, patterns)


def _described(text: str | None, n: int, ranges: list[tuple[int, int]], items) -> tuple:
    ranges = merge(ranges)
    return n, sum(b - a for a, b in ranges), sorted(items), [{"start": a, "end": b} for a, b in offsets(text or "", ranges)]


def _columns(rows: list[tuple]) -> list[list]:
    return [[r[i] for r in rows] for i in range(len(_FIELDS))]


def find_overlap(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (columns in `keep`, or all) plus n_words, n_hit, hit_items (sorted item ids) and hit_spans (merged code-point
    ranges of the original text that lie inside occurrences of item windows).

    Null and empty texts have no words and no hits; items without words match nothing; repeated rows each get their
    result; no items give no hits. Columns of docs with these names give way. The items of `block_bytes` of text are one
    automaton, built once in a worker, and the documents are scanned once, without a shuffle. More items are more blocks: the
    documents are scanned once for each, by one automaton at a time, and what hits there are (few rows) is put together
    by a hash of the text before it is joined back.
    """
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _one_block(docs, first, text_col, size, keep)
    return _many_blocks(docs, chain([first, second], blocks), text_col, size, keep)


def _sent(docs: DataFrame, block: list, size: int) -> tuple:
    return docs.sparkSession.sparkContext.broadcast(block), hashlib.sha256(repr((size, block)).encode()).hexdigest()


def _one_block(docs: DataFrame, items: list, text_col: str, size: int, keep: list[str] | None) -> DataFrame:
    block, name = _sent(docs, items, size)

    def apply(texts: list) -> list[list]:
        return _columns([_described(t, *found) for t, found in zip(texts, _scanned(texts, block, name, size), strict=True)])

    return map_texts(docs, text_col, _FIELDS, lambda: apply, keep, own="decontam")


def _many_blocks(docs: DataFrame, blocks: Iterator[list], text_col: str, size: int, keep: list[str] | None) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(text.alias("t")).where("t is not null")
    found = reduce(DataFrame.unionByName, [cut(_hits(texts, *_sent(docs, items, size), size)) for items in blocks])
    # equal texts have equal hits: one of them is enough, and what a text has in several blocks is put together
    whole = found.distinct().groupBy("h").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    new = {f.name for f in _FIELDS}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("t"), F.unhex(F.sha2(text, 256)).alias("h")).join(whole, "h", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(T.StructType(_FIELDS))
        for batch in batches:
            for part in slices(batch, "t"):
                rows = []
                for t, ranges, items in zip(*[part.column(c).to_pylist() for c in ("t", "ranges", "items")], strict=True):
                    rows.append(_described(t, len(words(t)), [(r["a"], r["b"]) for r in ranges or ()], set(items or ())))
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(c, f.type) for c, f in zip(_columns(rows), kinds, strict=True)]], names=["row", *kinds.names])

    small_batches(docs.sparkSession)
    out = rows.select("row", "t", "ranges", "items").mapInArrow(tidy(run), T.StructType([T.StructField("row", rows.schema["row"].dataType), *_FIELDS]))
    return out.select("row.*", *[f.name for f in _FIELDS])


def _hits(texts: DataFrame, block, name: str, size: int) -> DataFrame:
    """(h, ranges, items): of the texts with hits of one block, a hash, the word ranges and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                own = part.column("t").to_pylist()
                rows = [
                    {"h": hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(), "ranges": [{"a": a, "b": b} for a, b in ranges], "items": sorted(items)}
                    for t, (_, ranges, items) in zip(own, _scanned(own, block, name, size), strict=True)
                    if items
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T._parse_datatype_string(_PART))
    small_batches(texts.sparkSession)
    return texts.mapInArrow(tidy(run, own="decontam"), _PART)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, min_items: int = 2, **options) -> DataFrame:
    """The rows of docs with windows of fewer than `min_items` benchmark items, all columns kept as they are."""
    flags = find_overlap(docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), items, keep=["__row"], **options)
    return flags.where(F.size("hit_items") < min_items).select("__row.*")
