"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become pieces of at most `capacity` tokens. Pieces are dealt to groups of bounded size; each group is packed by
best-fit decreasing and improved by local search: moves, one-for-one and two-for-one exchanges between underfull bins that
increase the sum of squared fills, until bins empty. Bins that stay open are packed again, together across groups.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keeps, slices, small_batches, tidy

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs together, on average.
GROUP = 8192
#: Bins with more than this share of the capacity free are packed again across groups.
OPEN = 0.02
#: Chunks of text whose ids a worker keeps.
CACHE = 500_000
#: ASCII characters that are neither letters nor digits nor white space: to the tokenizer, a run of them behind letters is a word.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKENIZERS: dict[str, object] = {}
_IDS: dict[str, dict[bytes, bytes]] = {}


def forget() -> None:
    _IDS.clear()
    _TOKENIZERS.clear()


keeps("packing", forget)


def tokenizer(path: str):
    """The tokenizer, and for each id whether its token ends a word."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are busy with other tasks
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _TOKENIZERS[path] = t, np.array([(t.id_to_token(i) or "").endswith("</w>") for i in range(t.get_vocab_size())])
    return _TOKENIZERS[path]


def _plain(word: str) -> bool:
    """One word to the tokenizer: letters that its normalisation leaves letters."""
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


def _encode_plain(words: list[str], path: str) -> list[bytes]:
    """Ids of words that are one word each to the tokenizer, many in a call, parted after the tokens that end a word."""
    t, ends = tokenizer(path)
    out = []
    for i in range(0, len(words), 1000):
        some = words[i : i + 1000]
        ids = np.array(t.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ends[ids]) + 1
        if len(at) != len(some):
            out += _encode(some, path)
            continue
        raw, stops = ids.tobytes(), (4 * at).tolist()
        out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
    return out


def _encode(words: list[str], path: str) -> list[bytes]:
    encoded = tokenizer(path)[0].encode_batch_fast(words, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in encoded]


def learn_parts(missing: list[bytes], known: dict[bytes, bytes], path: str) -> None:
    """Add the ids of parts to `known`. Letters before ASCII punctuation at the end of a part are a word of their own."""
    cores, tails, whole, cut_off = {}, {}, [], []
    for w in missing:
        core = w.rstrip(_PUNCTUATION)
        if core not in cores:
            word = core.decode("utf-8", "surrogatepass")
            if not _plain(word):
                whole.append(w)
                continue
            if core not in known:
                cores[core] = word
        if len(core) < len(w):
            tail = w[len(core) :]
            tails[tail] = None
            cut_off.append((w, core, tail))
    known.update(zip(cores, _encode_plain(list(cores.values()), path), strict=True))
    other = [*whole, *(t for t in tails if t not in known)]
    known.update(zip(other, _encode([w.decode("utf-8", "surrogatepass") for w in other], path), strict=True))
    for w, core, tail in cut_off:
        known[w] = known[core] + known[tail]


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each whole text and the end id, as little-endian unsigned 32-bit integers.

    The vocabulary is for lower case, drops white space and never joins what white space parts, so that the ids of a
    text are those of its parts between ASCII white space, one after the other; ids of parts are kept from text to text.
    """
    known = _IDS.setdefault(path, {})
    end = END_ID.to_bytes(4, "little")
    # a special token's string is recognised before letters are made lower-case, so that texts with one stay as they are
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    parts = [(r if b"<|" in r else r.translate(_LOWER)).split() for r in raw]
    missing = set().union(*parts).difference(known)
    if len(known) + len(missing) > CACHE:  # what these texts have too is worth keeping
        kept = {p: known[p] for p in set().union(*parts) if p in known}
        known.clear()
        known.update(kept)
    learn_parts(list(missing), known, path)
    return [b"".join(map(known.__getitem__, p)) + end for p in parts]


def cut_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): a row for each piece; documents of at most `capacity` ids are one piece."""
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__t"))
    kind = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__t"):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(token_bytes(part.column("__t").to_pylist(), path)):
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                arrays = [part.column("__id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["__id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return source.mapInArrow(tidy(run, own="packing"), f"__id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("__id", id_col)


class Bins:
    """Bins of one group. items: sizes by item number; where: the bin of each item, or -1."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes = np.asarray(sizes, np.int64)
        self.capacity = capacity
        self.where = np.full(len(self.sizes), -1, np.int64)
        self.fill = np.zeros(0, np.int64)

    def best_fit(self) -> None:
        """Best-fit decreasing; the fullest bin that takes an item is found from a bit set of free sizes."""
        free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask, fill = 0, []
        for i in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[i])
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = free[room].pop()
                if not free[room]:
                    mask ^= 1 << room
                fill[b] += size
            else:
                b, room = len(fill), self.capacity
                fill.append(size)
            self.where[i] = b
            left = room - size
            if left:
                free[left].append(b)
                mask |= 1 << left
        self.fill = np.array(fill, np.int64)

    def bound(self) -> int:
        """Bins that any packing needs: all tokens, and a bin for each item of more than half of the capacity."""
        return max(-(-int(self.sizes.sum()) // self.capacity), int((self.sizes * 2 > self.capacity).sum()))

    def improve(self) -> None:
        """Local search over underfull bins. Every exchange raises the sum of squared fills, so it ends; a pass that
        empties no bin and makes no exchange is the last, and so is one after which no packing can have fewer bins."""
        bound = self.bound()
        while int((self.fill > 0).sum()) > bound and self.sweep():
            pass

    def sweep(self) -> bool:
        order = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        changed = False
        for s in order[np.argsort(self.fill[order], kind="stable")].tolist():
            while 0 < self.fill[s] < self.capacity and self.exchange(s):
                changed = True
        return changed

    def exchange(self, s: int) -> bool:
        """Do the exchange between bin s and another underfull bin that fills the other most; False if none gains."""
        room = self.capacity - self.fill
        open_bins = np.flatnonzero((self.fill > 0) & (room > 0))
        open_bins = open_bins[open_bins != s]
        if not len(open_bins):
            return False
        mine = np.flatnonzero(self.where == s)
        mask = np.zeros(len(self.fill), bool)
        mask[open_bins] = True
        theirs = np.flatnonzero(mask[self.where])
        t_size, t_bin = self.sizes[theirs], self.where[theirs]
        t_room, t_ahead = room[t_bin], self.fill[t_bin] - self.fill[s]
        best, gain = None, 0
        # one item, or two, of each size: a bin has less than the root of 2 * capacity different sizes
        by_size: dict[int, list[int]] = {}
        for i in mine.tolist():
            own = by_size.setdefault(int(self.sizes[i]), [])
            if len(own) < 2:
                own.append(i)
        few = list(by_size.values())
        groups = [(x[0],) for x in few] + [tuple(x) for x in few if len(x) == 2]
        groups += [(a[0], b[0]) for k, a in enumerate(few) for b in few[k + 1 :]]
        for group in groups:
            size = int(sum(self.sizes[i] for i in group))
            if len(group) == 1:
                ahead = self.fill[open_bins] - self.fill[s]
                g = np.where(size <= room[open_bins], 2 * size * (ahead + size), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = (group, -1, int(open_bins[k])), int(g[k])
            d = size - t_size
            g = np.where((d > 0) & (d <= t_room), 2 * d * (t_ahead + d), 0)
            k = int(np.argmax(g))
            if g[k] > gain:
                best, gain = (group, int(theirs[k]), int(t_bin[k])), int(g[k])
        if best is None:
            return False
        group, other, t = best
        for i in group:
            self.where[i] = t
        d = int(sum(self.sizes[i] for i in group))
        if other >= 0:
            self.where[other] = s
            d -= int(self.sizes[other])
        self.fill[t] += d
        self.fill[s] -= d
        return True


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.improve()
    return bins.where


def _pack_groups(items: DataFrame, cols: list[str], capacity: int, group: int, level: int) -> DataFrame:
    """items (written already) plus __bin, unique over all groups of all levels, __at and __fill."""
    groups = max(1, -(-items.count() // group))
    dealt = items.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cols, kind="stable").reset_index(drop=True)
        where = pack(pdf["length"].to_numpy(), capacity)
        order = np.argsort(where, kind="stable")
        size = pdf["length"].to_numpy()[order]
        ends = np.cumsum(size)
        first = np.r_[True, where[order][1:] != where[order][:-1]]
        at = ends - size
        at -= np.maximum.accumulate(np.where(first, at, 0))
        out = pdf.iloc[order].drop(columns="__group")
        out["__bin"] = (np.int64(level) << 60) | (np.int64(key[0]) << 24) | where[order]
        out["__at"] = at
        out["__fill"] = np.bincount(where, weights=pdf["length"].to_numpy()).astype(np.int64)[where[order]]
        return out

    return dealt.groupBy("__group").applyInPandas(run, f"{kinds}, __bin long, __at long, __fill long")


def pack_sequences(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (with an integer column `length`, 1 to capacity) plus sequence_id and offset (gapless from 0 in a sequence).

    Every row gets a place, repeated rows too; no rows give no rows. The rows are written to the checkpoint folder first
    and dealt to groups by their place there, so that no key decides the size of a group. Lengths beyond the capacity
    are an error. Columns sequence_id and offset of the input give way.
    """
    base = cut(pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in {"sequence_id", "offset"}]))
    cols = base.columns
    first = cut(_pack_groups(base, cols, capacity, group, 0))
    is_open = F.col("__fill") < int(capacity * (1 - OPEN))
    again = _pack_groups(cut(first.where(is_open).select(*cols)), cols, capacity, group, 1)
    return first.where(~is_open).unionByName(again).withColumnsRenamed({"__bin": "sequence_id", "__at": "offset"}).drop("__fill")


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document; a null or empty text
    is the end id alone."""
    return pack_sequences(cut_pieces(docs, path, id_col, text_col, capacity), capacity, group)
