"""Cross-entropy difference (Moore and Lewis, 2010) with bigram models of a target and of the whole corpus.

Both models have one vocabulary (every word of the corpus), one order and one smoothing, and are counted over all documents.
Each token's loss under the target model less its loss under the background model, averaged over a document, is its
score: the lower, the more like the target. A document's own counts are taken out of both models when it is scored.

Documents are read in chunks. A chunk sends each of its distinct n-grams once, with counts, to the bucket of the n-gram's
hash; buckets add up and send the corpus counts back to each chunk that asked. So frequent n-grams cost no
more than rare ones, and neither documents nor tokens are joined with the model row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches, tidy

#: Characters of text in a chunk (a longer text is a chunk of its own).
CHUNK_CHARS = 12 << 20
#: Characters of text for each bucket of n-grams.
BUCKET_CHARS = 24 << 20
#: Target ids that may be sent to all executors; more are joined.
BROADCAST_IDS = 2_000_000
#: Weight of the unigram model in the bigram model, and of the uniform one in the unigram model, in tokens.
BIGRAM_PRIOR = 4.0
UNIGRAM_PRIOR = 0.5

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONE = np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x6A09E667F3BCC908)


class _Vocabulary(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out

    def keys_of(self) -> np.ndarray:
        """Hashes by number; even ones, those of bigrams are odd."""
        return np.fromiter(map(xxhash.xxh64_intdigest, self), np.uint64, len(self)) & ~_ONE


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def bigrams(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Odd keys; those of words are even."""
    with np.errstate(over="ignore"):
        h = (before * _MIX) ^ (word >> np.uint64(7))
        h = (h ^ (h >> np.uint64(31))) * _MIX + word
    return (h ^ (h >> np.uint64(29))) | _ONE


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different codes in ascending order, the place of each code among them, and how often each occurs. Codes that leave
    room for it are sorted with their positions in the low bits: values sort several times faster than an index."""
    n = len(codes)
    bits = max(1, (n - 1).bit_length())
    if not n or int(codes.max()) >> (64 - bits):
        return np.unique(codes, return_inverse=True, return_counts=True)
    packed = (codes << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    at = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    packed >>= np.uint64(bits)
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    counts = np.diff(np.r_[first, n])
    back = np.empty(n, np.int64)
    back[at] = np.repeat(np.arange(len(first)), counts)
    return packed[first], back, counts


class Chunk:
    """Documents as one row of words, numbered in `vocabulary` (their keys); counted() finds their bigrams and how often those
    occur."""

    def __init__(self, vocabulary: np.ndarray, word: np.ndarray, lengths: np.ndarray, target: np.ndarray):
        self.vocabulary, self.word, self.lengths, self.target = vocabulary, word, lengths, target
        digest = xxhash.xxh3_128()
        for x in (vocabulary, word, lengths, target):
            digest.update(x.tobytes())
        self.name = digest.hexdigest()

    def counted(self) -> Chunk:
        word, lengths, start = self.word, self.lengths, len(self.vocabulary)
        self.begun = lengths > 0
        self.first = (np.cumsum(lengths) - lengths)[self.begun]
        #: The word before each, the start of a document being a word of its own.
        self.before = np.empty(len(word), np.int64)
        self.before[1:] = word[:-1]
        self.before[self.first] = start
        pairs, self.pair, self.pair_n = distinct(self.before.astype(np.uint64) * np.uint64(start + 1) + word)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        known = np.append(self.vocabulary, _START)
        context, last = np.divmod(pairs, np.uint64(start + 1))
        #: Keys in ascending order: words, bigrams, and the start of a document, which counts as a word.
        self.keys, at = np.unique(np.concatenate((known, bigrams(known[context], known[last]))), return_inverse=True)
        self.word_at, self.pair_at = at[: start + 1], at[start + 1 :]
        return self

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs, and how often in target documents."""
        mine = self.target[self.doc]
        at, out = np.concatenate((self.word_at, self.pair_at)), []
        for word, pair, starts in ((self.word, self.pair, self.begun), (self.word[mine], self.pair[mine], self.begun & self.target)):
            n = np.concatenate((np.bincount(word, minlength=len(self.vocabulary)), [starts.sum()], np.bincount(pair, minlength=len(self.pair_n))))
            out.append(np.bincount(at, n, len(self.keys)).astype(np.uint32))
        return tuple(out)

    def packed(self) -> tuple[bytes, bytes]:
        """The words' keys, and the words as numbers."""
        return self.vocabulary.tobytes(), _press(self.word)

    @classmethod
    def unpacked(cls, words: bytes, places: bytes, lengths: np.ndarray, target: np.ndarray) -> Chunk:
        return cls(np.frombuffer(words, np.uint64), _open(places, np.uint32), lengths, target)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Chunk]]:
    """(ids, chunk): texts become word numbers as they come, so that no texts pile up, and of the words only different ones."""
    ids, parts, target, held, known = [], [], [], 0, _Vocabulary()

    def made() -> tuple[list, Chunk]:
        return ids, Chunk(known.keys_of(), np.concatenate([np.empty(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64), np.array(target, bool))

    for batch in batches:
        for part in slices(batch, "text"):
            for i, t, y in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("target").to_pylist(), strict=True):
                n = len(t) if t else 0
                if ids and held + n > CHUNK_CHARS:
                    yield made()
                    ids, parts, target, held, known = [], [], [], 0, _Vocabulary()
                w = words(t)
                ids.append(i)
                parts.append(np.fromiter(map(known.__getitem__, w), np.uint32, len(w)))
                target.append(bool(y))
                held += n
    if ids:
        yield made()


def _press(x: np.ndarray) -> bytes:
    """The array's bytes by their place in the numbers, all first bytes before all second ones: high ones are mostly alike."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _open(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys of each bucket, a range of hashes, begin; and the end."""
    step = (1 << 64) // buckets
    edges = np.array([min(i * step, (1 << 64) - 1) for i in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _ask(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches):
            n, m = chunk.counted().counts()
            at = _bucket_edges(chunk.keys, buckets)
            own = [b for b in range(buckets) if at[b] < at[b + 1]]
            cols = [[], [], []]
            for b in own:
                s = slice(at[b], at[b + 1])
                cols[0].append(_press(np.diff(chunk.keys[s], prepend=np.uint64(0))))
                cols[1].append(_press(n[s]))
                cols[2].append(_press(m[s]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk.name] * len(own)), pa.array(own, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]],
                names=["chunk", "bucket", "keys", "n", "m"],
            )

    return docs.mapInArrow(tidy(run), "chunk string, bucket int, keys binary, n binary, m binary")


def _answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of the keys that each chunk asked for; in a row without a chunk, what the bucket adds to the totals:
    distinct words, tokens, tokens of the target."""
    asked = [np.cumsum(_open(k, np.uint64), dtype=np.uint64) for k in pdf["keys"]]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(at, np.concatenate([_open(x, np.uint32) for x in pdf["n"]]), len(keys)).astype(np.int64)
    m = np.bincount(at, np.concatenate([_open(x, np.uint32) for x in pdf["m"]]), len(keys)).astype(np.int64)
    rows, first = [], 0
    for chunk, a in zip(pdf["chunk"], asked, strict=True):
        own = at[first : first + len(a)]
        rows.append((chunk, key[0], _press(n[own]), _press(m[own]), 0, 0, 0))
        first += len(a)
    word = ((keys & _ONE) == 0) & (keys != _START)
    rows.append((None, key[0], None, None, int(word.sum()), int(n[word].sum()), int(m[word].sum())))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "n", "m", "vocabulary", "tokens", "target_tokens"])


def _tell(docs: DataFrame, id_kind: str) -> DataFrame:
    """A row for each chunk: its documents, and its words as places in the list of its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks(batches):
            keys, places = chunk.packed()
            own = [pa.array([x], pa.binary()) for x in (_press(chunk.target), _press(chunk.lengths), keys, places)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk.name]), pa.array([ids], pa.list_(batch_type)), *own], names=["chunk", "ids", "target", "lengths", "words", "places"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema["id"].dataType)
    return docs.mapInArrow(tidy(run), f"chunk string, ids array<{id_kind}>, target binary, lengths binary, words binary, places binary")


def losses(n: np.ndarray, own: tuple, base: tuple[float, float], vocabulary: int) -> np.ndarray:
    """Loss of bigrams in nats. n: corpus counts of (pair, context, word); own: what the document itself has of each;
    base: tokens of the model's corpus, and the document's own of them."""
    pair, context, word = (np.maximum(c - o, 0) for c, o in zip(n, own, strict=True))
    total = np.maximum(base[0] - base[1], 0)
    unigram = (word + UNIGRAM_PRIOR) / (total + UNIGRAM_PRIOR * (vocabulary + 1))
    return -np.log((pair + BIGRAM_PRIOR * unigram) / (context + BIGRAM_PRIOR))


def _own_counts(doc: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """How often each token's word or bigram, one of `size`, occurs in its document."""
    _, back, n = distinct(doc.astype(np.uint64) * np.uint64(size) + at.astype(np.uint64))
    return n[back]


def score_chunk(chunk: Chunk, n: np.ndarray, m: np.ndarray, vocabulary: int, tokens: int, target_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss of each document (nan without words) under the target and the background model."""
    doc, size = chunk.doc, chunk.lengths[chunk.doc]
    own_word = _own_counts(doc, chunk.word, max(1, len(chunk.vocabulary)))
    own_pair = _own_counts(doc, chunk.pair, max(1, len(chunk.pair_n)))
    own_before = np.empty_like(own_word)
    own_before[1:] = own_word[:-1]
    own_before[chunk.first] = 1
    at = chunk.pair_at[chunk.pair], chunk.word_at[chunk.before], chunk.word_at[chunk.word]
    own = (own_pair, own_before, own_word)
    mine = chunk.target[doc]
    loss_b = losses(tuple(n[x] for x in at), own, (tokens, size), vocabulary)
    loss_t = losses(tuple(m[x] for x in at), tuple(o * mine for o in own), (target_tokens, size * mine), vocabulary)
    with np.errstate(invalid="ignore"):
        return tuple(np.bincount(doc, x, len(chunk.lengths)) / chunk.lengths for x in (loss_t, loss_b))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, loss_target, loss_background, score) for every row of docs; target: a table with the ids (column of
    the same name) of the documents that the target model is counted over, in any number and with repeats.

    score = loss_target - loss_background, in nats a word. Null and empty texts have 0 words and null losses and score.
    Repeated rows are documents like others. A null id is in no target. Without target documents the target model is
    its prior. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = target.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, "id", "left").select("id", "text", "target")
    if not few:  # after a shuffle, rows come in any order; chunks must be the same both times that they are read
        rows = cut(rows)
    chars = docs.agg(F.sum(F.char_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    answers = cut(_ask(rows, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_answer, "chunk string, bucket int, n binary, m binary, vocabulary long, tokens long, target_tokens long"))
    totals = [x or 0 for x in answers.agg(F.sum("vocabulary"), F.sum("tokens"), F.sum("target_tokens")).first()]
    kind = rows.schema["id"].dataType.simpleString()
    told = _tell(rows, kind)
    both = told.withColumns({"bucket": F.lit(-1), "n": F.lit(None).cast("binary"), "m": F.lit(None).cast("binary")}).unionByName(
        answers.where("chunk is not null").select("chunk", "bucket", "n", "m"), allowMissingColumns=True
    )

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = pdf[pdf["bucket"] >= 0].drop_duplicates("bucket").sort_values("bucket")
        empty = np.empty(0, np.int64)
        n, m = (np.concatenate([empty, *[_open(x, np.int64) for x in got[c]]]) for c in "nm")
        out = []
        for r in pdf[pdf["bucket"] < 0].itertuples():
            chunk = Chunk.unpacked(r.words, r.places, _open(r.lengths, np.int64), _open(r.target, bool)).counted()
            if len(n) != len(chunk.keys):
                raise RuntimeError("the counts of a chunk are not complete: its rows were read in another order before")
            t, b = score_chunk(chunk, n, m, *totals)
            out.append(pd.DataFrame({"id": pd.Series(list(r.ids), dtype=object), "n_words": chunk.lengths, "loss_target": t, "loss_background": b}))
        return pd.concat(out)

    # as many parts as there are buckets, by the size of the corpus: a part has the chunks and counts of some BUCKET_CHARS
    scored = both.repartition(buckets, "chunk").groupBy("chunk").applyInPandas(score, f"id {kind}, n_words long, loss_target double, loss_background double")
    some = F.col("n_words") > 0
    out = [F.when(some, F.col(c)).alias(c) for c in ("loss_target", "loss_background")]
    return scored.select(F.col("id").alias(id_col), "n_words", *out).withColumn("score", F.col("loss_target") - F.col("loss_background"))
