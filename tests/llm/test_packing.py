import random
import zlib

import numpy as np
import pytest

from featherloom.llm import packing
from featherloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def valid(rows, capacity):
    """Gapless sequences of at most the capacity; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_are_those_of_whole_texts(whole, documents):
    rng = random.Random(4)
    alphabet = ["Hello", "wörld,", "don't", "x.", "3,14", "<|endoftext|>", "<|", "İ", "ß", "漢字", " ", "　", "é", " ", "\n", "\t", "...", "A'b", "1st", "--", "​", "ſ"]
    texts = [None, "", " ", *["".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25))) for _ in range(400)], *[r["text"] for r in documents.collect()]]
    for t, got in zip(texts, packing.token_bytes(texts, tokenizer_path()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole(t), t


def test_pieces_and_sequences(spark, documents, whole):
    rows = packing.pack_documents(documents, tokenizer_path()).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    total = 0
    for i, own in pieces.items():
        ids = whole(texts[i])
        total += len(ids)
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 4096)
        for r in own:
            part = ids[r["start"] : r["start"] + 4096]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    least = -(-total // 4096)
    assert valid(rows, 4096) <= least * 1.02 + 1


def fewest(sizes, capacity):
    """The least number of bins, by trying."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_local_search_against_the_best():
    rng, worse = random.Random(6), 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 11))), reverse=True)
        where = packing.pack(np.array(sizes), 100)
        fill = np.bincount(where, weights=sizes)
        assert fill.max() <= 100
        got = int((fill > 0).sum())
        assert got <= fewest(sizes, 100) + 1
        worse += got > fewest(sizes, 100)
    assert worse <= 3


def test_exchanges_raise_the_squares():
    rng = np.random.default_rng(7)
    bins = packing.Bins(rng.integers(1, 90, 300), 100)
    bins.best_fit()
    before, n = (bins.fill.astype(float) ** 2).sum(), (bins.fill > 0).sum()
    bins.improve()
    assert (bins.fill**2).sum() >= before and (bins.fill > 0).sum() <= n
    assert np.bincount(bins.where, weights=bins.sizes, minlength=len(bins.fill)).tolist() == bins.fill.tolist()


def test_edges(spark, table):
    docs = table(None, "", "x", "x", "word " * 9000, extra={"sequence_id": "clash", "length": "clash"})
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert valid(rows, 4096) == 3 and sorted(r["length"] for r in rows) == [1, 1, 2, 2, 809, 4096, 4096]
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
    small = packing.pack_documents(docs, tokenizer_path(), group=2).collect()
    assert len(small) == len(rows) and valid(small, 4096) >= 3


def test_punctuation_behind_parts_that_are_known(whole):
    """Letters before ASCII punctuation are a word of their own; what else ends a part may run on into the punctuation."""
    packing.forget()
    for some in (["abc”", "555-98", "wörd", "don't", "x'"], ["abc”.", "555-98.", "wörd'$%", "don't!'", "x's", "'salt", "abc””", "...", "wörd.'s", "漢字.", "漢字"]):
        for t, got in zip(some, packing.token_bytes(some, tokenizer_path()), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole(t), t


def test_thousands_of_equal_items_in_a_bin():
    """One bin of 4,000 items of one token, and bins with room for some of them."""
    sizes = np.array([1] * 4000 + [4090] * 3)
    bins = packing.Bins(sizes, 4096)
    bins.where = np.r_[np.zeros(4000, np.int64), [1, 2, 3]]
    bins.fill = np.array([4000, 4090, 4090, 4090], np.int64)
    assert bins.exchange(0) and bins.fill.sum() == sizes.sum() and bins.fill.max() <= 4096
    where = packing.pack(sizes)
    assert np.bincount(where, weights=sizes).max() <= 4096 and len(set(where.tolist())) == 4
